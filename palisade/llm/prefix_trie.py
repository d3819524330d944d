"""Prefix trie of conversations by burst tries.

A conversation is a sequence of turn ids (120 bits of a digest of role and text), laid down in pieces of ``piece`` turns so that
no row grows with a conversation.  Conversations of equal sequences are one class with a weight before anything is grouped.

* A **container** holds the suffixes of all classes behind one trie head, up to the end of the head's piece.  The root is the
  first head.  A container of one class is a chain and needs no trie.
* A container of more than ``limit`` turns **bursts**: what all its suffixes begin with becomes a path, and the next turn id
  deals them into containers under new heads.  Counts of a head combine before the shuffle, so a head that holds a third
  of all conversations is no task's work.  Every burst divides its container; rounds go on until none is too large.
* The other containers, many to a shard, are **sorted and swept** level by level into nodes.  Classes that go on behind the piece
  pass to the containers of its last nodes.

A node is told by its smallest member and its depth.  What a subtree adds up is a sum over its members: with P(d) the characters of
a path down to depth d, and every class but the smallest owning its nodes from some depth on, a class adds
``(weight - 1) * (P(end) - P(d - 1))``, and its way to its first own node adds the rest.  So a first pass finds the owners and a
second one sums, each over all containers at once; nothing is passed from node to node.
"""

from __future__ import annotations

import hashlib
import sys
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.llm import base, words as W

#: Characters of a turn id: 15 bytes in base64.
WIDTH = 20
NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends_sha256 string")
NOTHING = hashlib.sha256(b"").hexdigest()
#: Bytes of decimal ids that are hashed as one string.
PACK = 1 << 20


def digest(*parts: Column) -> Column:
    """120 bits of SHA-256 over the lengths and bytes of the parts."""
    sized = [F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.substring(F.base64(F.unhex(F.sha2(F.concat(*sized).cast("binary"), 256))), 1, WIDTH)


def _numbered(batches):
    """Place of each row among its conversation's rows of this partition; rows come sorted."""
    part, conv, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        own = batch.column(0).to_numpy()
        if not len(own):
            continue
        new = np.append(True, own[1:] != own[:-1])
        starts = np.flatnonzero(new)
        first = np.where(np.arange(len(starts)) == 0, n if conv == own[0] else 0, 0)
        at = np.arange(len(own)) - np.repeat(starts - first, np.diff(np.append(starts, len(own))))
        conv, n = own[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.full(len(own), part, np.int32)), pa.array(at), batch.column(1), batch.column(2)],
            ["conv", "part", "at", "tid", "chars"])


def turns(conversations: DataFrame) -> DataFrame:
    """conv, pos, tid, chars for every turn: its place from 0 by turn (null first, then role and text by digest), id and length.

    Ranges of conversations *and* turns are sorted, so that a very long conversation is spread over tasks; a small table of what
    each range holds of a conversation gives the places their offsets.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = base.only(conversations, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), digest(role, text).alias("tid"),
        F.char_length(text).alias("chars"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("tid")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "tid", "chars")
    local = base.written(dealt.mapInArrow(_numbered, "conv long, part int, at long, tid string, chars int"), "turns")
    held = local.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = held.withColumn("before", before).where("before > 0").select("conv", "part", "before")
    # At most one row per partition: a conversation goes on in a range only where the range begins with it.
    return local.join(F.broadcast(offsets), ["conv", "part"], "left").select(
        "conv", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "tid", "chars")


def rebuilt(own: DataFrame) -> DataFrame:
    """conv, pos, tid, chars with the first h = crc32(conv) % 6 turns taken from the first conversation of its hundred."""
    hundred, h = F.col("conv") - F.col("conv") % 100, F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    heads = own.where((F.col("conv") % 100 == 0) & (F.col("pos") < 5)).groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("pos", "tid", "chars"))).alias("head")).withColumnRenamed("conv", "hundred")
    convs = own.select("conv").distinct().select("conv", hundred.alias("hundred"), h.alias("h")).join(heads, "hundred", "left")
    taken = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h").cast("int"))
    convs = base.written(convs.select("conv", "h", taken.alias("head")), "heads")
    first = convs.select("conv", F.inline("head"))
    rest = own.join(convs.select("conv", "h", F.size("head").alias("n")), "conv").where("pos >= h").select(
        "conv", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "tid", "chars")
    # A conversation without a turn left is one of its end alone.
    bare = convs.select("conv", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("tid"), F.lit(0).alias("chars"))
    return first.unionByName(rest).unionByName(bare)


def pieces(sequences: DataFrame, piece: int) -> DataFrame:
    """conv, j, key (the piece's turn ids end to end), chars (their lengths), n (turns of the conversation), before (characters
    before the piece), total and seq (digest of all pieces)."""
    rows = sequences.groupBy("conv", F.greatest(F.expr(f"pos div {piece}"), F.lit(0)).alias("j")).agg(
        F.sort_array(F.collect_list(F.when(F.col("pos") >= 0, F.struct("pos", "tid", "chars")))).alias("own"))
    rows = rows.select("conv", "j", F.array_join("own.tid", "").alias("key"), F.col("own.chars").alias("chars"))
    rows = base.written(rows.withColumn("sum", F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)), "pieces")
    place = Window.partitionBy("conv").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy("conv").agg(
        F.sum(F.size("chars")).alias("n"), F.sum("sum").alias("total"),
        F.bit_xor(F.xxhash64("j", "key")).alias("_a"), F.sum(F.xxhash64("key", "j").cast("decimal(20,0)")).alias("_b"))
    whole = whole.select("conv", "n", "total", F.concat_ws(":", "n", "total", "_a", "_b").alias("seq"))
    if rows.where("j > 0").limit(1).count():
        rows = rows.withColumn("before", F.coalesce(F.sum("sum").over(place), F.lit(0)))
    else:
        rows = rows.withColumn("before", F.lit(0).cast("long"))
    return base.written(rows.drop("sum").join(whole, "conv"), "pieces")


def _pack(batches):
    """Decimal ids of equal classes next to each other, joined into strings of bounded length; rows come sorted."""
    now, ids, size, at = None, [], 0, 0
    part = TaskContext.get().partitionId()

    def full():
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([part], pa.int32()), pa.array([at]), pa.array([",".join(ids)])],
                                          ["rep", "part", "at", "ids"])
    for batch in batches:
        for rep, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if ids and (rep != now or size > PACK):
                yield full()
                at = at + 1 if rep == now else 0
                ids, size = [], 0
            now = rep
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        yield full()


def _hash_packed(batches):
    now, sha = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], ["rep", "ends"])
    for batch in batches:
        for rep, ids in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            if rep != now:
                if sha:
                    yield done()
                now, sha = rep, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
    if sha:
        yield done()


def classes(rows: DataFrame) -> DataFrame:
    """rep (smallest conversation), w (conversations), n, total, ends (digest of their ids) for each different sequence."""
    convs = rows.where("j = 0").select("conv", "seq", "n", "total")
    found = base.written(convs.groupBy("seq").agg(F.min("conv").alias("rep"), F.count("*").alias("w"), F.first("n").alias("n"),
                                                  F.first("total").alias("total")), "classes")
    members = convs.join(found.where("w > 1").select("seq", "rep"), "seq").select("rep", "conv")
    # Ids are hashed in their order: ranges of them are joined into strings side by side, and a class reads few of those.
    packed = members.repartitionByRange("rep", "conv").sortWithinPartitions("rep", "conv").mapInArrow(
        _pack, "rep long, part int, at long, ids string")
    ends = packed.repartition("rep").sortWithinPartitions("rep", "part", "at").mapInArrow(_hash_packed, "rep long, ends string")
    one = F.sha2(F.col("rep").cast("string").cast("binary"), 256)
    return base.written(found.drop("seq").join(ends, "rep", "left").withColumn("ends", F.coalesce("ends", one)), "classes")


def _whole_containers(work, rows_held):
    """Applies ``work`` to runs of whole containers of about ``rows_held`` rows; rows come sorted by head, the first column."""
    def run(batches):
        held = []

        def cut(last):
            rows = pa.Table.from_batches(held).combine_chunks()
            heads = rows.column(0).combine_chunks()
            new = np.flatnonzero(pc.not_equal(heads[1:], heads[:-1]).to_numpy(zero_copy_only=False)) + 1
            at = rows.num_rows if last else int(new[-1]) if len(new) else 0
            return rows.slice(0, at), new[new < at], rows.slice(at).to_batches()
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= rows_held:
                rows, new, held = cut(False)
                if rows.num_rows:
                    yield from work(rows, new)
        if held:
            yield from work(*cut(True)[:2])
    return run


def _sweep(piece: int, final: bool):
    """Nodes of containers, level by level below their heads.

    The first pass tells of each class the characters above its first own node (-1: none here), whether it ends in a leaf, and the
    head it passes to (its smallest class, the node above, the characters above).  The final one gives the nodes.
    """
    def work(rows, new_heads):
        col = {c: rows.column(c).to_numpy() for c in ("depth", "up", "path", "rep", "n", "at0", *(("w", "total", "pown", "leaf") if final else ()))}
        depth, up, path, rep, n, at0 = (col[c] for c in ("depth", "up", "path", "rep", "n", "at0"))
        data, bounds = W.column_bytes(rows.column("key"))
        tid, start = data.view(f"S{WIDTH}"), bounds[:-1] // WIDTH
        chars = rows.column("chars").combine_chunks().flatten().to_numpy().astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(chars)])
        stop = (depth // piece + 1) * piece
        size = len(rep)
        if final:
            w, ends = col["w"], np.array(rows.column("ends").to_pylist(), dtype=object)
            adds, leaves = (w - 1) * col["total"] + col["pown"], col["leaf"].astype(np.int64)
        else:
            pown, leaf = np.full(size, -1), np.zeros(size, bool)
            to = {c: np.full(size, -1) for c in ("to", "to_up", "to_path")}
        alive, segment, level, before = np.arange(size), None, 0, None

        def close(children):
            """The level before, whose children are counted now."""
            if final:
                real, values, tails = before
                values["n_children"] = children
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v[real], pa.int64(), mask=(v == base.NO_ID)[real]) for v in (values[c] for c in NAMES[:-1])] + [pa.array(tails[real], pa.string())], NAMES)
            else:
                at, own = before
                leaf[at[children[own] == 0]] = True
        while len(alive):
            if level:
                mine = tid[start[alive] + level - 1]
                new = np.append(True, (segment[1:] != segment[:-1]) | (mine[1:] != mine[:-1]))
                above = segment[new]
            else:
                new = np.zeros(size, bool)
                new[np.append(0, new_heads).astype(np.int64)] = True
            first = np.flatnonzero(new)
            lead, segment = alive[first], np.cumsum(new) - 1
            smallest = np.minimum.reduceat(rep[alive], first)
            mother = least[above] if level else up[lead]
            higher = at0[lead] + sums[start[lead] + level - 1] - sums[start[lead]] if level else path[lead]
            here = depth[alive] + level
            real = depth[lead] + level < stop[lead]  # else it is the head of a container to come
            if level:
                yield from close(np.bincount(above, minlength=len(least))) or ()
            least, end = smallest, n[alive] == here
            is_least = rep[alive] == least[segment]
            if final:
                n_convs = np.add.reduceat(w[alive], first)
                tails = np.full(len(first), NOTHING, object)
                tails[segment[end]] = ends[alive[end]]
                before = real, {"conv_id": least, "depth": depth[lead] + level, "parent_conv_id": mother, "n_convs": n_convs,
                                "n_leaves": np.add.reduceat(leaves[alive], first),
                                "saved_tokens": np.add.reduceat(adds[alive], first) - col["pown"][alive[is_least]] - (n_convs - 1) * higher}, tails
            else:
                own = is_least & real[segment] & (least != mother)[segment]
                pown[alive[own]] = higher[segment[own]]
                end &= real[segment]
                before = alive[end], segment[end]
                on = ~real[segment]
                for name, values in (("to", least), ("to_up", mother), ("to_path", higher)):
                    to[name][alive[on]] = values[segment[on]]
            on = (n[alive] > here) & (here < stop[alive])
            alive, segment, level = alive[on], segment[on], level + 1
        yield from close(np.zeros(len(least), np.int64)) or ()
        if not final:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (rep, n, stop, pown, leaf, n >= stop, *to.values())], [c.split()[0] for c in PASS.split(", ")])
    return work


PASS = "rep long, n long, stop long, pown long, leaf boolean, goes boolean, to long, to_up long, to_path long"
NAMES = [c.split()[0] for c in NODES.split(", ")]


def _swept(rows: DataFrame, piece: int, limit: int, final: bool) -> DataFrame:
    columns = ["head", "depth", "up", "path", "rep", "n", "key", "chars", "at0"] + (["w", "total", "pown", "leaf", "ends"] if final else [])
    run = _whole_containers(_sweep(piece, final), limit)
    return rows.select(*columns).repartition("head").sortWithinPartitions("head", "key").mapInArrow(run, NODES if final else PASS)


def _chain(batches):
    """Nodes of classes that share no turn any more: every turn of a row is a node."""
    for batch in batches:
        col = {c: batch.column(c).to_numpy() for c in ("rep", "w", "n", "total", "start", "at0")}
        lists = batch.column("chars")
        k = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        chars = lists.flatten().to_numpy().astype(np.int64)
        row, first = np.repeat(np.arange(len(k)), k), np.cumsum(k) - k
        above = np.cumsum(chars) - chars
        above += (col["at0"] - above[np.minimum(first, max(len(chars) - 1, 0))] if len(chars) else col["at0"])[row]
        depth = col["start"][row] + np.arange(len(row)) - first[row] + 1
        end = depth == col["n"][row]
        ends = np.full(len(row), NOTHING, object)
        ends[end] = np.array(batch.column("ends").to_pylist(), dtype=object)[row[end]]
        rep, w = col["rep"][row], col["w"][row]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (rep, depth, rep, w, ~end + 0, np.ones(len(row), np.int64), (w - 1) * (col["total"][row] - above))]
            + [pa.array(ends, pa.string())], NAMES)


def _chars(k) -> Column:
    """Characters of the first k turns of ``chars``."""
    return F.aggregate(F.slice("chars", F.lit(1), k), F.lit(0).cast("long"), lambda a, x: a + x)


def _contained(members: DataFrame, piece: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """The members of a round, written with what becomes of their containers, and the heads."""
    heads = base.written(members.groupBy("head").agg(
        F.first("frm").alias("frm"), F.count("*").alias("m"), F.sum(F.size("chars")).alias("turns"), F.min("rep").alias("least")), "heads")
    mode = F.when(F.col("m") == 1, "chain").when(F.col("turns") > limit, "burst").otherwise("sweep")
    heads = heads.withColumn("mode", mode)
    # What all suffixes of a container begin with is what its first and last one in order share.
    ends = members.join(heads.where("mode = 'burst'").select("head"), "head", "left_semi").groupBy("head").agg(
        F.min("key").alias("lo"), F.max("key").alias("hi"))
    most = F.least(F.length("lo"), F.length("hi")) / WIDTH
    same = F.filter(F.sequence(F.lit(1), most.cast("int")), lambda k: F.substring("lo", 1, k * WIDTH) == F.substring("hi", 1, k * WIDTH))
    ends = ends.select("head", F.when(most >= 1, F.size(same)).otherwise(0).alias("lcp"))
    to_stop = F.lit(piece - 1) - F.col("depth") % piece
    rows = members.join(heads.select("head", "mode", "least"), "head").join(ends, "head", "left")
    return base.written(rows.withColumn("lcp", F.least("lcp", to_stop).cast("int")), "containers"), heads


def _suffixes(rows: DataFrame, laid: DataFrame, piece: int) -> DataFrame:
    """Members whose head ends a piece, with their turns in the next one."""
    own = laid.select(F.col("conv").alias("rep"), (F.col("j") * piece).alias("depth"), "key", "chars", F.col("before").alias("at0"))
    end = laid.where("j = 0").select(F.col("conv").alias("rep"), "total")
    return rows.join(own, ["rep", "depth"], "left").join(end, "rep").select(
        "head", "frm", "depth", "up", "path", "rep", "n", F.coalesce("key", F.lit("")).alias("key"),
        F.coalesce("chars", F.array().cast("array<int>")).alias("chars"), F.coalesce("at0", "total").alias("at0"))


def trie(sequences: DataFrame, piece: int = 1024, limit: int = 4096) -> DataFrame:
    """The nodes of the prefix trie over (conv, pos, tid, chars): a row per turn, pos counts from 0, and a row of pos -1 per conversation.

    Returns conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens
    (of the subtree: each node's further members times its last turn's characters) and ends_sha256 (of the ids that end here).
    Neither ``piece`` nor ``limit`` changes a result.  No conversation, no node.
    """
    laid = pieces(sequences, piece)
    every = classes(laid)
    null = F.lit(None)
    members = base.written(laid.where("j = 0").join(every.select("rep"), F.col("conv") == F.col("rep")).select(
        F.lit("").alias("head"), null.cast("string").alias("frm"), F.lit(0).cast("long").alias("depth"), F.lit(base.NO_ID).alias("up"),
        F.lit(0).cast("long").alias("path"), "rep", "n", "key", "chars", F.lit(0).cast("long").alias("at0")), "members")
    rounds, kids, owners = [], [], []
    while not members.isEmpty():
        rows, heads = _contained(members, piece, limit)
        rounds.append(rows)
        kids.append(heads.where("frm IS NOT NULL").groupBy("frm").agg(F.count("*").alias("n_children")))
        owners.append(rows.where("mode = 'chain' OR (mode = 'burst' AND rep = least)").select(
            "rep", F.when(F.col("least") != F.col("up"), F.col("path")).otherwise(-1).alias("pown"), (F.col("mode") == "chain").alias("leaf")))
        swept = base.written(_swept(rows.where("mode = 'sweep'"), piece, limit, False), "swept")
        owners.append(swept.select("rep", "pown", "leaf"))
        lcp, k = F.col("lcp"), F.col("lcp") + 1
        on = rows.where("mode = 'burst' AND n > depth + lcp").select(
            digest(F.col("head"), F.substring("key", lcp * WIDTH + 1, F.lit(WIDTH))).alias("head"), F.col("head").alias("frm"),
            (F.col("depth") + k).alias("depth"), F.col("least").alias("up"), (F.col("at0") + _chars(lcp)).alias("path"), "rep", "n",
            F.substring("key", k * WIDTH + 1, F.length("key")).alias("key"),
            F.slice("chars", k + 1, F.greatest(F.size("chars"), F.lit(1))).alias("chars"), (F.col("at0") + _chars(k)).alias("at0"))
        passed = swept.where("goes").select(
            F.concat_ws(":", "to", "stop").alias("head"), null.cast("string").alias("frm"), F.col("stop").alias("depth"),
            F.col("to_up").alias("up"), F.col("to_path").alias("path"), "rep", "n")
        ended = on.where(F.col("depth") % piece == 0).select("head", "frm", "depth", "up", "path", "rep", "n")
        members = base.written(on.where(F.col("depth") % piece != 0).unionByName(
            _suffixes(ended.unionByName(passed), laid, piece)), "members")
    if not rounds:
        return sequences.sparkSession.createDataFrame([], NODES)
    found = reduce(DataFrame.unionByName, owners).groupBy("rep").agg(F.max("pown").alias("pown"), F.max("leaf").alias("leaf"))
    # A class that owns no node and ends where a burst deals the others on is in none of these.
    info = base.written(every.join(found, "rep", "left").withColumns({
        "pown": F.when(F.col("pown") >= 0, F.col("pown")).otherwise(F.col("total")), "leaf": F.coalesce("leaf", F.lit(False))}), "owners")
    rows = reduce(DataFrame.unionByName, rounds).join(info.drop("n"), "rep")
    return reduce(DataFrame.unionByName, [
        _swept(rows.where("mode = 'sweep'"), piece, limit, True), *_chains(rows.where("mode = 'chain'"), laid, piece),
        _bursts(rows.where("mode = 'burst'"), reduce(DataFrame.unionByName, kids))])


def _parent() -> Column:
    return F.nullif("up", F.lit(base.NO_ID)).alias("parent_conv_id")


def _chains(rows: DataFrame, laid: DataFrame, piece: int) -> list[DataFrame]:
    top = rows.select(
        F.col("rep").alias("conv_id"), "depth", _parent(), F.col("w").alias("n_convs"),
        (F.col("n") > F.col("depth")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("w") - 1) * (F.col("total") - F.col("path"))).alias("saved_tokens"),
        F.when(F.col("n") == F.col("depth"), F.col("ends")).otherwise(NOTHING).alias("ends_sha256"))
    names = ["rep", "w", "n", "total", "ends", "start", "at0", "chars"]
    own = rows.withColumn("start", F.col("depth")).select(names)
    stop = (F.expr(f"depth div {piece}") + 1) * piece
    later = laid.select(F.col("conv").alias("rep"), (F.col("j") * piece).alias("start"), F.col("before").alias("at0"), "chars").where("start > 0")
    later = rows.where(F.col("n") > stop).select("rep", "w", "n", "total", "ends", stop.alias("stop")).join(later, "rep").where("start >= stop")
    return [top, own.unionByName(later.select(names)).mapInArrow(_chain, NODES)]


def _bursts(rows: DataFrame, kids: DataFrame) -> DataFrame:
    """The path of each burst container, from sums over its members that combine before the shuffle."""
    sums = rows.groupBy("head").agg(
        F.sum("w").alias("n_convs"), F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.sum((F.col("w") - 1) * F.col("total") + F.when(F.col("rep") != F.col("least"), F.col("pown")).otherwise(0)).alias("adds"))
    lead = rows.where("rep = least").select("head", "depth", "up", "path", "least", "lcp", "chars", "at0")
    tails = rows.where("n = depth + lcp").select("head", "ends")
    paths = sums.join(lead, "head").join(kids.withColumnRenamed("frm", "head"), "head").join(tails, "head", "left").withColumn(
        "k", F.explode(F.sequence(F.lit(0), "lcp")))
    last, higher = F.col("k") == F.col("lcp"), F.when(F.col("k") == 0, F.col("path")).otherwise(F.col("at0") + _chars(F.greatest(F.col("k") - 1, F.lit(0))))
    return paths.select(
        F.col("least").alias("conv_id"), (F.col("depth") + F.col("k")).alias("depth"),
        F.when(F.col("k") == 0, F.nullif("up", F.lit(base.NO_ID))).otherwise(F.col("least")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves",
        (F.col("adds") - (F.col("n_convs") - 1) * higher).alias("saved_tokens"),
        F.when(last, F.coalesce("ends", F.lit(NOTHING))).otherwise(NOTHING).alias("ends_sha256"))


def nodes(conversations: DataFrame, **settings) -> DataFrame:
    """The trie of the conversations as they are; ``conv_id`` is an integer.

    Turns go by ``turn``, a null one first; turns of one number go by a digest of role and text.  A null role or text is an empty one;
    equal rows are repeated turns; rows without a ``conv_id`` belong to no conversation.  A long text counts by its digest and
    length.  Other columns, whatever their names, are not read; an empty table has no nodes.
    """
    own = turns(conversations)
    bare = own.select("conv").distinct().select("conv", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("tid"), F.lit(0).alias("chars"))
    return trie(own.unionByName(bare), **settings)


def rebuilt_nodes(conversations: DataFrame, **settings) -> DataFrame:
    """The same of conversations that begin like the first one of their hundred (``rebuilt``)."""
    return trie(rebuilt(turns(conversations)), **settings)


def op11(spark, sf_dir):
    return rebuilt_nodes(base.table(spark, sf_dir, "conversations"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
