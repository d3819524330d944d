"""SimHash near-dedup with BK-trees.

Fingerprints of whole texts; equal ones are one node.  Two nodes link when they
differ in at most ``radius`` bits, and a document's component is what links reach.

The 64 bits are cut into ``radius + 2`` blocks.  Two fingerprints within the radius
agree on at least two of them, so nodes meet in one bucket for each pair of
blocks (15 at radius 4, of about 21 bits each) and no other pairs need a look.  A
bucket is dealt into shards of about ``shard`` nodes; each shard becomes a BK-tree
(children keyed by their integer distance to the parent), which is sent to the
queries of every shard of its bucket and followed only along edges within the radius.
A task holds two shards, whatever the size of the bucket.

Components need not every link: a subtree that is already one component with
the query is not entered.  That skips no link between different components.
"""

from __future__ import annotations

import itertools
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from palisade.llm import base, graph, words as W
from palisade.llm.substring_dedup import anchor_map

SEED = 42


def _joined(block) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a block with one space behind each, and their new places."""
    lengths = block.ends - block.starts
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    out[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)] = block.data[
        np.arange(int(lengths.sum())) + np.repeat(block.starts - (starts - np.arange(len(lengths))), lengths)]
    return out.tobytes(), starts, ends


def block_fingerprints(block, size: int) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text of a block."""
    n = np.diff(block.first)
    prints = np.zeros(len(n), np.uint64)
    has = np.flatnonzero(n)
    if not len(has):
        return prints
    text, starts, ends = _joined(block)
    count = np.maximum(n[has] - size + 1, 1)
    edge = np.concatenate([[0], np.cumsum(count)])
    a = np.repeat(block.first[has], count) + np.arange(edge[-1]) - np.repeat(edge[:-1], count)
    b = np.minimum(a + size, np.repeat(block.first[has + 1], count)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[x:y], SEED) for x, y in zip(starts[a].tolist(), ends[b].tolist())), np.uint64, len(a))
    step = 1 << 17
    ones = np.zeros((len(has), 64), np.int64)
    for at in range(0, len(hashes), step):
        part = np.unpackbits(hashes[at:at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lo, hi = np.searchsorted(edge, at, "right") - 1, np.searchsorted(edge, at + len(part), "left")
        cuts = np.maximum(edge[lo:hi] - at, 0)
        ones[lo:hi] += np.add.reduceat(part, cuts, axis=0, dtype=np.int64)
    bits = ones * 2 > count[:, None]
    prints[has] = np.packbits(bits, axis=1, bitorder="little").reshape(-1).view(np.uint64)
    return prints


def _print_rows(size):
    def run(batches):
        for batch in batches:
            parts = [block_fingerprints(b, size) for b in W.blocks(batch.column(batch.num_columns - 1), W.SPACES, lower=True)]
            prints = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))],
                                             [*batch.schema.names[:-1], "fp"])
    return run


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, tag (a hash of the text) and fp, the fingerprint's bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text").mapInArrow(
        _print_rows(size), "doc_id long, tag long, fp long")


class BKTree:
    """Fingerprints of one shard, each with a key.  ``sets`` is told of each link found and names a key's component."""

    def __init__(self, radius: int, accept=None):
        self.radius, self.accept = radius, accept
        self.values: list[int] = []
        self.keys: list = []
        self.children: list[dict[int, int]] = []
        self.uniform: list[bool] = []

    def link(self, value: int, key, sets: Sets) -> None:
        if not self.values:
            return
        stack, radius = [0], self.radius
        while stack:
            at = stack.pop()
            here, same = self.keys[at], sets.root(self.keys[at]) == sets.root(key)
            if same and self.uniform[at]:
                continue
            d = (self.values[at] ^ value).bit_count()
            if d <= radius and not same and (self.accept is None or self.accept(here, key)):
                sets.union(here, key)
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)

    def insert(self, value: int, key, sets: Sets) -> None:
        new = len(self.values)
        self.values.append(value)
        self.keys.append(key)
        self.children.append({})
        self.uniform.append(True)
        at, mine = 0, sets.root(key)
        while at != new:
            if self.uniform[at] and sets.root(self.keys[at]) != mine:
                self.uniform[at] = False
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), new)


class Sets:
    """Disjoint sets; keeps the links that joined two of them."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    def union(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((a, b))


def shard_links(tree_values, query_values, radius: int, accept=None) -> list[tuple]:
    """Links that span the components of a shard's (fingerprint, key) pairs, and between them and the queries."""
    tree, sets = BKTree(radius, accept), Sets()
    for value, key in tree_values:
        if query_values is None:
            tree.link(value, key, sets)
        tree.insert(value, key, sets)
    for value, key in query_values or ():
        tree.link(value, key, sets)
    return sets.links


def _bucket_links(radius, similarity=None):
    """Links of all buckets of a partition, from rows (key, i, j, shard, node, fp, shingles) sorted by the first four."""
    def links(rows):
        cut = [0, *(k for k in range(1, len(rows)) if rows[k][:3] != rows[k - 1][:3]), len(rows)]
        for lo, hi in zip(cut, cut[1:]):
            own, (_, i, j) = rows[lo:hi], rows[lo][:3]
            if hi - lo < 2:
                continue
            accept = None
            if similarity is not None:
                sets = {r[4]: np.frombuffer(r[6], np.uint32) for r in own}
                accept = lambda a, b, sets=sets: _alike(sets[a], sets[b], similarity)
            pairs = [(r[5] % 2**64, r[4]) for r in own]
            n = sum(r[3] == i for r in own)
            yield from shard_links(pairs if i == j else pairs[:n], None if i == j else pairs[n:], radius, accept)

    def run(batches):
        held: list[tuple] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held += list(zip(*[c.to_pylist() for c in batch.columns]))
            to = len(held)
            while batch is not None and to and held[to - 1][:3] == held[-1][:3]:
                to -= 1
            if to:
                found = list(links(held[:to]))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
                held = held[to:]
    return run


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Are two sorted sets alike by the similarity or more?"""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < similarity * len(b):
        return False
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common >= similarity * (len(a) + len(b) - common)


def _bucket_keys(radius: int):
    """One key per pair of blocks: the pair's number and the bits of both blocks."""
    blocks = radius + 2
    edges = [64 * k // blocks for k in range(blocks + 1)]
    part = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
    width = max(b - a for a, b in zip(edges, edges[1:]))
    return F.array(*[F.shiftleft(F.lit(n).cast("long"), 2 * width) + F.shiftleft(part[i], width) + part[j]
                     for n, (i, j) in enumerate(itertools.combinations(range(blocks), 2))])


def _dealt(keyed: DataFrame, shard: int, *more: str) -> DataFrame:
    """(key, i, j, shard, node, *more): every pair of shards of every bucket with two nodes or more, from (key, node, *more)."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(
        "key", F.ceil(F.col("n") / shard).cast("long").alias("shards"))
    dealt = keyed.join(sizes, "key").withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    return pairs.select("key", F.least("shard", "other").alias("i"), F.greatest("shard", "other").alias("j"), "shard", "node", *more)


def _linked(tasks: DataFrame, radius: int, similarity: float | None = None) -> DataFrame:
    tasks = tasks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "shard", "node")
    return tasks.mapInArrow(_bucket_links(radius, similarity), "a long, b long").distinct()


def links(nodes: DataFrame, radius: int = 4, shard: int = 2000) -> DataFrame:
    """Spanning links (a, b) between different fingerprints ``fp``, each of which stands once in ``nodes``."""
    keyed = nodes.select(F.col("fp").alias("node"), F.explode(_bucket_keys(radius)).alias("key"))
    return _linked(_dealt(keyed, shard).withColumn("fp", F.col("node")), radius)


def grouped(docs: DataFrame, size: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, tag, fp, root, component_id for every row; component_id is the smallest id of the component root.

    Only ``doc_id`` and ``text`` are read.  Null and empty texts have fingerprint zero and link like any other; null
    ids are grouped but never name a component (a component of nothing but null ids has a null name).  Repeated rows stay
    and share a component.  Texts are read whole, however long; an empty table gives an empty one.
    """
    prints = base.written(fingerprints(base.only(docs, "doc_id", "text"), size), "fingerprints")
    nodes = base.written(prints.groupBy("fp").agg(F.min("doc_id").alias("doc")), "nodes")
    roots = graph.components(links(nodes.select("fp"), radius))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "doc", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp", "left").select("doc_id", "tag", "fp", "root", "component_id")


# Near-duplicates by similarity.  Texts of a shingle similarity of 0.8 are some 9 of 64 bits apart, too far for buckets of
# equal blocks; their shards come from bands of minima of shingle hashes instead, and a link is verified on the shingles.
# Bands are chance, and so is the radius: what they leave apart meets again, without loss, through prefixes of the sets.

BANDS, ROWS = 12, 4
_FACTORS = np.random.default_rng(3).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def _shingles(hasher, block, size):
    """Hashes of all shingles of a block, in order of texts, and where each text's begin; a shorter text is one shingle."""
    words, n = hasher.words(block), np.diff(block.first)
    count = np.maximum(n - size + 1, 1)
    edge = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(edge[-1], np.uint64)
    long = np.flatnonzero(n >= size)
    if len(long):
        runs = hasher.runs(words, size)
        at = np.arange(int(count[long].sum())) + np.repeat(block.first[long] - np.concatenate([[0], np.cumsum(count[long])[:-1]]), count[long])
        out[np.repeat(n >= size, count)] = runs[at]
    for i in np.flatnonzero((n > 0) & (n < size)):
        out[edge[i]] = hasher.runs(words[block.first[i]:block.first[i + 1]], int(n[i]))[0]
    return out, edge


def _set_print(hashes: np.ndarray) -> int:
    """Fingerprint, as a signed number, of a set of shingles, each of which counts once."""
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def _band_rows(size):
    def run(batches):
        hasher = W.Hasher(21)
        for batch in batches:
            for block in W.blocks(batch.column(1), W.SPACES, lower=True, block_bytes=1_000_000):
                hashes, edge = _shingles(hasher, block, size)
                least = np.stack([np.minimum.reduceat(hashes * f, edge[:-1]) for f in _FACTORS], axis=1)
                keys = np.zeros((len(block), BANDS), np.uint64)
                for k in range(BANDS):
                    for r in range(ROWS):
                        keys[:, k] = W.mix(keys[:, k] * np.uint64(0x9E3779B97F4A7C15) + least[:, k * ROWS + r] + np.uint64(k + 1))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(block) * BANDS + 1, BANDS), pa.int32()),
                                                 pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(block.rows)), bands], ["node", "bands"])
    return run


def _shingle_counts(size, slot_bits):
    """Shingles of a task by the first bits of their hashes: (slot, n)."""
    def run(batches):
        hasher, total, shift = W.Hasher(21), np.zeros(1 << slot_bits, np.int64), np.uint64(64 - slot_bits)
        for batch in batches:
            for block in W.blocks(batch.column(0), W.SPACES, lower=True, block_bytes=1_000_000):
                slots, n = np.unique(_shingles(hasher, block, size)[0] >> shift, return_counts=True)
                total[slots.astype(np.int64)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "n"])
    return run


def _prefix_rows(size, similarity, slot_bits, shared):
    """The shingles of each text's prefix: (node, key, n, left), n shingles in its set, left from this one on in the order."""
    def run(batches):
        hasher, counts, shift = W.Hasher(21), shared.value, np.uint64(64 - slot_bits)
        for batch in batches:
            for block in W.blocks(batch.column(1), W.SPACES, lower=True, block_bytes=1_000_000):
                hashes, edge = _shingles(hasher, block, size)
                keys, sizes, lefts, nodes = [], [], [], []
                for i, (a, b) in enumerate(zip(edge, edge[1:])):
                    own = np.unique(hashes[a:b])
                    often = counts[(own >> shift).astype(np.int64)]
                    n = len(own)
                    first = np.lexsort((own, often))[:n - int(np.ceil(similarity * n - 1e-9)) + 1]
                    left = n - np.arange(len(first))
                    more = often[first] > 1  # what occurs once meets nothing
                    keys.append(own[first][more])
                    lefts.append(left[more])
                    sizes.append(np.full(len(keys[-1]), n))
                    nodes.append(np.full(len(keys[-1]), i))
                row = np.concatenate(nodes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(block.rows[row])), pa.array(np.concatenate(keys).view(np.int64)),
                     pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(lefts).astype(np.int32))],
                    ["node", "key", "n", "left"])
    return run


def _verified(similarity):
    def run(batches):
        for batch in batches:
            sets = [[np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3)]
            yield batch.select([0, 1]).filter(pa.array([_alike(a, b, similarity) for a, b in zip(*sets)], pa.bool_()))
    return run


def _left_apart(own: DataFrame, roots: DataFrame, size: int, similarity: float, shard: int, map_bits: int, slot_bits: int = 20) -> DataFrame:
    """All links (a, b) between texts that ``roots`` (node, root) has in different components; none is missed.

    All shingles stand in one order: by how many shingles share their slot of a table of fixed size, then by hash.  Sets
    alike by the similarity or more share one of the first n - ceil(similarity * n) + 1 shingles of both; from the first
    they share, enough must be left on either side.  Any order finds all pairs; this one keeps buckets small.
    """
    spark = own.sparkSession
    counts = np.zeros(1 << slot_bits, np.int64)
    slots = own.select("text").mapInArrow(_shingle_counts(size, slot_bits), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts[slots["slot"].to_numpy()] = slots["n"].to_numpy()
    table = spark.sparkContext.broadcast(counts)
    keyed = base.written(own.select("tag", "text").mapInArrow(
        _prefix_rows(size, similarity, slot_bits, table), "node long, key long, n int, left int").distinct(), "prefixes")
    rooted = keyed.join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select(
        "key", "node", F.coalesce("root", "node").alias("root"), "n", "left")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    dealt = base.written(_dealt(rooted.join(mixed, "key"), shard, "root", "n", "left"), "apart")
    sides = ["key", "i", "j"]
    a = dealt.where("shard = i").select(*sides, F.struct("node", "root", "n", "left").alias("a"))
    b = dealt.where("shard = j").select(*sides, F.struct("node", "root", "n", "left").alias("b"))
    enough = F.least("a.left", "b.left") >= similarity / (1 + similarity) * (F.col("a.n") + F.col("b.n")) - 1e-9
    pairs = base.written(a.join(b, sides).where((F.col("a.root") != F.col("b.root")) & enough).select(
        F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct(), "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("anchor"))
    bits = spark.sparkContext.broadcast(anchor_map(nodes, map_bits))
    sets = own.select("tag", "text").mapInArrow(
        _shingle_rows(size, map_bits, bits, np.uint64), "node long, fp long, shingles binary").groupBy("node").agg(F.first("shingles").alias("s"))
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(_verified(similarity), "a long, b long")


def _shingle_rows(size, map_bits, shared, kind=np.uint32):
    def run(batches):
        hasher, bits, shift = W.Hasher(21), shared.value, np.uint64(64 - map_bits)
        for batch in batches:
            slot = (batch.column(0).to_numpy().view(np.uint64) >> shift).astype(np.int64)
            batch = batch.filter(pa.array((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0))
            for block in W.blocks(batch.column(1), W.SPACES, lower=True, block_bytes=1_000_000):
                hashes, edge = _shingles(hasher, block, size)
                sets = [np.unique(hashes[a:b]) for a, b in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(block.rows)), pa.array([_set_print(own) for own in sets], pa.int64()),
                     pa.array([np.unique(own.astype(kind)).tobytes() for own in sets], pa.binary())], ["node", "fp", "shingles"])
    return run


def similar(docs: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = 24, shard: int = 2000, map_bits: int = 24) -> DataFrame:
    """doc_id, tag, root for every row: texts whose ``size``-word shingle sets are alike by ``similarity`` or more share a root.

    Equal texts are one node.  Nodes meet in a bucket if one of 12 bands of four shingle minima is equal (at a
    similarity of 0.8, 998 pairs in 1,000 do), then in a BK-tree within ``radius`` bits (sets that alike are some 9 bits
    apart, very small ones further), and link if their whole shingle sets are alike.  That joins most of what is alike; the
    rest, whatever its bands and bits, is found among different components by ``_left_apart``.  Only texts that meet another are read a second time, found by a bit map of fixed size, whose false
    hits the join behind it drops.  Texts without words are one node's worth of equal sets.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs["text"], F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    bands = own.select("tag", "text").mapInArrow(_band_rows(size), "node long, bands array<long>")
    keyed = base.written(bands.select("node", F.explode("bands").alias("key")).distinct(), "bands")
    dealt = base.written(_dealt(keyed, shard), "dealt")
    shared = spark.sparkContext.broadcast(anchor_map(dealt.select(F.col("node").alias("anchor")), map_bits))
    read = own.select("tag", "text").mapInArrow(_shingle_rows(size, map_bits, shared), "node long, fp long, shingles binary")
    sets = read.groupBy("node").agg(F.first("fp").alias("fp"), F.first("shingles").alias("shingles"))
    tasks = dealt.join(sets, "node").select("key", "i", "j", "shard", "node", "fp", "shingles")
    roots = graph.components(_linked(tasks, radius, similarity))
    more = _left_apart(own, roots, size, similarity, shard, map_bits)
    roots = graph.components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    rows = own.select("doc_id", "tag")
    return rows.join(roots, rows["tag"] == roots["node"], "left").select("doc_id", "tag", F.coalesce("root", "tag").alias("root"))


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents, all columns, with one row of each group of near-duplicates: that with the smallest id, equal rows once.

    A group of nothing but null ids keeps the row with the smallest text hash.  Texts are read whole; of an empty table none stays.
    """
    key, tag = base.unused(docs, "key", "tag")
    groups = similar(base.only(docs, "doc_id", "text"), size, similarity)
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), base.id_key().alias("id"), "tag")).alias("best"))
    rows = docs.withColumns({key: base.id_key(), tag: F.xxhash64(F.coalesce("text", F.lit("")))})
    winners = best.select(F.col("best.id").alias(key), F.col("best.tag").alias(tag)).distinct()
    return rows.join(winners, [key, tag], "left_semi").dropDuplicates([key, tag]).select(*docs.columns)


def op3(spark, sf_dir):
    return grouped(base.table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
