"""Substring dedup by hashed windows behind a filter of seeds.

A span is repeated when its ``length`` words also start earlier: in a document
with a smaller id, or in the same document at a smaller place.

* **Seeds.** Every window of ``length`` words picks one anchor, the ``seed``-word
  run with the smallest hash in it (winnowing).  The choice depends on the
  window's words alone, so equal windows pick equal anchors, and a window whose
  anchor occurs once in the corpus cannot repeat.  About one run in seven is an anchor.
* **Filter.** Anchor hashes are counted over all documents.  Those that
  occur again go into a bit map of fixed size (``map_bits``).  It only saves work:
  a false hit costs rows and changes no result, also when the map fills up.
* **Windows.** The windows that picked a repeated anchor are grouped by a 96-bit hash
  of all their words, each by itself; anchors are not joined and nothing is extended.
  Adjacent repeated windows cover what is removed (``maximal_repeats`` joins them).

A passage that many documents share costs one row per task and window: each task
keeps its earliest place of every window and settles the others at once, so no
group is larger than the number of tasks, and no pair of documents is formed.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from palisade.llm import base, words as W

#: Candidate windows that a task holds before it settles them.
FLUSH = 500_000


def _picked(hasher, block, length, seed):
    """Start of every window, and the hash of the anchor it picked."""
    words = hasher.words(block)
    fits = W.run_starts(block.first, length, len(words))
    if not fits.any():
        return words, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = hasher.runs(words, seed)
    views = np.lib.stride_tricks.sliding_window_view(grams, length - seed + 1)
    starts = np.flatnonzero(fits)
    at = starts + views[starts].argmin(axis=1)
    return words, starts, grams[at], at


def _anchor_counts(length, seed):
    def count(batches):
        hasher = W.Hasher()
        for batch in batches:
            for block in W.blocks(batch.column(0), W.SPACES):
                _, _, anchors, at = _picked(hasher, block, length, seed)
                once = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
                values, n = np.unique(anchors[once], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], ["anchor", "n"])
    return count


def repeated_anchors(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """Hashes of anchors that stand at two places or more."""
    counts = docs.select("text").mapInArrow(_anchor_counts(length, seed), "anchor long, n byte")
    return counts.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")


def anchor_map(anchors: DataFrame, map_bits: int) -> np.ndarray:
    """A bit map of 2**map_bits places, whatever the number of anchors is."""
    slot = F.shiftrightunsigned("anchor", 64 - map_bits) + 1
    chunks = (anchors.select(slot.alias("slot"))
              .groupBy(F.bitmap_bucket_number("slot").alias("chunk"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")))
    bits = np.zeros(2**map_bits // 8, np.uint8)
    for row in chunks.toLocalIterator():
        at = (row["chunk"] - 1) * 4096
        own = np.frombuffer(row["bits"], np.uint8)[:len(bits) - at]
        bits[at:at + len(own)] = own
    return bits


def _candidates(length, seed, map_bits, shared):
    shift = np.uint64(64 - map_bits)

    def settle(parts):
        """Earliest place of each window in this task goes on; the others are repeated for certain."""
        h, check, doc, tag, pos = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((pos, tag, doc, doc == base.NO_ID, check, h))  # null ids come last
        h, check, doc, tag, pos = h[order], check[order], doc[order], tag[order], pos[order]
        sure = np.zeros(len(h), bool)
        sure[1:] = (h[1:] == h[:-1]) & (check[1:] == check[:-1])
        # The same row read twice is one document, not a repeat of itself.
        same = np.zeros(len(h), bool)
        same[1:] = sure[1:] & (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (pos[1:] == pos[:-1])
        sure, h, check, doc, tag, pos = (x[~same] for x in (sure, h, check, doc, tag, pos))
        first = ~sure
        rows = [(h[first], check[first], doc[first], tag[first], pos[first], np.ones(first.sum(), np.int32), ~first[first])]
        if sure.any():
            doc, tag, pos = doc[sure], tag[sure], pos[sure]
            order = np.lexsort((pos, tag, doc))
            doc, tag, pos = doc[order], tag[order], pos[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (pos[1:] != pos[:-1] + 1)
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(doc))).astype(np.int32)
            doc, tag, pos = doc[at], tag[at], pos[at]
            spread = W.mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pos.astype(np.uint64))
            rows.append((spread, np.zeros(len(doc), np.int32), doc, tag, pos, n, np.ones(len(doc), bool)))
        for h, check, doc, tag, pos, n, sure in rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(check), pa.array(doc), pa.array(tag), pa.array(pos), pa.array(n),
                 pa.array(sure)], ["h", "check", "doc", "tag", "pos", "n", "sure"])

    def find(batches):
        hasher, second, bits = W.Hasher(), W.Hasher(1), shared.value
        parts, held = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            tags = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
            for block in W.blocks(batch.column(2), W.SPACES):
                words, starts, anchors, _ = _picked(hasher, block, length, seed)
                slot = (anchors >> shift).astype(np.int64)
                starts = starts[(bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0]
                if not len(starts):
                    continue
                row = np.searchsorted(block.first, starts, "right") - 1
                at = block.rows[row]
                parts.append((hasher.runs(words, length)[starts],
                              second.runs(words, length)[starts].astype(np.uint32).view(np.int32),
                              ids[at], tags[at], (starts - block.first[row]).astype(np.int32)))
                held += len(starts)
                if held >= FLUSH:
                    yield from settle(parts)
                    parts, held = [], 0
        if parts:
            yield from settle(parts)
    return find


def repeated_windows(docs: DataFrame, length: int = 20, seed: int = 8, map_bits: int = 28) -> DataFrame:
    """Runs of windows (doc, tag, pos, n) whose words start earlier: n windows, the first at word pos.

    ``docs`` has key ``doc`` (long), ``tag`` (int) and ``text``; the tag tells rows of one id apart.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(anchor_map(repeated_anchors(docs, length, seed), map_bits))
    rows = docs.select("doc", "tag", "text").mapInArrow(
        _candidates(length, seed, map_bits, shared), "h long, check int, doc long, tag int, pos int, n int, sure boolean")
    # At most one row per task, window and id stands in a group.
    order = Window.partitionBy("h", "check").orderBy(F.col("doc") == base.NO_ID, "doc", "tag", "pos")
    place = F.dense_rank().over(order)
    return rows.withColumn("_place", place).where("sure or _place > 1").select("doc", "tag", "pos", "n")


def _covered(n_words, spans, length):
    edge = np.zeros(n_words + 1, np.int32)
    if len(spans):
        s = np.asarray(spans, np.int64).reshape(-1, 2)
        np.add.at(edge, s[:, 0], 1)
        np.add.at(edge, np.minimum(s[:, 0] + s[:, 1] + length - 1, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


def maximal_repeats(docs: DataFrame, length: int = 20, **settings) -> DataFrame:
    """Maximal repeated spans: doc_id, start, n_words (more than ``length`` where windows join)."""
    runs = repeated_windows(keyed(docs), length, **settings)
    order = Window.partitionBy("doc", "tag").orderBy("pos")
    reach = F.max(F.col("pos") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(F.col("pos") <= F.coalesce(reach, F.lit(-1)), 0).otherwise(1)).over(order)
    # `pos <= reach`: the next window starts where the last one did or one word on.
    spans = runs.withColumn("_part", part).groupBy("doc", "tag", "_part").agg(
        F.min("pos").alias("start"), F.max(F.col("pos") + F.col("n")).alias("_end"))
    return spans.select(F.nullif("doc", F.lit(base.NO_ID)).alias("doc_id"), "start",
                        (F.col("_end") - F.col("start") + length - 1).alias("n_words"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc, tag and text.  The tag (a checksum of the text) tells rows of one id apart; without such rows it is 0 throughout,
    which changes no result and spares each window's row four bytes."""
    own = docs.select(base.id_key().alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    repeated = own.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    tag = (F.crc32(F.col("text").cast("binary")) - 2**31).cast("int") if repeated else F.lit(0)
    return own.select("doc", tag.alias("tag"), "text")


def _cut(length):
    def cut(batches):
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            out = []
            spans = batch.column(2)
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = text.encode().split()
                keep = own
                if spans[i].is_valid:
                    gone = _covered(len(own), [(s["pos"], s["n"]) for s in spans[i].as_py()], length)
                    keep = [w for w, g in zip(own, gone.tolist()) if not g]
                out.append((len(own), len(own) - len(keep), b" ".join(keep)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                 pa.array([o[2].decode() for o in out], pa.large_string()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"])
    return cut


def remove_repeats(docs: DataFrame, length: int = 20, **settings) -> DataFrame:
    """Every row with the words that stay: doc_id, n_words, n_removed, kept.

    Only ``doc_id`` and ``text`` are read.  A null or empty text has no words.  Equal rows are one document and
    get the same result; rows of one id with other texts are told apart; a null id comes after all others.  Words are
    runs of anything but ASCII white space; a text under ``length`` words is never touched.  Long texts are read whole; an empty
    table gives an empty one.
    """
    own = keyed(base.only(docs, "doc_id", "text"))
    spans = repeated_windows(own, length, **settings).groupBy("doc", "tag").agg(
        F.collect_list(F.struct("pos", "n")).alias("spans"))
    joined = own.join(spans, ["doc", "tag"], "left").select(
        F.nullif("doc", F.lit(base.NO_ID)).alias("doc_id"), "text", "spans")
    return joined.mapInArrow(_cut(length), "doc_id long, n_words long, n_removed long, kept string")


def op10(spark, sf_dir):
    kept = remove_repeats(base.table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
