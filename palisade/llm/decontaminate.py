"""Benchmark decontamination with suffix arrays over the training documents.

A window is ``window`` consecutive words of a benchmark item; an item of fewer words, but not none, is one window.

* Each task deals its documents into shards of about ``SHARD_BYTES`` of text.  Stretches of a shard whose words all
  occur in the benchmark, and which are long enough for some window, make up its suffix array (ranks by
  prefix doubling); other words can't be part of a match.
* Every benchmark suffix is searched in every shard by bisection, all of them at once, down to its window.  The hits
  give places in documents and items; hits that follow one another on both sides are one longest verbatim match.
* The benchmark goes to the tasks in blocks of at most ``block_bytes`` of text, counted first; a larger benchmark
  takes several passes, whose hits add up before documents are judged.
"""

from __future__ import annotations

import sys
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from palisade.llm import base, words as W

SHARD_BYTES = 2_000_000


class TestIndex:
    """The windows of one block of benchmark items, as word numbers."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window, self.names = window, [name for name, _ in items]
        texts = pa.array([text or "" for _, text in items], pa.large_string())
        number: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], int] = {}
        self.owners: list[list[tuple[int, int]]] = []  # of a window: items and the places in them
        for block in W.blocks(texts, W.NON_WORD, lower=True):
            for i, row in enumerate(block.rows.tolist()):
                own = [number.setdefault(block.word(k), len(number) + 1) for k in range(block.first[i], block.first[i + 1])]
                size = min(window, len(own))
                for at in range(len(own) - size + 1 if size else 0):
                    w = windows.setdefault(tuple(own[at:at + size]), len(windows))
                    if w == len(self.owners):
                        self.owners.append([])
                    self.owners[w].append((row, at))
        self.sizes = np.array([len(w) for w in windows], np.int64)
        self.words = np.zeros((len(windows), window), np.int64)
        for w, k in windows.items():
            self.words[k, :len(w)] = w
        self.shortest = int(self.sizes.min()) if len(windows) else 0
        self.vocabulary = W.Vocabulary(list(number))

    def hits(self, block) -> tuple[np.ndarray, np.ndarray]:
        """Word places in the block, and the window that starts at each."""
        numbers = self.vocabulary.numbers(block)
        stop = np.zeros(len(numbers) + 1, bool)
        stop[block.first] = True  # a stretch ends with its text
        new = (numbers > 0) & np.concatenate([[True], (numbers[:-1] == 0) | stop[1:-1]])[:len(numbers)]
        starts = np.flatnonzero(new)
        if not len(starts):
            return starts, starts
        last = np.flatnonzero((numbers > 0) & np.append((numbers[1:] == 0) | stop[1:-1], True))
        long = last - starts + 1 >= self.shortest
        starts, sizes = starts[long], (last - starts + 1)[long]
        if not len(starts):
            return starts, starts
        ends = np.cumsum(sizes + 1)
        text = np.zeros(int(ends[-1]) + self.window, np.int64)
        place = np.zeros(len(text), np.int64)
        to = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)
        place[to] = np.arange(int(sizes.sum())) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        text[to] = numbers[place[to]]
        return self._search(text, place, suffix_array(text, self.window))

    def _search(self, text, place, suffixes):
        low, high = self._bound(text, suffixes, False), self._bound(text, suffixes, True)
        n = high - low
        window = np.repeat(np.arange(len(n)), n)
        at = np.arange(int(n.sum())) + np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        return place[suffixes[at]], window

    def _bound(self, text, suffixes, after: bool) -> np.ndarray:
        """Where each window would go into the suffix array, before or after the suffixes that start with it."""
        low, high = np.zeros(len(self.sizes), np.int64), np.full(len(self.sizes), len(suffixes), np.int64)
        while (open_ := low < high).any():
            mid = (low + high) // 2
            start = suffixes[np.minimum(mid, len(suffixes) - 1)]
            sign = np.zeros(len(mid), np.int64)
            for k in range(self.window):
                step = np.sign(text[start + k] - self.words[:, k])
                sign = np.where((sign == 0) & (k < self.sizes), step, sign)
            right = (sign <= 0 if after else sign < 0) & open_
            low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
        return low


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` (which ends in ``depth`` zeros) in the order of the ``depth`` or more numbers from each."""
    rank, step = text, 1
    while step < depth:
        ahead = np.zeros_like(rank)
        ahead[:-step] = rank[step:]
        rank = np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)[1]
        step *= 2
    return np.argsort(rank[:len(text) - depth], kind="stable")


def _found(index: TestIndex, block):
    """Per text with hits: its number in the block and [(item, place in the text, place in the item, words)]."""
    at, window = index.hits(block)
    row = np.searchsorted(block.first, at, "right") - 1
    runs: dict[int, dict] = defaultdict(dict)
    order = np.argsort(at, kind="stable")
    for r, p, w in zip(row[order].tolist(), (at - block.first[row])[order].tolist(), window[order].tolist()):
        size, own = int(index.sizes[w]), runs[r]
        for item, place in index.owners[w]:
            run = own.get((item, p - place))
            if run and run[-1][0] + run[-1][2] >= p + size - 1:
                run[-1][2] = p + size - run[-1][0]
            else:
                own.setdefault((item, p - place), []).append([p, place, size])
    return {r: [(item, *match) for (item, _), found in own.items() for match in found] for r, own in runs.items()}


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks_of(benchmark: DataFrame, block_bytes: int):
    """Different items (name, text) in blocks of about ``block_bytes``, each read only when its turn comes."""
    own = base.only(benchmark, "item_id", "text").select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(-(-total // block_bytes)) or 1
    for k in range(n):
        part = own.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k) if n > 1 else own
        yield k == n - 1, [(r["name"], r["text"]) for r in part.toLocalIterator()]


SPANS = "array<struct<a:int,b:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _collect(shared):
    def run(batches):
        index = shared.value
        for batch in batches:
            spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            n_words, longest = batch.column("n_words").to_pylist(), batch.column("longest").to_pylist()
            for block in W.blocks(batch.column("text"), W.NON_WORD, lower=True, block_bytes=SHARD_BYTES):
                for row, n in zip(block.rows.tolist(), np.diff(block.first).tolist()):
                    n_words[row] = n
                for r, found in _found(index, block).items():
                    row = int(block.rows[r])
                    spans[row] = [{"a": a, "b": b} for a, b in _merge(
                        [(s["a"], s["b"]) for s in spans[row]] + [(p, p + n) for _, p, _, n in found])]
                    items[row] = sorted({*items[row], *(index.names[m[0]] for m in found)})
                    longest[row] = max(longest[row], *(m[3] for m in found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(spans, _SPAN_TYPE),
                 pa.array(items, pa.list_(pa.string())), pa.array(n_words, pa.int64()), pa.array(longest, pa.int64())],
                ["doc_id", "text", "spans", "items", "n_words", "longest"])
    return run


def judged(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 16_000_000) -> DataFrame:
    """doc_id, n_words, spans (word ranges inside windows), items (names, sorted), longest for every row.

    Only ``doc_id`` and ``text``, and ``item_id`` and ``text`` of the benchmark, are read; whole texts, however long.
    A null or empty text has no words, and as an item no window.  A null item id is an item named by the empty text;
    items of one id count once.  Equal rows get equal results.
    No document gives no row; without items nothing is hit.
    """
    spark = docs.sparkSession
    out = base.only(docs, "doc_id", "text").select(
        "doc_id", "text", F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"),
        F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("longest"))
    for last, items in _blocks_of(benchmark, block_bytes):
        out = out.mapInArrow(_collect(spark.sparkContext.broadcast(TestIndex(items, window))), out.schema)
        out = out if last else base.written(out, "hits")
    return out.drop("text")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 16_000_000) -> DataFrame:
    """Longest verbatim matches of ``window`` words or more (or of a whole shorter item) and where they stand."""
    def locate(shared):
        def run(batches):
            index = shared.value
            for batch in batches:
                ids = batch.column(0)
                for block in W.blocks(batch.column(1), W.NON_WORD, lower=True, block_bytes=SHARD_BYTES):
                    rows = [(int(block.rows[r]), index.names[i], p, q, n)
                            for r, found in _found(index, block).items() for i, p, q, n in found]
                    cols = list(zip(*rows)) or [()] * 5
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()),
                         *[pa.array(c, pa.int64()) for c in cols[2:]]], ["doc_id", "item_id", "start", "item_start", "n_words"])
        return run
    parts = None
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for last, items in _blocks_of(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(TestIndex(items, window))
        found = own.mapInArrow(locate(shared), "doc_id long, item_id string, start long, item_start long, n_words long")
        if not last:
            found = base.written(found, "matches")
            shared.destroy()
        parts = found if parts is None else parts.unionByName(found)
    return parts


def _clean(shared, text, hit=False):
    """The rows without a window, or (``hit``) those with one."""
    def run(batches):
        index = shared.value
        for batch in batches:
            keep = np.full(batch.num_rows, not hit)
            for block in W.blocks(batch.column(text), W.NON_WORD, lower=True, block_bytes=SHARD_BYTES):
                at, _ = index.hits(block)
                keep[block.rows[np.unique(np.searchsorted(block.first, at, "right") - 1)]] = hit
            yield batch.filter(pa.array(keep))
    return run


def _text_key(text):
    """96 bits of a text by which verdicts meet documents."""
    return F.xxhash64(text), F.hash(text)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 16_000_000) -> DataFrame:
    """The documents, all columns, without those that hold a window.

    A benchmark of one block filters where the documents are read.  Of several blocks one is sent at a time: the hashes of the texts
    it hits are written and it is released, and documents meet those hashes at the end; their text is never shuffled before that.
    """
    spark, hits = docs.sparkSession, None
    own = base.only(docs, "text")
    for last, items in _blocks_of(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(TestIndex(items, window))
        if last:
            docs = docs.mapInArrow(_clean(shared, docs.columns.index("text")), docs.schema)
        else:
            found = own.mapInArrow(_clean(shared, 0, True), "text string")
            found = base.written(found.select(*[k.alias(n) for k, n in zip(_text_key("text"), ("_a", "_b"))]).distinct(), "hits")
            shared.destroy()
            hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return docs
    names = base.unused(docs, "_a", "_b")
    keyed = docs.withColumns(dict(zip(names, _text_key("text"))))
    return keyed.join(hits.toDF(*names), names, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9(spark, sf_dir):
    out = judged(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
