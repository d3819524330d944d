"""Byte-level BPE by a two-tier lookup.

A text is split by the tokenizer's pattern.  The different pieces of a block of texts go through

1. a **minimal perfect hash** over the vocabulary (hash and displace: a bucket's displacement sends its tokens to free
   slots, as many slots as tokens); a piece that equals the token in its slot is that token;
2. for the others, **merges by a heap over linked bytes**: every byte starts as a part that is linked to its neighbours,
   the heap holds the neighbouring pairs that are tokens, and the pair of the lowest rank (the leftmost of equals)
   becomes one part.  A pair that a merge has overtaken is passed over when it comes up.

The ids of a block are gathered from those of its different pieces.  Decoding lays the bytes of the tokens end to end.
The vocabulary alone is broadcast; its size is that of the tokenizer's file, whatever the documents are.
"""

from __future__ import annotations

import base64
import heapq
import sys
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.llm import base, words as W

#: Bytes of text, or pieces of a longer text, that are looked up together; merged pieces that a Python worker remembers (some 60 bytes each).
BLOCK_BYTES, PIECES, MEMORY = 4_000_000, 500_000, 1_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file (a token in base64 and its rank per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Each of n different keys has a slot of its own below n, found from its 64-bit hash by one displacement."""

    def __init__(self, hashes: np.ndarray, load: int = 3):
        self.n, self.m = len(hashes), max(1, len(hashes) // load)
        if len(np.unique(hashes)) != self.n:
            raise ValueError("two keys share a hash")
        self.shift = np.zeros(self.m, np.int64)
        bucket = (hashes % np.uint64(self.m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(self.m + 1))
        sizes, taken = np.diff(first), np.zeros(self.n, bool)
        for size in range(int(sizes.max(initial=0)), 1, -1):  # the fullest first, while most slots are free
            left, shift = np.flatnonzero(sizes == size), 0
            keys = hashes[order[first[left][:, None] + np.arange(size)]]
            while len(left):
                slots = self._slots(keys, np.array(shift))
                free = ~taken[slots].any(axis=1) & (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1)
                claim = np.full(self.n, len(left))
                np.minimum.at(claim, slots[free], np.flatnonzero(free)[:, None])
                won = free & (claim[slots] == np.arange(len(left))[:, None]).all(axis=1)
                taken[slots[won]], self.shift[left[won]] = True, shift
                left, keys, shift = left[~won], keys[~won], shift + 1
        # A bucket of one key names its slot outright.
        self.shift[sizes == 1] = -1 - np.flatnonzero(~taken)

    def _slots(self, hashes, shift):
        return (W.mix(hashes + shift.astype(np.uint64) * _STEP) % np.uint64(max(self.n, 1))).astype(np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of every hash; that of a hash which is no key's is some slot below n."""
        shift = self.shift[(hashes % np.uint64(self.m)).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, self._slots(hashes, np.maximum(shift, 0)))


def _places(starts, lengths, index):
    """starts[i], ..., starts[i] + lengths[i] - 1 for every i of the index, end to end."""
    n = lengths[index].astype(np.int64)
    ends = np.cumsum(n)
    return np.repeat(starts[index] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def _gather(values, starts, lengths, index):
    return values[_places(starts, lengths, index)]


class Remembered:
    """Ids of merged pieces, in runs sorted by hash; runs of like size are joined, so a piece is looked up in few of them."""

    def __init__(self):
        self.runs = []

    def find(self, pieces: pa.Array, hashes: np.ndarray):
        """Per run: which pieces it knows, the ids of its pieces, and where and how many those of each known piece are."""
        left = np.arange(len(hashes))
        for known, own, ids, starts, n in self.runs:
            at = np.minimum(np.searchsorted(known, hashes[left]), len(known) - 1)
            hit = known[at] == hashes[left]
            hit[hit] = pc.equal(own.take(pa.array(at[hit])), pieces.take(pa.array(left[hit]))).to_numpy(zero_copy_only=False)
            yield left[hit], ids, starts[at[hit]], n[at[hit]]
            left = left[~hit]

    def add(self, pieces: pa.Array, hashes: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Pieces that no run has; beyond MEMORY of them everything is forgotten, which costs time and no result."""
        if not len(hashes):
            return
        if sum(len(r[0]) for r in self.runs) + len(hashes) > MEMORY:
            self.runs = []
        self.runs.append(self._sorted(hashes, pieces, ids, np.cumsum(n) - n, n))
        while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
            b, a = self.runs.pop(), self.runs.pop()
            self.runs.append(self._sorted(np.concatenate([a[0], b[0]]), pa.concat_arrays([a[1], b[1]]), np.concatenate([a[2], b[2]]),
                                          np.concatenate([a[3], b[3] + len(a[2])]), np.concatenate([a[4], b[4]])))

    @staticmethod
    def _sorted(hashes, pieces, ids, starts, n):
        order = np.argsort(hashes)
        return hashes[order], pieces.take(pa.array(order)), ids.astype(np.int32), starts[order].astype(np.int32), n[order].astype(np.int32)


class Vocabulary:
    """Tokens of a rank file, with what encoding and decoding look up."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = pa.array(list(ranks), pa.binary())
        self.hasher = W.Hasher(31)
        self.perfect = PerfectHash(self._hashes(tokens))
        back = np.argsort(self.perfect.slots(self._hashes(tokens)))
        self.tokens, self.ranks = tokens.take(pa.array(back)), np.fromiter(ranks.values(), np.int64, len(ranks))[back]
        self.by_rank = np.full(int(self.ranks.max(initial=-1)) + 1, -1)
        self.by_rank[self.ranks] = np.arange(len(self.ranks))
        self._merge_ranks, self._known = None, Remembered()

    def __getstate__(self):
        return self.__dict__ | {"_merge_ranks": None, "_known": Remembered()}

    def _hashes(self, pieces: pa.Array) -> np.ndarray:
        data, bounds = W.column_bytes(pieces)
        return self.hasher.words(W.Block(None, data, bounds, bounds[:-1], bounds[1:], None)) if len(pieces) else np.zeros(0, np.uint64)

    def whole(self, pieces: pa.Array, hashes: np.ndarray | None = None) -> np.ndarray:
        """The rank of each piece that is a token, else -1."""
        if not len(self.tokens):
            return np.full(len(pieces), -1)
        slots = self.perfect.slots(self._hashes(pieces) if hashes is None else hashes)
        return np.where(pc.equal(self.tokens.take(pa.array(slots)), pieces).to_numpy(zero_copy_only=False), self.ranks[slots], -1)

    def merged(self, pieces: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that are no tokens, end to end, and the number of each; merges those not remembered."""
        if self._merge_ranks is None:
            self._merge_ranks = dict(zip(self.tokens.to_pylist(), self.ranks.tolist()))
        n, parts, new = np.zeros(len(hashes), np.int64), [], np.ones(len(hashes), bool)
        for at, ids, starts, sizes in self._known.find(pieces, hashes):
            n[at], new[at] = sizes, False
            parts.append((at, _gather(ids, starts, sizes, np.arange(len(at)))))
        at = np.flatnonzero(new)
        if len(at):
            own = pieces.take(pa.array(at))
            lists = [merge(p, self._merge_ranks) for p in own.to_pylist()]
            n[at] = [len(x) for x in lists]
            ids = np.fromiter((i for x in lists for i in x), np.int32, int(n[at].sum()))
            parts.append((at, ids))
            self._known.add(own, hashes[at], ids, n[at])
        flat, starts = np.zeros(int(n.sum()), np.int32), np.cumsum(n) - n
        for at, ids in parts:
            flat[_places(starts, n, at)] = ids
        return flat, n

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and the number of ids of each piece."""
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        different = coded.dictionary.cast(pa.large_binary()).cast(pa.binary())
        hashes = self._hashes(different)
        ids = self.whole(different, hashes)
        n = np.ones(len(ids), np.int64)
        misses = np.flatnonzero(ids < 0)
        merged, n[misses] = self.merged(different.take(pa.array(misses)), hashes[misses])
        starts = np.cumsum(n) - n
        flat = np.repeat(ids, n).astype(np.int32)
        flat[np.repeat(ids < 0, n)] = merged
        index = coded.indices.to_numpy(zero_copy_only=False)
        return _gather(flat, starts, n, index), n[index]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids end to end, and the number of bytes of each."""
        data, bounds = W.column_bytes(self.tokens)
        slots = self.by_rank[ids]
        if len(slots) and slots.min() < 0:
            raise ValueError("no token has this id")
        return _gather(data, bounds[:-1], np.diff(bounds), slots), np.diff(bounds)[slots]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece.  A heap entry is a rank and the place of the pair's left part, in one number."""
    n, get = len(piece), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = [get(piece[i:i + 2]) for i in range(n)]  # rank of the pair of parts whose left one starts here
    pair[-1] = None
    heap = [r << 32 | i for i, r in enumerate(pair) if r is not None]
    heapq.heapify(heap)
    while heap:
        top = heapq.heappop(heap)
        i = top & 0xFFFFFFFF
        if pair[i] != top >> 32:
            continue  # a merge has changed one of the two parts since
        pair[after[i]] = None
        after[i] = end = after[after[i]]
        pair[i] = None
        if end < n:
            before[end] = i
            pair[i] = r = get(piece[i:after[end]])
            if r is not None:
                heapq.heappush(heap, r << 32 | i)
        if i:
            j = before[i]
            pair[j] = r = get(piece[j:end])
            if r is not None:
                heapq.heappush(heap, r << 32 | j)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:after[i]]])
        i = after[i]
    return ids


def _lists(values: pa.Array, lengths) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values)


def _binaries(data: np.ndarray, lengths) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())])


def _blocks(texts: pa.Array):
    """Slices of a column of at most ``BLOCK_BYTES`` of text; a longer text is a slice of its own."""
    _, bounds = W.column_bytes(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK_BYTES, "right")) - 1)
        yield at, to
        at = to


def _encode(shared, pattern):
    def encode(batches):
        import regex

        vocabulary, find = shared.value, regex.compile(pattern)
        for batch in batches:
            for at, to in _blocks(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(at, to - at).to_pylist()]
                if len(texts) == 1:  # it may be very long: its pieces go in runs
                    pieces = (m.group() for m in find.finditer(texts[0]))
                    runs = [vocabulary.encode(run)[0] for run in iter(lambda: list(islice(pieces, PIECES)), [])]
                    ids = np.concatenate(runs) if runs else np.zeros(0, np.int32)
                    n = [len(ids)]
                else:
                    pieces = [find.findall(t) for t in texts]
                    ids, per_piece = vocabulary.encode([p for own in pieces for p in own])
                    sums = np.concatenate([[0], np.cumsum(per_piece)])
                    n = np.diff(sums[np.concatenate([[0], np.cumsum([len(own) for own in pieces])])])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), _lists(pa.array(ids), n)], ["doc_id", "ids"])
    return encode


def _decode(shared):
    def decode(batches):
        for batch in batches:
            ids = batch.column(1)
            n = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            data, lengths = shared.value.decode(ids.flatten().to_numpy(zero_copy_only=False))
            sums = np.concatenate([[0], np.cumsum(lengths)])
            own = np.diff(sums[np.concatenate([[0], np.cumsum(n)])])
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, _binaries(data, own)], ["doc_id", "ids", "decoded"])
    return decode


class Codec:
    """Encodes and decodes whole columns by one rank file and its splitting pattern."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.pattern, self.shared = pattern, spark.sparkContext.broadcast(Vocabulary(read_ranks(spark, path)))

    def encoded(self, docs: DataFrame) -> DataFrame:
        """doc_id and ids (array of int) for every row.

        Only ``doc_id`` (any type, nulls included) and ``text`` are read.  A null or empty text has no ids; equal rows
        get equal ids; long texts are encoded whole; no special token is added or recognised; an empty table gives an empty one.
        """
        key = docs.schema["doc_id"].dataType.simpleString()
        return base.only(docs, "doc_id", "text").mapInArrow(_encode(self.shared, self.pattern), f"doc_id {key}, ids array<int>")

    def round_trip(self, docs: DataFrame) -> DataFrame:
        """``decoded(encoded(docs))`` in one stage."""
        key, encode, decode = docs.schema["doc_id"].dataType.simpleString(), _encode(self.shared, self.pattern), _decode(self.shared)
        return base.only(docs, "doc_id", "text").mapInArrow(lambda batches: decode(encode(batches)),
                                                            f"doc_id {key}, ids array<int>, decoded binary")

    def decoded(self, encoded: DataFrame) -> DataFrame:
        """doc_id, ids and decoded (binary) for every row; null ids decode to no bytes, and an id without a token is an error."""
        key = encoded.schema["doc_id"].dataType.simpleString()
        return base.only(encoded, "doc_id", "ids").mapInArrow(_decode(self.shared), f"doc_id {key}, ids array<int>, decoded binary")


def op13(spark, sf_dir):
    import public_tokenizers

    codec = Codec(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = codec.round_trip(base.table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
