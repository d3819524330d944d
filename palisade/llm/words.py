"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

A block holds whole texts of about ``BLOCK_BYTES`` together (a longer text is a
block of its own), so the arrays of a task stay small however large its
partition is.  Every byte of a text takes part; nothing is cut.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

BLOCK_BYTES = 2_000_000
_U = np.uint64


def byte_table(separators) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(separators)] = True
    return table


#: Words are runs of anything but ASCII white space.
SPACES = byte_table([0x20, *range(0x09, 0x0E)])
#: Words are runs of digits, letters and all non-ASCII characters.
NON_WORD = byte_table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Block:
    """Texts laid end to end, and the places of their words."""

    rows: np.ndarray      # row numbers in the batch
    data: np.ndarray      # bytes, lower-cased where asked for
    bounds: np.ndarray    # text i is data[bounds[i]:bounds[i + 1]]
    starts: np.ndarray    # of every word
    ends: np.ndarray
    first: np.ndarray     # text i has the words first[i] to first[i + 1] - 1

    def __len__(self):
        return len(self.rows)

    def word_rows(self) -> np.ndarray:
        """The text, counted in the block, of every word."""
        return np.repeat(np.arange(len(self.rows)), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def find_words(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray):
    """Starts and ends of words, and the first word of each text."""
    inside = ~separators[data]
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = ~inside[:-1]
    edge[bounds] = True
    starts = np.flatnonzero(inside & edge[:-1])
    edge[1:-1] = ~inside[1:]
    edge[bounds] = True
    ends = np.flatnonzero(inside & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def blocks(column, separators: np.ndarray, lower: bool = False, block_bytes: int = BLOCK_BYTES):
    data, bounds = column_bytes(column)
    n, at = len(bounds) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + block_bytes, "right")) - 1)
        own, own_bounds = data[bounds[at]:bounds[to]], bounds[at:to + 1] - bounds[at]
        if lower:
            own = LOWER[own]
        yield Block(np.arange(at, to), own, own_bounds, *find_words(own, own_bounds, separators))
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser in which every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hasher:
    """64-bit hashes of words and of runs of words, by prefix sums modulo 2**64."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed + 20_240_601)
        self.letters = rng.integers(0, 2**64, 256, dtype=np.uint64) | _U(1)
        self.base, self.step = (int(x) | 1 for x in rng.integers(2**62, 2**63, 2, dtype=np.uint64))
        self._powers = {}

    def powers(self, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = self._powers.get(base)
        if have is None or len(have[0]) < n:
            size = max(n, 1 << 16)
            size = 1 << (size - 1).bit_length()
            made = []
            for b in (base, pow(base, -1, 2**64)):
                p = np.full(size, b, dtype=np.uint64)
                p[0] = 1
                made.append(np.multiply.accumulate(p))
            have = self._powers[base] = tuple(made)
        return have[0][:n], have[1][:n]

    def words(self, block: Block) -> np.ndarray:
        n = len(block.data)
        if not len(block.starts):
            return np.zeros(0, np.uint64)
        up, down = self.powers(self.base, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.letters[block.data] * up[:n], out=sums[1:])
        lengths = (block.ends - block.starts).astype(np.uint64)
        return mix((sums[block.ends] - sums[block.starts]) * down[block.starts] + lengths * _U(0x9E3779B97F4A7C15))

    def runs(self, words: np.ndarray, k: int) -> np.ndarray:
        """Hash of the k words from each place at which k words are left, text ends not regarded."""
        n = len(words)
        if n < k:
            return np.zeros(0, np.uint64)
        up, down = self.powers(self.step, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * up[:n], out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * down[:n - k + 1])


def run_starts(first: np.ndarray, k: int, n_words: int) -> np.ndarray:
    """True at the words from which k words of the same text are left, for all n_words - k + 1 places."""
    if n_words < k:
        return np.zeros(0, bool)
    end = np.repeat(first[1:], np.diff(first))
    return np.arange(n_words - k + 1) + k <= end[:n_words - k + 1]


class Vocabulary:
    """Numbers 1, 2, ... for given words; every other word is 0.  Words are told apart by 128 bits of hash."""

    def __init__(self, words: list[bytes]):
        self.hashers = Hasher(11), Hasher(12)
        column = pa.array(words, pa.large_binary())
        hashes = [np.concatenate([h.words(b) for b in blocks(column, NON_WORD)] or [np.zeros(0, np.uint64)]) for h in self.hashers]
        order = np.argsort(hashes[0])
        self.hashes, self.order = [h[order] for h in hashes], order + 1

    def numbers(self, block: Block) -> np.ndarray:
        if not len(self.order):
            return np.zeros(len(block.starts), np.int64)
        mine = [h.words(block) for h in self.hashers]
        at = np.minimum(np.searchsorted(self.hashes[0], mine[0]), len(self.order) - 1)
        return np.where((self.hashes[0][at] == mine[0]) & (self.hashes[1][at] == mine[1]), self.order[at], 0)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
