"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of pairs of words; what it leaves to words it has not seen goes by their bytes.

* **Word counts.** Words are 56-bit hashes; a mark stands at both ends of a text.  The pairs of all texts are dealt to shards by
  their second word, not as rows of keys but as packed arrays: of each block of texts and shard its different words once, and of
  each text the places of its pairs in that list, some three bytes a pair.  A shard has all pairs that end in its words, so it
  counts them and how many contexts each word follows.  Discounts follow from counts of counts.
* **Count joins.** What a shard counts of each context is sent to the context's own shard, summed there and sent back to all shards
  that have pairs of it; there contexts' totals, words' probabilities and pairs' counts meet the texts' pairs.  What seen pairs
  and words change in a text's summed logarithm is summed per text and shard, then per text.  A shard holds the pairs of
  SHARD_BYTES of trusted text; there are as many shards as that takes.  The corpus is scored in the pass that its model is fitted
  in, trusted texts by two models at once.
* **Unknown words** are spelled by a model of four byte classes (small letters, one class for capitals, digits, spaces, line
  ends, kinds of punctuation, lead and trailing bytes of other letters; at most SYMBOLS**ORDER n-grams), built the same
  way.  So is white space beyond one byte behind each word.
* **Perplexity** is per byte.  Short texts are drawn to their language's mean with the weight of ``prior`` bytes.
* **Thresholds** are a quantile of the trusted texts' perplexity, by language, times ``slack``, where each text is scored by
  the counts of the other fold; a language without trusted text takes that of all trusted text.  Text that is easier to
  predict than the opposite quantile of trusted text, scored by the model that has seen it, over ``slack`` goes too.
"""

from __future__ import annotations

import itertools
import pickle
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from palisade.llm import base, words as W

ORDER, SYMBOLS = 4, 48
#: Trusted texts are dealt into so many folds; thresholds come from texts that the model at hand has not seen.
FOLDS = 2
#: Trusted ids that are sent to every task at most (16 bytes each); beyond it the documents are shuffled to them.
BROADCAST_IDS = 4_000_000
#: A shard holds the pairs of so many bytes of trusted text; there are SHARDS at least.
SHARD_BYTES, SHARDS = 12_000_000, 8
#: Words of texts that are packed together.
BLOCK_WORDS = 3_000_000
#: So many of its contexts a block names by frequency.
HOT = 4096
#: Steps of a stored minus log probability, per unit; 32 is the largest.
STEPS = 2048
#: Bins of a perplexity's logarithm, per unit.
BINS = 1000
#: Stands before the first and behind the last word of a text.
MARK = int(np.random.default_rng(4).integers(1, 2**56, dtype=np.int64))
#: What is done with a text's pairs, in the order in which shards meet them; what is known of contexts comes first.
CONTEXTS, COUNT, BOTH, SCORE = range(4)
#: What shards tell of a context by model: its pairs, different ones, those that stand there once, and twice.
TOLD = 4 * (FOLDS + 1)


def classes() -> np.ndarray:
    """Class of each byte; 0 stands before a text."""
    out = np.zeros(256, np.int32)
    groups = [[c] for c in range(97, 123)] + [range(65, 91), range(48, 58), [32], range(9, 14), b".", b",", b"!?;:", b"'\"()-/"]
    for n, group in enumerate(groups, 1):
        out[list(group)] = n
    rest = len(groups) + 1
    out[:128][out[:128] == 0] = rest
    out[128:192] = rest + 1 + (np.arange(64) >> 3)
    out[192:] = rest + 9
    out[0xC3] = rest + 10
    assert out.max() < SYMBOLS
    return out


def block_codes(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Code of the n-gram that ends at each byte, in base SYMBOLS; before a text stand zeros."""
    n = len(bounds) - 1
    pad = ORDER - 1
    padded = np.zeros(len(data) + pad * n, np.int32)
    place = np.arange(len(data)) + np.repeat(pad * np.arange(1, n + 1), np.diff(bounds))
    padded[place] = table[data]
    code = padded[place]
    for back in range(1, ORDER):
        code = code + padded[place - back] * np.int32(SYMBOLS**back)
    return code


def _count(batches):
    table, size = classes(), SYMBOLS**ORDER
    total = np.zeros(FOLDS * size, np.int64)
    for batch in batches:
        folds = batch.column(1).to_numpy()
        for block in W.blocks(batch.column(0), W.SPACES, block_bytes=4_000_000):
            codes = block_codes(block.data, block.bounds, table)
            total += np.bincount(codes + size * np.repeat(folds[block.rows], np.diff(block.bounds)), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array((at % size).astype(np.int32)), pa.array((at // size).astype(np.int32)),
                                      pa.array(total[at])], ["gram", "fold", "n"])


def mark_trusted(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The documents with a column ``trusted``.  The ids are broadcast only if a count finds them few enough; else the texts are
    shuffled to them once and written."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    ids = (F.broadcast(ids) if few else ids).withColumn("trusted", F.lit(True))
    marked = docs.join(ids, docs["doc_id"] == ids["_id"], "left").drop("_id").withColumn(
        "trusted", F.coalesce("trusted", F.lit(False)))
    return marked if few else base.written(marked, "marked")


def _discounts(counts: DataFrame) -> dict[int, list[float]]:
    """D1, D2 and D3+ of one order from its counts, by model."""
    return _discounts_of({(r["model"], r["n"]): r["k"] for r in counts.where("n <= 4").groupBy("model", "n").agg(
        F.count("*").alias("k")).collect()})


def _discounts_of(have: dict[tuple[int, int], int]) -> dict[int, list[float]]:
    """The same from counts of counts by model and count."""
    out = {}
    for model in range(FOLDS + 1):
        c = [have.get((model, k), 0) for k in range(1, 5)]
        y = c[0] / (c[0] + 2 * c[1]) if c[0] else 0.5
        out[model] = [min(max(k - (k + 1) * y * c[k] / c[k - 1] if c[k - 1] else k * 0.5, 0.1), k) for k in (1, 2, 3)]
    return out


def _cut(discounts: dict[int, list[float]]):
    pick = F.lit(0.0)
    for model, (d1, d2, d3) in discounts.items():
        pick = F.when(F.col("model") == model, F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)).otherwise(pick)
    return pick


def counted(texts: DataFrame) -> DataFrame:
    """(fold, gram, n) over all rows of (text, fold)."""
    own = texts.select("text", F.col("fold").cast("int").alias("fold"))
    grams = own.mapInArrow(_count, "gram int, fold int, n long").groupBy("fold", "gram").agg(F.sum("n").alias("n"))
    return base.written(grams, "grams")


def train(grams: DataFrame) -> DataFrame:
    """All models from counts (fold, gram, n): (model, level, gram, context, p, rest), one row per n-gram of every order seen.

    Model 0 is that of all folds, model k + 1 that of all but fold k; they are built side by side.  ``p`` is the gram's
    interpolated probability; ``rest`` is what its context leaves to lower orders.
    """
    part_of = F.array_compact(F.array(F.lit(0), *[F.when(F.col("fold") != k, F.lit(k + 1)) for k in range(FOLDS)]))
    seen = {ORDER: base.written(grams.select(F.explode(part_of).alias("model"), "gram", "n").groupBy("model", "gram").agg(
        F.sum("n").alias("n")), "counts")}
    for level in range(ORDER - 1, 0, -1):  # how many symbols stand before the gram
        seen[level] = seen[level + 1].groupBy("model", (F.col("gram") % SYMBOLS**level).alias("gram")).agg(F.count("*").alias("n"))
    lower, models = None, []
    for level in range(1, ORDER + 1):
        grams = seen[level].withColumn("context", F.floor(F.col("gram") / SYMBOLS).cast("int")).withColumn("cut", _cut(_discounts(seen[level])))
        totals = grams.groupBy("model", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("left"))
        joined = grams.join(totals, ["model", "context"]).withColumn("suffix", (F.col("gram") % SYMBOLS**(level - 1)).cast("int"))
        if lower is None:
            below = joined.withColumn("q", F.lit(1.0 / SYMBOLS))
        else:
            below = joined.join(lower.select("model", F.col("gram").alias("suffix"), F.col("p").alias("q")), ["model", "suffix"])
        lower = base.written(below.select(
            "model", "gram", "context", ((F.col("n") - F.col("cut") + F.col("left") * F.col("q")) / F.col("total")).alias("p"),
            (F.col("left") / F.col("total")).alias("rest")), f"order{level}")
        models.append(lower.select("model", F.lit(level).alias("level"), "gram", "context", "p", "rest"))
    out = models[0]
    for part in models[1:]:
        out = out.unionByName(part)
    return out


def dense(rows: pa.Table, model: int = 0) -> np.ndarray:
    """Minus log probability of all SYMBOLS**ORDER n-grams under one model, unseen ones by what their contexts leave."""
    rows = rows.filter(pa.compute.equal(rows["model"], model))
    level, gram, context, p, rest = (rows[c].to_numpy() for c in ("level", "gram", "context", "p", "rest"))
    probs = np.full((1, SYMBOLS), 1.0 / SYMBOLS, np.float32)
    for n in range(1, ORDER + 1):
        own = level == n
        left = np.ones(SYMBOLS**(n - 1), np.float32)
        left[context[own]] = rest[own]
        # An unseen gram has what its context leaves of the probability after the context without its first symbol.
        probs = left.reshape(-1, len(probs), 1) * probs[None, :, :]
        probs = probs.reshape(-1, SYMBOLS)
        probs.reshape(-1)[gram[own]] = p[own]
    np.log(probs, out=probs)
    return np.negative(probs, out=probs).reshape(-1)


class Stepped:
    """Minus log probabilities in steps of 1 / STEPS, two bytes each; read like an array of floats."""

    def __init__(self, costs: np.ndarray):
        self.steps = np.minimum(np.rint(costs * STEPS), 65535).astype(np.uint16)

    def __getitem__(self, codes) -> np.ndarray:
        return self.steps[codes] / STEPS

    def __getstate__(self):  # most rows repeat a lower order's, so what is sent is small
        return _squeezed(self.steps)

    def __setstate__(self, state):
        (self.steps,) = _unsqueezed(state)


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold the largest, equal bytes of neighbours side by side, compressed."""
    parts = []
    for a in arrays:
        a = a.astype(np.min_scalar_type(a.max() if len(a) else 0))
        if a.dtype.itemsize == 8:  # numbers of 56 bits have seven bytes
            wide = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), 8)
            while wide.shape[1] > 5 and not wide[:, -1].any():
                wide = wide[:, :-1]
            parts.append((a.dtype.str, np.ascontiguousarray(wide.T).tobytes(), wide.shape[1]))
            continue
        parts.append((a.dtype.str, np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), a.itemsize))
    raw = pickle.dumps(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _squeezed_names(names: np.ndarray) -> bytes:
    """Ascending numbers, by their steps."""
    return _squeezed(np.diff(names, prepend=np.zeros(1, np.uint64)))


def _unsqueezed_names(data: bytes) -> np.ndarray:
    (steps,) = _unsqueezed(data)
    return np.cumsum(steps, dtype=np.uint64)


def _unsqueezed(data: bytes) -> list[np.ndarray]:
    out = []
    for kind, planes, size in pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)):
        planes = np.frombuffer(planes, np.uint8).reshape(size, -1)
        wide = np.zeros((planes.shape[1], np.dtype(kind).itemsize), np.uint8)
        wide[:, :size] = planes.T
        out.append(wide.view(kind).reshape(-1))
    return out


def _tokens(hasher, block) -> tuple[np.ndarray, np.ndarray]:
    """Word and text of every word of a block and of the mark behind each text that has words; each follows the one before it."""
    words, n = hasher.words(block) >> np.uint64(8), np.diff(block.first)
    has = n > 0
    word = np.full(len(words) + int(has.sum()), MARK, np.uint64)
    word[np.arange(len(words)) + (np.cumsum(has) - 1)[block.word_rows()]] = words
    return word, np.repeat(np.flatnonzero(has), n[has] + 1)


def _spelling(block, table) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the bytes of every word, and of one space behind it, as they stand after a space; and where each word's begin."""
    lengths = block.ends - block.starts
    bounds = np.concatenate([[0], np.cumsum(lengths + 2)])
    data = np.full(int(bounds[-1]), 32, np.uint8)
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    data[inside + np.repeat(bounds[:-1] + 1, lengths)] = block.data[inside + np.repeat(block.starts, lengths)]
    codes = np.delete(block_codes(data, bounds, table), bounds[:-1])
    return codes, bounds - np.arange(len(bounds))


def _spelled(codes, edge, costs) -> np.ndarray:
    return np.diff(np.concatenate([[0.0], np.cumsum(costs[codes], dtype=np.float64)])[edge])


def _hot_first(often: np.ndarray, size: int) -> np.ndarray:
    """All places below ``size``: the frequent ones first, so that most are small numbers, then the others in order."""
    rest = np.ones(size, bool)
    rest[often] = False
    return np.concatenate([often.astype(np.int64), np.flatnonzero(rest)])


def _packed(parts, shards: int, kind: int):
    """One row per shard of the texts of ``parts``, which is emptied: kind, different words, and each text's pairs as places among them."""
    word, row, tags, models, *costs = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    names, first_at, w = np.unique(word, return_index=True, return_inverse=True)
    mark = np.searchsorted(names, np.uint64(MARK))
    spell = [np.where(np.arange(len(names)) == mark, 0, c[first_at]) for c in costs]  # the mark has no bytes
    del word, costs
    n_bits, r_bits = (max(1, int(x).bit_length()) for x in (len(names), len(tags)))
    assert r_bits + 2 * n_bits < 64
    code = row.astype(np.int64) << n_bits
    code |= w
    code <<= n_bits
    code[1:] |= w[:-1]  # the mark behind one text stands before the next
    code[0] |= mark
    part = (names % np.uint64(shards)).astype(np.uint16 if shards < 2**16 else np.uint32)[w]
    del row, w
    order = np.argsort(part, kind="stable")
    edge = np.append(np.flatnonzero(np.diff(part[order].astype(np.int32), prepend=-1)), len(order))
    for a, b in zip(edge, edge[1:]):
        k = int(part[order[a]])
        own, n = np.unique(code[order[a:b]], return_counts=True)
        r, x, y = own >> (2 * n_bits), (own >> n_bits) & ((1 << n_bits) - 1), own & ((1 << n_bits) - 1)
        first = np.flatnonzero(np.diff(r, prepend=-1))
        followers, x = np.unique(x, return_inverse=True)
        step = np.diff(x, prepend=0)
        step[first] = x[first]  # followers of a text ascend
        contexts, y, often = np.unique(y, return_inverse=True, return_counts=True)
        often = np.argsort(-often, kind="stable")[:HOT]
        back = _hot_first(often, len(contexts))
        place = np.empty(len(back), np.int64)
        place[back] = np.arange(len(back))
        yield (k, kind, _squeezed_names(names[followers]), _squeezed_names(names[contexts]), _squeezed(
            tags[r[first]], models[r[first]], np.diff(np.append(first, len(r))), step, place[y], n - 1, often, *[c[followers] for c in spell]))


def _deal(shards: int, shared=None):
    """(shard, kind, followers, contexts, pairs) of rows (tag, model, kind, text); with byte tables, also what words' spelling costs."""
    def deal(batches):
        hasher, table = W.Hasher(31), classes()
        parts, size, texts = {}, {}, {}

        def rows(kind):
            out = list(zip(*_packed(parts[kind], shards, kind)))
            size[kind] = texts[kind] = 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (
                pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["shard", "kind", "followers", "contexts", "pairs"])
        for batch in batches:
            every = batch.column(2).to_numpy()
            for kind in (int(x) for x in np.unique(every)):
                own = batch.filter(pa.array(every == kind))
                tags, models = (own.column(i).to_numpy() for i in range(2))
                for block in W.blocks(own.column(3), W.SPACES):
                    word, row = _tokens(hasher, block)
                    if not len(word):
                        continue
                    costs = []
                    if shared is not None:
                        codes, edge = _spelling(block, table)
                        real = np.diff(row, append=-1) == 0  # all but the marks
                        for steps in shared.value:
                            cost = np.zeros(len(word), np.int32)
                            cost[real] = np.diff(np.concatenate([[0], np.cumsum(steps.steps[codes], dtype=np.int64)])[edge])
                            costs.append(cost)
                    parts.setdefault(kind, []).append((word, (row + texts.get(kind, 0)).astype(np.int32),
                                                       tags[block.rows].view(np.uint64), models[block.rows], *costs))
                    size[kind], texts[kind] = size.get(kind, 0) + len(word), texts.get(kind, 0) + len(block)
                    if size[kind] >= BLOCK_WORDS:
                        yield rows(kind)
        for kind in parts:
            if parts[kind]:
                yield rows(kind)
    return deal


class _Pairs:
    """What a task dealt to a shard: names of followers and contexts; tag and model of each text; of each pair its text, follower,
    context and how often it stands there; what followers' spelling costs, if that was dealt too."""

    def __init__(self, followers: bytes, contexts: bytes, pairs: bytes):
        self.followers, self.contexts = _unsqueezed_names(followers), _unsqueezed_names(contexts)
        tags, models, size, step, y, n, often, *self.spelled = _unsqueezed(pairs)
        self.tags, self.models = tags.astype(np.uint64), models.astype(np.int64)
        self.row = np.repeat(np.arange(len(tags)), size)
        climb = np.cumsum(step, dtype=np.int64)
        first = np.cumsum(size, dtype=np.int64) - size
        self.x = climb - (climb[first] - step[first].astype(np.int64))[self.row]
        self.y, self.n = _hot_first(often, len(self.contexts))[y], n.astype(np.int64) + 1


class _Counts:
    """The different pairs of a shard's trusted text: ``names`` are its words, ``code`` follower * len(names) + context, ``n`` by model."""

    def __init__(self, dealt: list[tuple[bytes, bytes, bytes]]):
        self.names = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_unsqueezed_names(x) for d in dealt for x in d[:2])]))
        size, codes = max(1, len(self.names)), [np.zeros(0, np.int64)]
        self.spelled = np.zeros((FOLDS + 1, len(self.names)), np.int32)
        for d in dealt:
            p = _Pairs(*d)
            w = np.searchsorted(self.names, p.followers)
            for m, cost in enumerate(p.spelled):
                self.spelled[m, w] = cost
            code = (w[p.x] * size + np.searchsorted(self.names, p.contexts)[p.y]) * FOLDS + p.models[p.row] - 1
            codes.append(np.repeat(code, p.n))
        codes = np.concatenate(codes)
        codes.sort()
        fold = (codes % FOLDS).astype(np.int8)
        codes //= FOLDS
        new = np.flatnonzero(np.diff(codes, prepend=-1))
        self.code = codes[new]
        del codes
        by_fold = [np.add.reduceat((fold == k).astype(np.int32), new) if len(new) else np.zeros(0, np.int32) for k in range(FOLDS)]
        self.n = [sum(by_fold), *[sum(x for j, x in enumerate(by_fold) if j != k) for k in range(FOLDS)]]

    def split(self) -> tuple[np.ndarray, np.ndarray]:
        """Follower and context of each pair."""
        return tuple(x.astype(np.int32) for x in np.divmod(self.code, max(1, len(self.names))))


def _shards(batches):
    """Each shard, whose rows come sorted by shard and kind, and its further columns row by row."""
    def rows():
        for batch in batches:
            for i in range(batch.num_rows):
                yield tuple(c[i].as_py() for c in batch.columns)
    return itertools.groupby(rows(), lambda r: r[0])


def _bincount(at, n: int, weights=None) -> np.ndarray:
    return np.rint(np.bincount(at, weights, n)).astype(np.int64)


def _count_pairs(shards: int):
    """(home, shard, names, told): what each shard has of the contexts whose own shard is ``home``; with its own words' spelling.

    In home -1 stand counts of counts: of pairs and of words' contexts, by model, and the sum of the latter.
    """
    def count(batches):
        for shard, rows in _shards(batches):
            counts = _Counts([r[2:] for r in rows])
            w, v = counts.split()
            size, told, few = len(counts.names), [], []
            for n in counts.n:
                after = np.bincount(w[n > 0], minlength=size)
                few += [*np.bincount(n[n <= 4], minlength=5)[1:5], *np.bincount(after[after <= 4], minlength=5)[1:5], after.sum(),
                        (after > 0).sum()]
                told += [_bincount(v, size, n), np.bincount(v[n > 0], minlength=size), np.bincount(v[n == 1], minlength=size),
                         np.bincount(v[n == 2], minlength=size)]
            home = (counts.names % np.uint64(shards)).astype(np.int64)
            out = [(-1, shard, b"", _squeezed(np.array(few)))]
            for h in np.unique(home):
                own = home == h
                spelled = [c[own] for c in counts.spelled] if h == shard else []
                out.append((int(h), shard, _squeezed_names(counts.names[own]), _squeezed(*[t[own] for t in told], *spelled)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["home", "shard", "names", "told"])
    return count


def _sum_contexts(batches):
    """(shard, home, told): sums over all shards, for each shard in the order of the names that it sent."""
    for home, rows in _shards(batches):
        rows = list(rows)
        if home >= 0:
            names = [_unsqueezed_names(r[2]) for r in rows]
            every = np.unique(np.concatenate(names))
            at, total = [np.searchsorted(every, x) for x in names], np.zeros((TOLD, len(every)), np.int64)
            told = [_unsqueezed(r[3]) for r in rows]
            for place, own in zip(at, told):
                for i in range(TOLD):
                    total[i, place] += own[i].astype(np.int64)
            sent = [_squeezed(*total[:, place], *own[TOLD:]) for place, own in zip(at, told)]
        else:
            sent = [r[3] for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int32()), pa.array([home] * len(rows), pa.int32()),
                                          pa.array(sent, pa.binary())], ["shard", "home", "told"])


def _place(names: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of numbers in a sorted list, -1 for those it lacks."""
    if not len(names):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return np.where(names[at] == wanted, at, -1)


class _Values:
    """What seen words (``one``) and pairs (``two``) of a shard change in a text's cost, by model."""

    def __init__(self, shard: int, counts: _Counts, listed: dict[int, bytes], law: tuple):
        self.names, self.code, self.one, self.two = counts.names, counts.code, [], []
        shards, cuts, word_cuts, totals, rests = law
        home = (self.names % np.uint64(shards)).astype(np.int64)
        told, spelled = np.zeros((TOLD, len(self.names))), np.zeros((FOLDS + 1, len(self.names)))
        for h in np.unique(home):
            own, got = home == h, _unsqueezed(listed[h])
            told[:, own] = got[:TOLD]
            if h == shard:
                spelled[:, own] = got[TOLD:]
        w, v = counts.split()
        for m, n in enumerate(counts.n):
            total, different, once, twice = told[4 * m:4 * m + 4]
            one, two, three = cuts[m]
            cuts_of = np.array([0.0, one, two, three])
            after = np.bincount(w[n > 0], minlength=len(self.names))
            word_cut = np.array([0.0, *word_cuts[m]])[np.minimum(after, 3)]
            with np.errstate(divide="ignore", invalid="ignore"):
                rest = np.log((one * once + two * twice + three * (different - once - twice)) / total)
                unknown = np.log(rests[m]) - spelled[m] / STEPS
                known = np.where(after > word_cut, np.log((after - word_cut) / totals[m] + np.exp(unknown)), unknown)
                self.one.append(np.where(after > 0, unknown - known - np.where(total > 0, rest, 0.0), 0.0))
                self.two.append(np.zeros(len(n), np.float32))
                for at in range(0, len(n), 500_000):
                    own = slice(at, at + 500_000)
                    cut, lower = cuts_of[np.minimum(n[own], 3)], rest[v[own]] + known[w[own]]
                    self.two[m][own] = np.where(n[own] > cut, lower - np.log((n[own] - cut) / total[v[own]] + np.exp(lower)), 0.0)

    def of(self, p: _Pairs):
        """(tag, model, value) of the texts of a block."""
        w, v = _place(self.names, p.followers)[p.x], _place(self.names, p.contexts)[p.y]
        seen = np.flatnonzero((v >= 0) & (w >= 0))
        pair = _place(self.code, w[seen] * len(self.names) + v[seen])
        seen, pair = seen[pair >= 0], pair[pair >= 0]
        for m in np.unique(np.append(p.models, 0)):
            own = (p.models[p.row] == m) | (m == 0)
            value = np.zeros(len(w))
            if len(self.names):
                value = np.where(w >= 0, self.one[m][w], 0.0)
            value[seen] += self.two[m][pair]
            here = (p.models == m) | (m == 0)
            sums = np.bincount(p.row[own], (value * p.n)[own], len(p.tags)).astype(np.float64)
            here &= sums != 0
            yield pa.RecordBatch.from_arrays([pa.array(p.tags[here].view(np.int64)), pa.array(np.full(int(here.sum()), m, np.int32)),
                                              pa.array(sums[here])], ["tag", "model", "value"])


def _score(law):
    """(tag, model, value): what seen words and pairs change in the cost of each text, by shard."""
    def score(batches):
        for shard, rows in _shards(batches):
            listed, trusted, values = {}, [], None
            for _, kind, *dealt in rows:
                if kind == CONTEXTS:
                    listed[int.from_bytes(dealt[0], "big")] = dealt[2]
                elif kind != SCORE:
                    trusted.append((kind, dealt))
                else:
                    values = values or _Values(shard, _Counts([d for _, d in trusted]), listed, law)
                    yield from values.of(_Pairs(*dealt))
            values = values or _Values(shard, _Counts([d for _, d in trusted]), listed, law)
            for kind, dealt in trusted:
                if kind == BOTH:
                    yield from values.of(_Pairs(*dealt))
    return score


DEALT = "shard int, kind int, followers binary, contexts binary, pairs binary"


def _by_shard(rows: DataFrame, shards: int, *order: str) -> DataFrame:
    return rows.repartition(shards, order[0]).sortWithinPartitions(*order)


def word_model(texts: DataFrame, shared, shards: int) -> tuple[DataFrame, tuple, list[float]]:
    """What shards are told of their contexts; what holds for all shards; minus log of what each model leaves to unknown words;
    from (tag, model, kind, text) of trusted texts and all byte tables.

    A text's cost is the sum of its words' spelling and of that number per word and text, plus what its seen words and pairs
    change.
    """
    counts = _by_shard(texts.mapInArrow(_deal(shards, shared), DEALT), shards, "shard").mapInArrow(
        _count_pairs(shards), "home int, shard int, names binary, told binary")
    told = base.written(_by_shard(counts, shards, "home", "shard").mapInArrow(_sum_contexts, "shard int, home int, told binary"), "contexts")
    few = np.zeros((FOLDS + 1, 10))
    for row in told.where("home < 0").toLocalIterator():  # a hundred bytes a shard
        few += _unsqueezed(row["told"])[0].reshape(FOLDS + 1, 10)
    pairs, words = (_discounts_of({(m, k + 1): float(few[m, at + k]) for m in range(FOLDS + 1) for k in range(4)}) for at in (0, 4))
    totals, rests = [], []
    for m, (*_, a, b, c, d, total, different) in enumerate(few):
        d1, d2, d3 = words[m]
        totals.append(total or 1.0)
        rests.append((d1 * a + d2 * b + d3 * (different - a - b)) / total if total else 1.0)
    listed = told.where("home >= 0").select("shard", F.lit(CONTEXTS).alias("kind"), F.unhex(F.lpad(F.hex("home"), 8, "0")).alias("followers"),
                                            F.lit(None).cast("binary").alias("contexts"), F.col("told").alias("pairs"))
    return listed, (shards, pairs, words, totals, rests), [-float(np.log(x)) for x in rests]


def _spelling_costs(shared, rests, size_name, cost_name):
    """What a text costs before the join: its words' spelling, unknown words' share, and white space beyond one byte a word."""
    def score(batches):
        table, costs = classes(), shared.value
        for batch in batches:
            total, size = [], []
            models = batch.column(batch.num_columns - 2).to_numpy()
            for block in W.blocks(batch.column(batch.num_columns - 1), W.SPACES):
                n, own = np.diff(block.first), np.zeros(len(block))
                model, row = models[block.rows], block.word_rows()
                codes, edge = _spelling(block, table)
                rest = np.append(W.SPACES[block.data], False)  # white space but the one byte behind each word, if its text has one
                ends = block.ends[~np.isin(block.ends, block.bounds)]
                rest[ends] = False
                rest = np.flatnonzero(rest[:-1])
                spare = block_codes(block.data, block.bounds, table)[rest]
                of = np.searchsorted(block.bounds, rest, "right") - 1
                for m in np.unique(model):
                    here = model == m
                    mine = np.bincount(row, _spelled(codes, edge, costs[m]), len(block)) if len(row) else np.zeros(len(block))
                    mine += np.bincount(of, costs[m][spare], len(block)) if len(of) else 0.0
                    own[here] = (mine + np.where(n > 0, n + 1, 0) * rests[m])[here]
                total.append(own)
                size.append(np.diff(block.bounds))
            join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(join(size, np.int64)), pa.array(join(total, np.float64))],
                [*batch.schema.names[:-1], size_name, cost_name])
    return score


def _quantile(bins: DataFrame, by: list[str], quantile: float) -> DataFrame:
    """From counts ``n`` of bins; exact to one bin, of which there are at most a few thousand however many rows there are."""
    order = Window.partitionBy(*by).orderBy("bin")
    share = F.sum("n").over(order) / F.sum("n").over(Window.partitionBy(*by))
    return bins.withColumn("share", share).where(F.col("share") >= quantile).groupBy(*by).agg(
        (F.min("bin") / BINS).alias("limit"))


class Classifier:
    """The model, each language's mean and its thresholds, fitted on the trusted rows among ``docs``.

    Only ``doc_id``, ``text`` and ``lang`` are read; ``trusted`` holds ids of trusted documents.  A null or empty text has
    no perplexity and is rejected.  Without any trusted text there is no threshold and every text with symbols stays.  A
    null language counts as the empty one.  Equal rows get equal results.  A perplexity that equals a threshold stays.  Texts are read
    whole, in blocks; an empty table gives an empty one.
    """

    def __init__(self, docs: DataFrame, trusted: DataFrame, quantile: float = 0.995, slack: float = 1.05, prior: float = 100.0):
        self.docs, self.prior = docs, prior
        tag, fold = F.xxhash64("text"), F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")
        marked = mark_trusted(base.only(docs, "doc_id", "text", "lang"), trusted).withColumn("doc_id", F.col("doc_id").cast("long"))
        own = marked.where("trusted").select(tag.alias("tag"), (fold + 1).alias("model"), F.lit(COUNT).alias("kind"), "text")
        size = own.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        self.own, self.shards = own, max(SHARDS, -(-size // SHARD_BYTES))
        trained = train(counted(own.select("text", fold.alias("fold"))))
        share, rows = docs.sparkSession.sparkContext.broadcast, trained.toArrow()
        base.drop_scratch(trained)
        # Two bytes a number, at most 32 MB for all three, whatever the corpus is; what that rounds off averages out over a text's bytes.
        tables = [Stepped(dense(rows, k)) for k in range(FOLDS + 1)]
        self.cost = every = share(tables)
        del tables, rows
        self.listed, self.law, self.rests = word_model(own, every, self.shards)
        # Trusted texts are counted and scored in one pass with all others: by the model of all folds, and by that of the other fold.
        both = marked.select("doc_id", "lang", tag.alias("hash"), "trusted", "text", F.explode(
            F.when(F.col("trusted"), F.array(F.lit(0), fold + 1)).otherwise(F.array(F.lit(0)))).alias("model"))
        deal = marked.select(tag.alias("tag"), F.when(F.col("trusted"), fold + 1).otherwise(0).alias("model"),
                             F.when(F.col("trusted"), BOTH).otherwise(SCORE).alias("kind"), "text")
        self.scored = base.written(self._scored(both, every, deal=deal), "scored")
        good = self.scored.where("trusted and n_symbols > 0").withColumn("lang", F.coalesce("lang", F.lit("")))
        unseen = good.where("model > 0")
        mean = F.sum("cost") / F.sum("n_symbols")
        self.means = base.written(unseen.groupBy("lang").agg(mean.alias("mean")), "means")
        self.mean_all = base.written(unseen.agg(mean.alias("mean_all")), "mean")
        over = F.lit(float(np.log(slack)))
        rates = self._rated(good, "lang", "n_symbols", "cost")
        self.limits, self.limit_all = self._limits(rates.where("model > 0"), F.ceil(F.col("rate") * BINS), quantile, over, "limit")
        self.lows, self.low_all = self._limits(rates.where("model = 0"), F.floor(F.col("rate") * BINS), 1 - quantile, -over, "low")

    def _limits(self, rates: DataFrame, bin_, quantile: float, over, name: str) -> tuple[DataFrame, DataFrame]:
        binned = base.written(rates.withColumn("bin", bin_).groupBy("lang", "bin").agg(F.count("*").alias("n")), "bins")
        by_lang = _quantile(binned, ["lang"], quantile).select("lang", (F.col("limit") + over).alias(name))
        every = binned.groupBy("bin").agg(F.sum("n").alias("n")).withColumn("all", F.lit(1))
        for_all = _quantile(every, ["all"], quantile).select((F.col("limit") + over).alias(f"{name}_all"))
        return base.written(by_lang, f"{name}s"), base.written(for_all, name)

    def _scored(self, docs: DataFrame, shared, size: str = "n_symbols", cost: str = "cost", deal: DataFrame | None = None) -> DataFrame:
        """From the columns with ``text`` and ``model``: all but the text, and symbols and summed minus log probability of each.

        ``deal`` has what is sent to the shards for it, where that is not the trusted texts and then these.
        """
        tag, model, text, spelled, more, own_tag, own_model = base.unused(
            docs, "_tag", "_model", "_text", "_spelled", "_more", "_own", "_own_model")
        if deal is None:
            deal = self.own.unionByName(docs.select(
                F.xxhash64("text").alias("tag"), F.col("model").cast("int").alias("model"), F.lit(SCORE).alias("kind"), "text"))
        rows = docs.withColumns({tag: F.xxhash64("text"), model: F.col("model"), text: F.col("text")})
        sums = self._corrections(deal).toDF(own_tag, own_model, more)
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        kept = [c for c in rows.columns if c not in ("text", text)]
        schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], f"`{size}` long, `{spelled}` double"])
        local = rows.select(*[F.col(f"`{c}`") for c in kept], text).mapInArrow(_spelling_costs(shared, self.rests, size, spelled), schema)
        return local.join(sums, (F.col(tag) == F.col(own_tag)) & (F.col(model) == F.col(own_model)), "left").withColumn(
            cost, F.col(spelled) + F.coalesce(more, F.lit(0.0))).drop(tag, model, spelled, more, own_tag, own_model)

    def _corrections(self, rows: DataFrame) -> DataFrame:
        """(tag, model, value): what seen words and pairs change in the cost of a text by model 0 and its own, from (tag, model, kind, text)."""
        dealt = rows.mapInArrow(_deal(self.shards), DEALT).unionByName(self.listed)
        sums = _by_shard(dealt, self.shards, "shard", "kind").mapInArrow(_score(self.law), "tag long, model int, value double").groupBy(
            "tag", "model").agg(F.sum("value").alias("value"))
        copies = rows.where(F.col("kind") != COUNT).select("tag", F.explode(F.array_distinct(F.array(F.lit(0), "model"))).alias(
            "model")).groupBy("tag", "model").agg(F.count("*").alias("copies"))
        return base.written(sums.join(copies, ["tag", "model"]).select("tag", "model", F.col("value") / F.col("copies")), "costs")

    def _rated(self, rows: DataFrame, lang: str, size: str, cost: str) -> DataFrame:
        rows = rows.join(self.means.withColumnRenamed("lang", "_l"), F.coalesce(F.col(lang), F.lit("")) == F.col("_l"), "left")
        rows = rows.join(F.broadcast(self.mean_all), how="left")  # one row
        mean = F.coalesce("mean", "mean_all", F.col(cost) / F.col(size))
        return rows.withColumn("rate", F.when(F.col(size) > 0, (F.col(cost) + self.prior * mean) / (F.col(size) + self.prior))).drop(
            "_l", "mean", "mean_all")

    def _judged(self, docs: DataFrame, *names: str) -> DataFrame:
        """The named columns and hash, n_symbols, rate, most, least, kept; the corpus of the model has been scored with it."""
        if docs is self.docs:
            rows = self.scored.where("model = 0").select(*names, "hash", "n_symbols", "cost")
        else:
            own = base.only(docs, *names, "text").withColumns({"hash": F.xxhash64("text"), "model": F.lit(0)})
            rows = self._scored(own, self.cost)
        rows = self._rated(rows, "lang", "n_symbols", "cost")
        for own, every in ((self.limits, self.limit_all), (self.lows, self.low_all)):
            rows = rows.join(own.withColumnRenamed("lang", "_l"), F.coalesce("lang", F.lit("")) == F.col("_l"), "left").drop("_l")
            rows = rows.join(F.broadcast(every), how="left")
        return rows.withColumns({"most": F.coalesce("limit", "limit_all"), "least": F.coalesce("low", "low_all")}).withColumn(
            "kept", F.coalesce((F.col("rate") <= F.coalesce("most", F.lit(float("inf")))) & (F.col("rate") >= F.coalesce(
                "least", F.lit(float("-inf")))), F.lit(False)))

    def judged(self, docs: DataFrame) -> DataFrame:
        """doc_id, lang, n_symbols, perplexity, threshold, low_threshold, kept for every row; no text is shuffled."""
        return self._judged(docs, "doc_id", "lang").select(
            F.col("doc_id").cast("long").alias("doc_id"), "lang", "n_symbols", F.exp("rate").alias("perplexity"), F.exp("most").alias("threshold"),
            F.exp("least").alias("low_threshold"), "kept")

    def keep(self, docs: DataFrame) -> DataFrame:
        """The documents that stay, all columns.  Their text meets the verdicts by its hash and language."""
        tag, lang = base.unused(docs, "_tag", "_lang")
        kept = self._judged(docs, "lang").where("kept").select(F.col("hash").alias(tag), F.coalesce("lang", F.lit("")).alias(lang)).distinct()
        rows = docs.withColumns({tag: F.xxhash64("text"), lang: F.coalesce("lang", F.lit(""))})
        return rows.join(kept, [tag, lang], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def trusted_ids(spark, sf_dir) -> DataFrame:
    return base.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op4(spark, sf_dir):
    docs = base.table(spark, sf_dir, "documents")
    return Classifier(docs, trusted_ids(spark, sf_dir)).judged(docs)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
