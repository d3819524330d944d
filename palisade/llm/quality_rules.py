"""Quality rules: counts with fixed limits, then a logistic regression on hashed word and character n-grams.

Counts are taken over whole texts: characters in words, symbols, lines that repeat an earlier one, and words in
``WINDOW``-word windows that stand in the text twice or more.

The model sees the shares of hashed words, word pairs and character trigrams (``BUCKETS`` places each), so a text's
score is a mean of weights and needs no feature rows.  It is fitted on at most ``sample`` labelled documents, those with
the smallest hash of their id (a documented bound; their features, not their texts, reach the one task that fits); a quarter
of them is held out to calibrate the probability by Platt's method.  All documents are scored in Arrow batches.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from palisade.llm import base, words as W

WINDOW, BUCKETS = 8, 1 << 17
SYMBOLS = W.byte_table(b"#*$%&|<>")
NEW_LINE = W.byte_table([10])


def _row_counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def _within(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within a text."""
    return W.mix(hashes + (rows.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def block_counts(block: W.Block, words: np.ndarray, hasher: W.Hasher) -> dict[str, np.ndarray]:
    n, total = len(block), len(words)
    per_row = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[block.bounds])
    starts, ends, first = W.find_words(block.data, block.bounds, NEW_LINE)
    lines = W.Block(block.rows, block.data, block.bounds, starts, ends, first)
    text = np.concatenate([[0], np.cumsum(~W.SPACES[block.data])])
    full = text[ends] > text[starts]
    line_rows = lines.word_rows()[full]
    _, where = np.unique(_within(hasher.words(lines)[full], line_rows), return_index=True)
    dup_lines = _row_counts(line_rows, n) - _row_counts(line_rows[where], n)
    word_rows = block.word_rows()
    fits = W.run_starts(block.first, WINDOW, total)
    at = np.flatnonzero(fits)
    repeat = np.zeros(n, np.int64)
    if len(at):
        _, inverse, times = np.unique(_within(hasher.runs(words, WINDOW)[at], word_rows[at]), return_inverse=True, return_counts=True)
        again = at[times[inverse] > 1]
        edge = np.zeros(total + 1, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + WINDOW, -1)
        repeat = _row_counts(word_rows[np.cumsum(edge[:-1]) > 0], n)
    return {"n_words": np.diff(block.first).astype(np.int64),
            "word_chars": per_row(~W.SPACES[block.data] & ((block.data & 0xC0) != 0x80)).astype(np.int64),
            "n_symbols": per_row(SYMBOLS[block.data]).astype(np.int64), "n_dup_lines": dup_lines, "n_repeat_words": repeat}


def block_features(block: W.Block, words: np.ndarray, hasher: W.Hasher):
    """Per kind of n-gram: its buckets, and where each text's begin and end."""
    bucket = lambda h, kind: (h >> np.uint64(47)).astype(np.int32) + np.int32(kind * BUCKETS)
    out = [(bucket(words, 0), block.first)]
    pairs = np.flatnonzero(W.run_starts(block.first, 2, len(words)))
    out.append((bucket(hasher.runs(words, 2)[pairs], 1) if len(pairs) else np.zeros(0, np.int32), np.searchsorted(pairs, block.first)))
    d = block.data.astype(np.uint32)
    grams = np.zeros(max(0, len(d) - 2), np.uint32) if len(d) < 3 else d[:-2] | d[1:-1] << np.uint32(8) | d[2:] << np.uint32(16)
    keep = np.ones(len(grams), bool)
    for back in (1, 2):  # trigrams over a text's end
        cut = block.bounds[1:-1] - back
        cut = cut[(cut >= 0) & (cut < len(keep))]
        keep[cut] = False
    places = np.flatnonzero(keep)
    hashed = (grams[places] * np.uint32(0x9E3779B1)) >> np.uint32(15)
    out.append((hashed.astype(np.int32) + np.int32(2 * BUCKETS), np.searchsorted(places, block.bounds)))
    return out


def _featurise(batches):
    hasher = W.Hasher()
    for batch in batches:
        cols, vals = [], []
        for block in W.blocks(batch.column(2), W.SPACES, block_bytes=500_000):
            kinds = block_features(block, hasher.words(block), hasher)
            for i in range(len(block)):
                own = [np.unique(b[f[i]:f[i + 1]], return_counts=True) for b, f in kinds]
                cols.append(np.concatenate([c for c, _ in own]).astype(np.int32).tobytes())
                vals.append(np.concatenate([(n / max(1, n.sum())) for _, n in own]).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(cols, pa.binary()), pa.array(vals, pa.binary())],
            ["doc_id", "label", "cols", "vals"])


def fit_logistic(labels, rows, cols, vals, n_cols, steps=150, rate=2.0, decay=1e-6):
    """Weights and bias by full-batch gradient steps with momentum scaling."""
    weights, bias = np.zeros(n_cols), 0.0
    first, second, b1, b2 = np.zeros(n_cols), np.zeros(n_cols), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.bincount(rows, weights=vals * weights[cols], minlength=len(labels)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(labels)
        grad = np.bincount(cols, weights=vals * error[rows], minlength=n_cols) + decay * weights
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        b1, b2 = 0.9 * b1 + 0.1 * error.sum(), 0.99 * b2 + 0.01 * error.sum()**2
        near, far = 1 - 0.9**step, 1 - 0.99**step
        weights -= rate * (first / near) / (np.sqrt(second / far) + 1e-6)
        bias -= 0.1 * (b1 / near) / (np.sqrt(b2 / far) + 1e-9)
    return weights, bias


def platt(scores, labels, steps=200):
    """a, b with P(good) = 1 / (1 + exp(-(a * score + b))), by Newton's method on smoothed labels."""
    good = labels.sum()
    t = np.where(labels > 0, (good + 1) / (good + 2), 1 / (len(labels) - good + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * scores + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - t) * scores).sum() + 1e-3 * (a - 1), (p - t).sum()])
        h = np.array([[(w * scores * scores).sum() + 1e-3, (w * scores).sum()], [(w * scores).sum(), w.sum() + 1e-9]])
        move = np.linalg.solve(h, g)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
        if abs(move).max() < 1e-8:
            break
    return float(a), float(b)


MODEL = "weights binary, bias double, a double, b double"


def _fit(table: pa.Table) -> pa.Table:
    table = table.sort_by([("doc_id", "ascending"), ("cols", "ascending")])
    labels = table["label"].to_numpy().astype(float)
    cols = [np.frombuffer(x, np.int32) for x in table["cols"].to_pylist()]
    vals = [np.frombuffer(x, np.float32) for x in table["vals"].to_pylist()]
    held = np.arange(len(labels)) % 4 == 3
    weights, bias, a, b = np.zeros(3 * BUCKETS), 0.0, 1.0, 30.0  # without two classes everything is good
    if 0 < labels[~held].sum() < (~held).sum():
        own = np.flatnonzero(~held)
        rows = np.repeat(np.arange(len(own)), [len(cols[i]) for i in own])
        weights, bias = fit_logistic(labels[own], rows, np.concatenate([cols[i] for i in own]),
                                     np.concatenate([vals[i] for i in own]).astype(float), len(weights))
        a, b = 1.0, 0.0
        if 0 < labels[held].sum() < held.sum():
            scores = np.array([(weights[cols[i]] * vals[i]).sum() + bias for i in np.flatnonzero(held)])
            a, b = platt(scores, labels[held])
    return pa.table({"weights": pa.array([weights.astype(np.float32).tobytes()], pa.binary()),
                     "bias": [float(bias)], "a": [a], "b": [b]})


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000):
    """Weights, bias and calibration from labelled rows (doc_id, label 0 or 1)."""
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(
        F.col("doc_id").alias("_id"), F.col("label").cast("double").alias("label"))
    rows = docs.join(F.broadcast(known), docs["doc_id"] == F.col("_id")).select("doc_id", "label", "text")
    features = rows.mapInArrow(_featurise, "doc_id long, label double, cols binary, vals binary")
    model = features.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(_fit, MODEL).first()
    if model is None:
        return np.zeros(3 * BUCKETS, np.float32), 0.0, 1.0, 30.0
    return np.frombuffer(model["weights"], np.float32), model["bias"], model["a"], model["b"]


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _score(shared):
    def score(batches):
        weights, bias, a, b = shared.value
        hasher = W.Hasher()
        for batch in batches:
            parts, good = [], []
            for block in W.blocks(batch.column(1), W.SPACES):
                words = hasher.words(block)
                parts.append(block_counts(block, words, hasher))
                z = np.full(len(block), bias)
                for buckets, bounds in block_features(block, words, hasher):
                    sums = np.concatenate([[0.0], np.cumsum(weights[buckets], dtype=np.float64)])
                    z += np.diff(sums[bounds]) / np.maximum(np.diff(bounds), 1)
                good.append(1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))))
            join = lambda x: pa.array(np.concatenate(x))
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[join([p[c] for p in parts]) for c in COUNTS], join(good)], ["doc_id", *COUNTS, "p_good"])
    return score


def judged(docs: DataFrame, labels: DataFrame, sample: int = 4000, threshold: float = 0.5, least_words: int = 20, most_repeat: int = 30):
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, p_good, base_failed, kept for every row.

    Only ``doc_id`` and ``text``, and ``doc_id`` and ``label``, are read.  A null or empty text has no words and fails.
    Labels of documents that are missing, null labels and null ids are passed over; of a repeated id the larger label
    counts.  Without labels of both kinds every text counts as good.  A probability equal to the threshold stays.  Equal rows get
    equal results.  Texts are read whole; an empty table gives an empty one.
    """
    own = base.only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    model = docs.sparkSession.sparkContext.broadcast(train(own, labels, sample))
    schema = ", ".join(["doc_id long", *[f"{c} long" for c in COUNTS], "p_good double"])
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))
    return own.mapInArrow(_score(model), schema).withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def op8(spark, sf_dir):
    labels = base.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return judged(base.table(spark, sf_dir, "documents"), labels)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
