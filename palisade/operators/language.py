"""The language of a text by naive Bayes over character n-grams, with profiles fitted on texts of known language.

A text is lowered, everything but letters becomes one space, and its n-grams of one to ``LONGEST`` characters are counted, by a hash into
a fixed number of features; short ones tell languages apart that write without spaces.  Profiles are counts per language and
feature, summed in each task first, so what is fitted on grows with the table and what is kept does not: a row of
``FEATURES`` numbers per language.
"""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

FEATURES, LONGEST = 1 << 15, 3
#: Languages that are told apart at most; a table with more has something else in its language column.
MOST = 500
#: Characters that are looked at together; a longer text goes in slices of so many.
SLICE = 2_000_000


@cache
def _letters() -> np.ndarray:
    """Every code point's lower case, or 32 where it is no letter."""
    return np.array([ord(c.lower()[0]) if (c := chr(i)).isalpha() or 0x0300 <= i < 0x0370 else 32 for i in range(0x110000)], np.uint32)


def features(text: str):
    """Counts of the features of a text, slice by slice: (numbers, counts)."""
    for at in range(0, len(text), SLICE):
        own = np.frombuffer(text[at:at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        own = np.concatenate([[np.uint32(32)], _letters()[own], [np.uint32(32)]]).astype(np.uint64)
        own = own[np.append(True, (own[1:] != 32) | (own[:-1] != 32))]
        if len(own) < 2:
            continue
        code, found = np.zeros(len(own), np.uint64), []
        for n in range(1, min(LONGEST, len(own)) + 1):
            code = code[:len(own) - n + 1] * np.uint64(0x110001) + own[n - 1:] + np.uint64(1)
            found.append((code if n > 1 else code[own != 32]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - FEATURES.bit_length() + 1))
        yield np.unique(np.concatenate(found).astype(np.int64), return_counts=True)


def _count(batches):
    total = {}
    for batch in batches:
        for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
            if lang not in total:
                if len(total) >= MOST:
                    raise ValueError(f"more than {MOST} languages")
                total[lang] = np.zeros(FEATURES, np.int64)
            for numbers, counts in features(text):
                total[lang][numbers] += counts
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "feature", "n"])


class LanguageModel:
    """Profiles of the languages of a table; only rows with a text and a language count, the language's name as it is."""

    def __init__(self, rows: DataFrame, text: str = "text", lang: str = "lang", least_letters: int = 12):
        known = rows.where(F.col(text).isNotNull() & (F.coalesce(F.col(lang), F.lit("")) != "")).select(text, lang)
        counts = known.mapInArrow(_count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
        names, at = np.unique(np.array(counts.column("lang").to_pylist(), dtype=str), return_inverse=True)
        if len(names) > MOST:
            raise ValueError(f"more than {MOST} languages")
        table = np.full((len(names), FEATURES), 0.5)
        table[at, counts.column("feature").to_numpy()] += counts.column("n").to_numpy()
        self.names, self.least_letters = names.tolist(), least_letters
        self.costs = -np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)

    def of(self, text: str | None) -> tuple[str | None, float | None]:
        """The likeliest language and by how much, per n-gram, it is likelier than the next one; (None, None) for a text of
        few letters and where no language is known.  Equally likely ones go by name."""
        total, n, letters = np.zeros(len(self.names)), 0, 0
        for numbers, counts in features(text or ""):
            total += self.costs[:, numbers] @ counts
            n += int(counts.sum())
        letters = n // LONGEST
        if letters < self.least_letters or not self.names:
            return None, None
        order = np.argsort(total, kind="stable")
        margin = float((total[order[1]] - total[order[0]]) / n) if len(order) > 1 else float("inf")
        return self.names[order[0]], margin

    def detected(self, pages: DataFrame, text: str = "text", into: str = "language", margin: str = "language_margin") -> DataFrame:
        """The pages with their language and its margin; the model (a few hundred kilobytes a language) is sent once."""
        shared = pages.sparkSession.sparkContext.broadcast(self)
        names = {f.name: f.dataType.simpleString() for f in pages.schema}
        if {into, margin} & set(names):
            raise ValueError(f"a column {into} or {margin} is there already")

        def find(batches):
            model = shared.value
            for batch in batches:
                found = [model.of(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array(
                    [f[1] for f in found], pa.float64())], [*batch.schema.names, into, margin])
        return pages.mapInArrow(find, ", ".join([*[f"`{k}` {v}" for k, v in names.items()], f"`{into}` string, `{margin}` double"]))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
