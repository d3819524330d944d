"""Mixing sources to target weights by subset-sum budget fitting.

Sources by code point, null last, carry the weights in turn and share the words of all sources.  A target stops at
``most`` times its source's words; what is over goes to the others by weight.  In closed form: with the
sources in the order of limit per weight, the level at which the shares add up is the largest of the levels that follow
from treating the sources before each as full.

A target is whole passes over its source plus a budget below one pass.  Documents are counted by exact length.  Of each
length the budget's share, rounded down, is taken; single documents of the lengths that lost most by the
rounding follow; the last ``fit_words`` words are a bounded knapsack (dynamic programming over a bit set of reachable
sums).  Which documents of a length are taken follows from a seeded hash, so reruns agree.

A length of one source may hold a third of all rows: documents are ranked inside 1,024 ranges of the seeded hash, each of
which knows how many the plan leaves to it.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from palisade.llm import base

WEIGHTS = (5, 2, 1)
RANGES = 1024


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size, target from (source, source_size), one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    w = sizes.withColumn("weight", pick).withColumn("limit", F.col("source_size") * most)
    fuller = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = fuller.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = w.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return level.select("source", "source_size", F.least(
        F.col("limit").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def fit_budget(counts: list[tuple[int, int]], budget: int, total: int, fit_words: int) -> dict[int, int]:
    """How many documents of each length to take so that their lengths add up to the budget as nearly as can be."""
    counts = [(size, n) for size, n in counts if size > 0]
    if budget <= 0 or not counts:
        return {}
    if budget >= total:
        return dict(counts)
    take = {size: n * budget // total for size, n in counts}
    left = budget - sum(size * n for size, n in take.items())
    for size, n in sorted(counts, key=lambda c: (-(c[1] * budget % total), c[0])):
        if left <= fit_words:
            break
        if take[size] < n and size <= left:
            take[size] += 1
            left -= size
    # Bounded knapsack: bit s of `reach` says that s words can be made up of the documents seen so far.
    mask, reach, seen = (1 << (left + 1)) - 1, 1, []
    for size, n in counts:
        rest = min(n - take[size], left // size)
        part = 1
        while rest > 0:
            part = min(part, rest)
            seen.append((size, part, reach))
            reach |= (reach << (size * part)) & mask
            rest, part = rest - part, part * 2
        if reach == mask:
            break
    at = reach.bit_length() - 1
    for size, n, before in reversed(seen):
        if not before >> at & 1:
            take[size] += n
            at -= size * n
    return take


def _plan(fit_words: int):
    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        total, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        passes = int(target // total) if total else 0
        counts = sorted(zip(rows["size"].tolist(), rows["n"].tolist()))
        take = fit_budget(counts, round(target - passes * total), total, fit_words)
        return pd.DataFrame({"source": rows["source"], "size": rows["size"], "passes": passes,
                             "extra": [take.get(s, 0) for s in rows["size"].tolist()]})
    return plan


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = 3, seed: int = 42, fit_words: int = 100_000):
    """The documents with four more columns, and the names these got: size, source_size, target, copies.

    ``copies`` (0 to ``most``) says how often a row is taken.  Only ``doc_id``, ``text`` and ``source`` are read.  A null
    or empty text has size 0 and is not taken.  A null source is a source of its own.  Equal rows are told
    apart only by how many of them are taken.  A long text is counted whole; an empty table gives an empty one.
    """
    size, source_size, target, copies, span, hashed = names = base.unused(
        docs, "size", "source_size", "target", "copies", "_span", "_hash")
    rows = docs.withColumn(hashed, F.xxhash64(F.lit(seed), "doc_id")).withColumns(
        {size: n_words(F.col("text")), span: F.shiftrightunsigned(hashed, 54)})
    spans = base.written(rows.groupBy(F.col("source").alias("source"), F.col(size).alias("size"), F.col(span).alias("span"))
                         .agg(F.count("*").alias("n")), "spans")
    lengths = spans.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = lengths.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    aims = base.written(targets(sizes, weights, most), "targets")
    same = F.col("l.source").eqNullSafe(F.col("r.source"))
    plan = lengths.alias("l").join(aims.alias("r"), same).select("l.source", "size", "n", "source_size", "target")
    kind = docs.schema["source"].dataType.simpleString()
    plan = base.written(plan.groupBy("source").applyInPandas(
        _plan(fit_words), f"source {kind}, size long, passes long, extra long"), "plan")
    # Ranges of the hash in turn use up what the plan takes of their length.
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("span").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    ranges = spans.withColumn("before", before).alias("l").join(
        plan.alias("r"), same & (F.col("l.size") == F.col("r.size"))).select(
        "l.source", "l.size", "span", "passes", F.greatest(F.lit(0), F.col("extra") - F.col("before")).alias("extra"))
    place, *held = base.unused(rows, "_place", "_source", "_length", "_range", "_passes", "_extra", "_total", "_target")
    ranges = ranges.alias("l").join(aims.alias("r"), same).select(
        "l.source", "size", "span", "passes", "extra", "source_size", "target").toDF(*held)
    source, length, range_, passes, extra, total, aim = map(F.col, held)
    rank = F.row_number().over(Window.partitionBy("source", size, span).orderBy(hashed, "doc_id"))
    own = rows.withColumn(place, rank).join(
        ranges, F.col("source").eqNullSafe(source) & (F.col(size) == length) & (F.col(span) == range_))
    out = own.select(
        *[F.col(f"`{c}`") for c in docs.columns], size, total.alias(source_size), aim.alias(target),
        F.when(F.col(size) > 0, passes + (F.col(place) <= extra).cast("long")).otherwise(0).cast("long").alias(copies))
    return out, names[:4]


def take(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: every row as often as it is taken, columns as before."""
    out, (_, _, _, copies) = mixed(docs, **settings)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))
    (copy,) = base.unused(out, "_copy")
    return out.where(F.col(copies) > 0).withColumn(copy, each).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5(spark, sf_dir):
    out, (size, source_size, target, copies) = mixed(
        base.only(base.table(spark, sf_dir, "documents"), "doc_id", "source", "text"))
    return out.select("doc_id", size, source_size, target, (F.col(copies) * F.col(size)).alias("taken"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
