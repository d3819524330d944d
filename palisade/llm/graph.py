"""Connected components over an edge table, in rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palisade.llm import base


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of an edge table (a, b) reaches.

    Every round hangs each node's larger neighbours on its smallest one, then its smaller neighbours likewise, until
    the edge set stays as it is; the number of rounds grows with the logarithm of the longest path.  Minima combine
    before the shuffle, the joins behind them may be split by Spark, and each round is written to the shared folder.
    """
    now = base.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                       .where("u <> v").distinct(), "edges")
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        done = base.written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        base.drop_scratch(now)
        now, before, state = done, state, _state(done)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
