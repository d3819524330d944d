"""Medians judged by counts, against sorting."""

import random
import statistics

from pyspark.sql import functions as F

import __spark_entry__ as entry
from palisade.sources.columns import exact_distinct, median_between

SF = "/root/testdata/sf0.001"


def test_median_between_agrees_with_sorting(spark):
    rng = random.Random(3)
    cases = [[], [None, None], [2.0], [1.0, 4.0], [None, 3.0, 3.0]] + [
        [rng.choice([None, *map(float, range(6))]) for _ in range(rng.randint(1, 7))] for _ in range(300)]
    rows, want = [], {}
    for i, values in enumerate(cases):
        low = rng.randint(0, 8) / 2
        high = low + rng.randint(0, 4) / 2
        held = [v for v in values if v is not None]
        want[i] = low <= statistics.median(held) <= high if held else None
        rows += [(i, v, low, high) for v in values or [None]]
    df = spark.createDataFrame(rows, "i int, v double, low double, high double")
    got = df.groupBy("i").agg(median_between(F.col("v"), F.col("low"), F.col("high")).alias("ok")).collect()
    assert {r["i"]: r["ok"] for r in got} == want and len(set(want.values())) == 3


def test_exact_distinct_passes_over_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "a")], "`a b` int, c string")
    assert {tuple(r) for r in exact_distinct(df, df.columns).collect()} == {("a b", 2), ("c", 1)}


def test_merged_statistics_gather_no_values(spark):
    df = entry.queries()["src_col_stats_merged"](spark, SF)
    assert "percentile(" not in df._jdf.queryExecution().optimizedPlan().toString()
