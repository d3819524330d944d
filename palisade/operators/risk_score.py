"""Source risk metrics, daily trend rows and drift between scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.functions import risk
from palisade.operators import store
from palisade.rules import SEVERITY_WEIGHTS

TYPES = ("pii", "confidential", "abuse", "custom")


def severity_weight(level: Column) -> Column:
    expr = F.lit(1.0)
    for name, weight in SEVERITY_WEIGHTS.items():
        expr = F.when(F.lower(level) == name, weight).otherwise(expr)
    return expr


def _type(check_type: Column) -> Column:
    low = F.lower(F.coalesce(check_type, F.lit("custom")))
    return F.when(low.isin(*TYPES), low).otherwise("custom")


#: What is kept per key and entity: weights, highest rank, findings, findings by type.
PARTIALS = ("w", "r", "n", *TYPES)


def entity_partials(results: DataFrame, keys=("source_id",)) -> DataFrame:
    """Mergeable parts of the metrics, one row per key and entity."""
    kind = _type(F.col("check_type"))
    return results.groupBy(*keys, "entity_name").agg(
        F.sum(severity_weight(F.coalesce("risk_level", F.lit("low")))).alias("w"),
        F.max(risk.rank(F.lower("risk_level"))).alias("r"), F.count(F.lit(1)).alias("n"),
        *[F.count_if(kind == t).alias(t) for t in TYPES])


def merge_partials(partials: DataFrame, keys=("source_id",)) -> DataFrame:
    return partials.groupBy(*keys, "entity_name").agg(*[(F.max if c == "r" else F.sum)(c).alias(c) for c in PARTIALS])


def risk_metrics(results: DataFrame, totals: DataFrame | None = None, keys=("source_id",)) -> DataFrame:
    """Score, compliance, highest risk and counts per key.

    ``totals``: rows of ``keys`` + ``total_columns``; keys without results then
    score zero.  Distinct entities are counted by a first aggregate on
    (key, entity), so a hot source spreads over its entities.
    """
    return metrics_of(entity_partials(results, keys), totals, keys)


def metrics_of(per_entity: DataFrame, totals: DataFrame | None = None, keys=("source_id",)) -> DataFrame:
    """The same from one row of partials per key and entity."""
    keys = list(keys)
    raw = per_entity.groupBy(*keys).agg(
        F.sum("w").alias("w"), F.max("r").alias("r"), F.sum("n").alias("total_violations"),
        F.count(F.lit(1)).alias("entities"), *[F.sum(t).alias(f"{t}_count") for t in TYPES])
    if totals is not None:
        raw = totals.select(*keys, "total_columns").join(raw, keys, "left")
    else:
        raw = raw.withColumn("total_columns", F.lit(0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = F.least(F.lit(100.0), F.bround(F.coalesce("w", F.lit(0.0)), 1))
    share = F.bround(F.greatest(F.lit(0.0), (1 - zero("entities") / F.nullif(F.col("total_columns"), F.lit(0))) * 100), 1)
    compliance = F.when(zero("total_violations") == 0, 100.0).when(F.col("total_columns") > 0, share) \
        .otherwise(F.greatest(F.lit(0.0), 100.0 - score))
    return raw.select(
        *keys, score.alias("risk_score"), compliance.alias("compliance_pct"),
        risk.label(zero("r")).alias("highest_risk"), *[zero(f"{t}_count").alias(f"{t}_count") for t in TYPES],
        zero("total_violations").alias("total_violations"))


TREND = ("source_id", "trend_date", "risk_score", "pii_count", "confidential_count", "abuse_count",
         "custom_count", "total_violations", "compliance_pct")


def trend_rows(metrics: DataFrame, day: Column) -> DataFrame:
    return metrics.withColumn("trend_date", day).select(*TREND)


def scan_page_trend(metrics: DataFrame, day: Column) -> DataFrame:
    """The variant stored after a scan: compliance is what the score leaves of one hundred."""
    return trend_rows(metrics.withColumn("compliance_pct", F.greatest(F.lit(0.0), 100.0 - F.col("risk_score"))), day)


def upsert_trend(trends: DataFrame, fresh: DataFrame, order: Column | None = None) -> DataFrame:
    return store.upsert(trends, fresh, "source_id", "trend_date", order=order)


def last_trends(trends: DataFrame, n: int = 30) -> DataFrame:
    """Last n rows per source in time order; ``position`` counts them from the oldest kept."""
    kept = store.newest_per(trends, n, "source_id", "trend_date").drop("_rank")
    time = Window.partitionBy("source_id").orderBy("trend_date")
    return kept.withColumn("position", F.row_number().over(time)).orderBy("source_id", "trend_date")


def latest_trends(trends: DataFrame) -> DataFrame:
    return store.latest_per(trends, "source_id", "trend_date")


def tile_risk(pct: Column) -> Column:
    return F.when(pct < 70, "critical").when(pct < 85, "high").when(pct < 95, "medium").otherwise("low")


def gauge_band(pct: Column) -> Column:
    return F.when(pct < 70, "red").when(pct < 90, "amber").otherwise("green")


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of an entity's risk between two scans of a source."""
    def side(df, name):
        return df.groupBy("source_id", "entity_name").agg(F.max(risk.rank(F.col("risk_level"))).alias(name))

    pair = side(before, "b").join(side(after, "a"), ["source_id", "entity_name"], "full_outer")
    b, a = F.col("b"), F.col("a")
    kind = F.when(b.isNull(), "new").when(a.isNull(), "resolved").when(a > b, "escalated").when(a < b, "reduced")
    return pair.select(
        "source_id", "entity_name", F.when(b.isNotNull(), risk.label(b)).alias("risk_before"),
        F.when(a.isNotNull(), risk.label(a)).alias("risk_after"),
        (F.coalesce(a, F.lit(-1)) - F.coalesce(b, F.lit(-1))).alias("risk_delta"),
        kind.alias("drift_type")).where(F.col("drift_type").isNotNull())
