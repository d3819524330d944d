"""Data-source scan: snapshots in; changes, findings, scores, trend rows and alerts out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.operators import alerts as A
from palisade.operators import changes as C
from palisade.operators import classify as K
from palisade.operators import risk_score as RS
from palisade.operators.store import newest_per

COLUMN = ("source_id", "table_name", "column_name")


def first_samples(values: DataFrame, value: str, n: int = 10) -> DataFrame:
    """Up to n distinct sample values per column, repeatably: those with the least hash.

    Repeats are removed by a partial aggregate and the rank limit runs before
    the shuffle, so a column holding most of the rows stays cheap.
    """
    distinct = values.where(F.col(value).isNotNull()).select(*COLUMN, F.col(value).cast("string").alias("v")).distinct()
    keyed = distinct.withColumn("_h", F.md5("v"))
    # newest_per ranks downwards; complementing the hash digits turns "least" into "newest".
    flipped = keyed.withColumn("_f", F.translate("_h", "0123456789abcdef", "fedcba9876543210"))
    kept = newest_per(flipped, n, COLUMN, "_f")
    return kept.groupBy(*COLUMN).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_h", "v"))), lambda x: x["v"]).alias("samples"))


def score_sources(results: DataFrame, columns: DataFrame) -> DataFrame:
    """Risk metrics of every source in the catalog."""
    totals = columns.groupBy("source_id").agg(F.count(F.lit(1)).alias("total_columns"))
    return RS.risk_metrics(results, totals)


def scan_sources(prev_columns: DataFrame, curr_columns: DataFrame, prev_tables: DataFrame, curr_tables: DataFrame,
                 day: Column, samples: DataFrame | None = None) -> dict:
    """Changes, scan results of the sources that need a scan, metrics and trend rows."""
    changes = C.detect_changes(prev_columns, curr_columns, prev_tables, curr_tables)
    due = C.should_scan(changes).where("should_scan").select("source_id")
    columns = curr_columns.join(due, "source_id", "left_semi")
    if samples is not None:
        columns = columns.join(samples, list(COLUMN), "left")
    results = K.scan_columns(columns, samples="samples" if samples is not None else None)
    metrics = score_sources(results, columns)
    return {"changes": changes, "results": results, "metrics": metrics, "trend": RS.scan_page_trend(metrics, day)}


def raise_alerts(scans: DataFrame, configs: DataFrame) -> DataFrame:
    """Messages of the alerts that leave after matching and cooldown."""
    fired = A.match_alerts(scans, A.active_configs(configs)).withColumn("sent_at", F.col("scanned_at"))
    return A.alert_message(A.apply_cooldown(fired))
