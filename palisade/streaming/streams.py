"""The same work on streams: scanning, trend rows, cooldown, duplicate findings.

Each function takes streaming DataFrames and returns one; the caller chooses
sink, trigger and checkpoint.  State is per key and small: open windows, one
timestamp per alert rule and source, ids within the watermark.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from palisade.functions.shared import written
from palisade.operators.alerts import NEVER, gap_seconds, whole_seconds
from palisade.operators.detect import explode_findings
from palisade.plans.scan import detect_all
from palisade.operators.risk_score import TYPES, entity_partials, merge_partials, metrics_of, trend_rows
from palisade.operators.scoring import CHECKS
from palisade.operators.versioned import VersionedTable


def read_pages(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """A stream of the page files that arrive under ``path``."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def scan_stream(pages: DataFrame, rules: dict | None = None) -> DataFrame:
    """Findings of arriving pages.  The detectors keep no state, so the batch expressions apply as they are."""
    return explode_findings(detect_all(pages, rules), {c: c for c in CHECKS})


PARTIAL = ("source_id string, trend_date date, entity_name string, w double, r int, n bigint, "
           + ", ".join(f"{t} bigint" for t in TYPES))
TREND_ROW = ("source_id string, trend_date date, risk_score double, pii_count bigint, confidential_count bigint, abuse_count bigint, "
             "custom_count bigint, total_violations bigint, compliance_pct double")


def trend_store(spark: SparkSession, root: str) -> tuple[VersionedTable, VersionedTable]:
    """What is kept per source, day and entity, and the trend rows; both in a part per day."""
    return VersionedTable(spark, f"{root}/partials", PARTIAL), VersionedTable(spark, f"{root}/trend", TREND_ROW)


def fold_trend(batch: DataFrame, number: int, root: str, total_columns: int = 20) -> None:
    """Merge one micro-batch: of what is stored only the days it touches are read and replaced.

    A batch commits as version ``number + 1`` of either table, so one that is repeated after a failure finds what it has done.
    """
    spark, keys = batch.sparkSession, ["source_id", "trend_date"]
    partials, trend = trend_store(spark, root)
    rows = entity_partials(batch.withColumn("trend_date", F.col("day").cast("date")), keys)
    day = F.coalesce(F.date_format("trend_date", "yyyy-MM-dd"), F.lit("none"))
    rows = written(rows, "batch")
    days = [r[0] for r in rows.select(day).distinct().collect()]
    if not days:
        return
    if partials.version() <= number:
        names = partials.schema.names
        partials.replace(merge_partials(partials.read(days).select(*names).unionByName(rows.select(*names)), keys), day, days, number + 1)
    if trend.version() <= number:
        own = partials.read(days)
        totals = own.select(*keys).distinct().withColumn("total_columns", F.lit(total_columns))
        trend.replace(trend_rows(metrics_of(own, totals, keys), F.col("trend_date")), day, days, number + 1)


def run_trend(findings: DataFrame, root: str, total_columns: int = 20) -> None:
    """Keep daily trend rows of a stream of findings (``source_id, day, entity_name, check_type, risk_level``) until it is used up.

    Findings are kept as sums per source, day and entity, from which all measures of a day follow, distinct entities included.
    A day's row is there as soon as its first finding is, and right after every batch; none waits for a watermark.
    """
    query = (findings.writeStream.foreachBatch(lambda batch, number: fold_trend(batch, number, root, total_columns))
             .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
    query.awaitTermination()


def read_trend(spark: SparkSession, root: str) -> DataFrame:
    """The trend row of every source and day."""
    return trend_store(spark, root)[1].read()


def dedupe_stream(findings: DataFrame, time: str, key: str, delay: str = "1 hour") -> DataFrame:
    """Each finding id once within the watermark."""
    return findings.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


# What is below runs in Python workers, which need not have this package on
# their path: send it by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ALERT = "config_id string, source_id string, time timestamp, second bigint, gap bigint"
SENT = "config_id string, source_id string, second bigint"


def _least_gaps(frames):
    """Of the alerts of one second the one with the shortest gap, before anything is shuffled; those without a gap all stay."""
    for frame in frames:
        held = frame[frame["gap"] > 0]
        least = held.loc[held.groupby(["config_id", "source_id", "second"], dropna=False)["gap"].idxmin()]
        yield pd.concat([least, frame[frame["gap"] <= 0]])


class Cooldown(StatefulProcessor):
    """The second of the last alert sent, per rule and source.

    With a longest gap, a timer at the end of the last alert's longest cooldown drops the state: what the watermark lets in
    after that is free to be sent anyway.  A longer gap than that is an error, not a different result.
    """

    def __init__(self, longest: int | None):
        self.longest = longest

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("second", LongType())]))

    def _clear_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows))
        held = frame[frame["gap"] > 0]
        if self.longest is not None and len(held) and held["gap"].max() > self.longest:
            raise ValueError(f"a gap of {held['gap'].max()} s is longer than the longest one stated, {self.longest} s")
        held = held.groupby("second", as_index=False)["gap"].min().sort_values("second")
        before = last = self.last.get()[0] if self.last.exists() else NEVER
        seconds = held["second"].to_numpy()
        reach = np.maximum.accumulate(seconds - held["gap"].to_numpy()) if len(seconds) else seconds
        sent, at = [], int(np.searchsorted(reach, last))
        while at < len(seconds):  # gaps are positive, so the next alert sent is a later one
            last = int(seconds[at])
            sent.append(last)
            at = int(np.searchsorted(reach, last))
        if last != before:
            self.last.update((last,))
            if self.longest is not None:
                self._clear_timers()
                self.handle.registerTimer((last + self.longest) * 1000)
        free = frame.loc[frame["gap"] <= 0, "second"].tolist()
        yield pd.DataFrame({"config_id": key[0], "source_id": key[1], "second": pd.Series(sent + free, dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def cooldown_stream(alerts: DataFrame, time: str = "sent_at", delay: str = "1 hour", longest_minutes: int | None = None) -> DataFrame:
    """Seconds at which each rule and source sends; needs ``config_id, source_id, cooldown_minutes``.

    The decisions are those of ``apply_cooldown``: a null gap is half an hour, an alert with a gap of 0 or less is sent and holds no
    other back, of the alerts of a second the shortest gap counts.  They are taken as alerts arrive; one that comes after a later
    one was sent is not, and one behind the watermark is dropped.  Bursts shrink to a row per second in each task before the
    shuffle.  With ``longest_minutes`` the state of a key goes when its longest cooldown is over, else it stays.

    State is kept by ``transformWithStateInPandas``, which needs the RocksDB state store: see ``run_available``.
    """
    kind = alerts.schema[time].dataType.simpleString()
    second = whole_seconds(F.col(time), kind)
    rows = alerts.select(
        F.col("config_id").cast("string").alias("config_id"), F.col("source_id").cast("string").alias("source_id"),
        F.timestamp_seconds(second).alias("time"), second.alias("second"), gap_seconds(F.col("cooldown_minutes")).alias("gap"))
    timed = rows.where("second IS NOT NULL").mapInPandas(_least_gaps, ALERT).withWatermark("time", delay)
    longest = None if longest_minutes is None else longest_minutes * 60
    return timed.groupBy("config_id", "source_id").transformWithStateInPandas(Cooldown(longest), SENT, "append", "eventtime")


STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, path: str, checkpoint: str, rocksdb: bool = False) -> None:
    """Process everything that is there into parquet and stop; ``rocksdb`` keeps this query's state in RocksDB."""
    conf = stream.sparkSession.conf
    before = conf.get(STORE)
    if rocksdb:
        conf.set(STORE, ROCKS)
    try:
        query = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start(path))
    finally:
        conf.set(STORE, before)
    query.awaitTermination()
