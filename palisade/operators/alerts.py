"""Alert rules: which scans trigger which configuration, messages, cooldown."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions import risk
from palisade.functions.shared import written
from palisade.operators import store

SALTS = 32


def active_configs(configs: DataFrame) -> DataFrame:
    """Active rules with their JSON fields decoded; bad JSON leaves the field empty."""
    levels = F.from_json("trigger_risk_levels", "array<string>")
    return configs.where(F.col("is_active")).withColumn("trigger_risk_levels", levels)


def match_alerts(scans: DataFrame, configs: DataFrame) -> DataFrame:
    """A rule fires when the scan's rank reaches the rank of any level it lists.

    The theta condition becomes an equality: a rule is listed once for every
    rank at which it fires.  Ranks are only four keys, so rules are copied per
    salt and scans spread over the salts; Spark broadcasts the rules when their
    measured size allows it.
    """
    ranked = F.array_min(F.filter(
        F.transform("trigger_risk_levels", lambda l: F.when(l.isin(*risk.RISK_LEVELS), risk.rank(l))),
        lambda r: r.isNotNull()))
    rules = configs.withColumn("_from", ranked).where(F.col("_from").isNotNull()).select(
        *configs.columns, F.explode(F.sequence("_from", F.lit(3))).alias("_rank"))
    rules = rules.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = scans.withColumns({
        "_rank": risk.rank(F.col("highest_risk")),
        "_salt": F.pmod(F.xxhash64(*scans.columns), F.lit(SALTS)).cast("int")})
    return spread.join(rules, ["_rank", "_salt"]).drop("_rank", "_salt", "trigger_risk_levels")


def alert_message(alerts: DataFrame) -> DataFrame:
    """Message text and its stored preview."""
    # Fixed value: the wording.
    text = F.format_string(
        "🚨 *Compliance Alert — %s*\nRisk Level: *%s*\nTotal Flags: %d\nRisk Score: %.1f/100\n"
        "Scan ID: `%s`\nTimestamp: %s UTC",
        F.col("source_name"), F.upper("highest_risk"), F.col("total_flags").cast("bigint"), F.col("risk_score"),
        F.col("scan_id"), F.date_format("scanned_at", "yyyy-MM-dd HH:mm"))
    return alerts.withColumn("message", text).withColumn("message_preview", F.substring("message", 1, 200))


def log_alerts(history: DataFrame, alerts: DataFrame) -> DataFrame:
    return store.insert_ignore(history, alerts, "alert_id")


# The functions below run in Python workers, which need not have this package on
# their path: send them by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# What a stretch of time does to the last alert sent is a step function: arrays ``enter`` (rising) and ``leave``.  An alert
# at second s with gap g is sent if s - g reaches the last one sent, so of a last one L the first alert sent is the first
# with s - g >= L, the one at which the running maximum of s - g reaches L; without one L stays.


def _apply(enter, leave, last):
    """The last alert sent behind a stretch, for one or many last ones before it."""
    at = np.searchsorted(enter, last)
    return np.where(at < len(enter), np.append(leave, 0)[at], last)


def _then(one, two):
    """The step function of two stretches in a row."""
    more = two[0] > (one[0][-1] if len(one[0]) else -(1 << 62))
    return np.concatenate([one[0], two[0][more]]), np.concatenate([_apply(*two, one[1]), two[1][more]]).astype(np.int64)


def _steps(seconds, gaps, begin):
    """The step function of one chunk, whose alerts are in time order and which nothing sent after ``begin`` enters."""
    reach = np.maximum.accumulate(seconds - gaps)
    following = np.searchsorted(reach, seconds)  # gaps are positive, so this is a later alert
    last = np.where(following < len(seconds), following, np.arange(len(seconds)))
    while (last[last] != last).any():  # twice as far along the chain of alerts sent in every round
        last = last[last]
    leave = seconds[last]
    first = np.concatenate([[True], reach[1:] > reach[:-1]])
    enter, leave = reach[first], leave[first]
    upto = min(len(enter), int(np.searchsorted(enter, begin)) + 1)
    enter, leave = enter[:upto], leave[:upto]
    keep = np.append(leave[1:] != leave[:-1], True)
    return enter[keep], leave[keep]


def _chunk_plan(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("second")
    enter, leave = _steps(pdf["second"].to_numpy(), pdf["gap"].to_numpy(), int(pdf["chunk"].iloc[0]) * int(pdf["width"].iloc[0]))
    return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in ("config_id", "source_id", "chunk")},
                         "enter": [enter.tolist()], "leave": [leave.tolist()]})


def _functions(pdf):
    return [(np.asarray(e, np.int64), np.asarray(v, np.int64)) for e, v in zip(pdf["enter"], pdf["leave"])]


def _block_plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """The chunks of one block as one step function."""
    whole = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for function in _functions(pdf.sort_values("chunk")):
        whole = _then(whole, function)
    return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in ("config_id", "source_id", "block")},
                         "enter": [whole[0].tolist()], "leave": [whole[1].tolist()]})


def _walk(part: str):
    """The last alert sent before each part of a stretch, given the one before the stretch."""
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(part)
        last, out = int(pdf["carried"].iloc[0]), []
        for function in _functions(pdf):
            out.append(last)
            last = int(_apply(*function, np.int64(last)))
        return pd.DataFrame({"config_id": pdf["config_id"], "source_id": pdf["source_id"], part: pdf[part], "carried": out})
    return walk


def _replay(pdf: pd.DataFrame) -> pd.DataFrame:
    """The alerts of one chunk that are sent, jumping from each to the next."""
    pdf = pdf.sort_values("second").reset_index(drop=True)
    seconds = pdf["second"].to_numpy()
    reach = np.maximum.accumulate(seconds - pdf["gap"].to_numpy())
    kept, at = [], int(np.searchsorted(reach, int(pdf["carried"].iloc[0])))
    while at < len(seconds):
        kept.append(at)
        at = int(np.searchsorted(reach, seconds[at]))
    return pdf.loc[kept, ["config_id", "source_id", "second"]]


def whole_seconds(time: Column, kind: str) -> Column:
    """Seconds since 1970 of an instant, or of a time without a zone as it stands, whatever the session's zone is."""
    if kind == "timestamp_ntz":
        since = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
        return F.floor((time - since).cast("interval second").cast("decimal(20,6)")).cast("bigint")
    return F.floor(F.unix_micros(time.cast("timestamp")) / 1000000).cast("bigint")


NEVER = -(1 << 62)
#: Fixed value: the cooldown of an alert that names none.
DEFAULT_MINUTES = 30


def gap_seconds(minutes: Column) -> Column:
    """An alert's cooldown in seconds: null is the default, 0 or less none (the alert is sent and holds no other back)."""
    return (F.coalesce(minutes, F.lit(DEFAULT_MINUTES)) * 60).cast("bigint")


def apply_cooldown(alerts: DataFrame, chunk_seconds: int = 604800, block: int = 64, whole: int = 200_000) -> DataFrame:
    """Alerts that are sent: each at least its own ``cooldown_minutes`` after the last one sent.

    Needs ``config_id, source_id, sent_at, cooldown_minutes``.  Time counts in whole seconds; of several alerts in one
    second the one with the shortest cooldown, then the least row, stands for all.  A null cooldown is one of half an hour; an alert
    whose cooldown is 0 or less is sent and holds no other back.

    The decision depends on the previous one.  A key of at most ``whole`` seconds is replayed as it is.  No larger key is handled by
    one task: its time is cut into chunks of a week,
    at least of the key's longest cooldown, each summarised on its own as a step function; the functions of ``block`` chunks become one,
    those of the blocks are walked, then the chunks of each block, and the chunks are replayed in parallel.  The rows per
    second are written to the shared folder once and read for every step.
    """
    cols, types = alerts.columns, {f.name: f.dataType.simpleString() for f in alerts.schema}
    key = ["config_id", "source_id"]
    gap = gap_seconds(F.col("cooldown_minutes"))
    rest = [c for c in cols if c not in key]
    entry = F.struct(gap.alias("_gap"), *rest)
    # Alerts without a cooldown stay apart by a number of their own; the others meet in their second.
    own = F.when(gap <= 0, F.monotonically_increasing_id()).otherwise(F.lit(-1))
    seconds = alerts.withColumns({"_second": whole_seconds(F.col("sent_at"), types["sent_at"]), "_own": own})
    rows = seconds.groupBy(*key, "_second", "_own").agg(F.min(entry).alias("row")).select(
        *key, F.col("_second").alias("second"), F.col("row._gap").alias("gap"), "row", (F.col("_own") >= 0).alias("free"))
    rows = written(rows, "alerts")
    timed = rows.where("not free").select(*key, "second", "gap")
    named = ", ".join(f"{c} {types[c]}" for c in key)
    large = timed.groupBy(*key).agg(F.count("*").alias("_n"), F.greatest(F.lit(chunk_seconds), F.max("gap")).cast("bigint").alias("width")).where(
        F.col("_n") > whole).drop("_n")
    large = written(large, "large")
    once = timed.withColumn("carried", F.lit(NEVER))
    if large.isEmpty():
        kept = once.groupBy(*key).applyInPandas(_replay, f"{named}, second bigint")
    else:
        kept = once.join(large.select(*key), _same(once, large, key), "left_anti").groupBy(*key).applyInPandas(
            _replay, f"{named}, second bigint").unionByName(_replay_in_chunks(timed, large, key, named, block))
    kept = kept.withColumnsRenamed({c: f"_{c}" for c in key})
    same = [rows[c].eqNullSafe(kept[f"_{c}"]) for c in key]
    sent = rows.where("not free").join(kept.withColumnRenamed("second", "_second"), [*same, F.col("second") == F.col("_second")], "left_semi")
    return sent.unionByName(rows.where("free")).select(*key, *[F.col(f"row.`{c}`").alias(c) for c in rest]).select(*cols)


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> list[Column]:
    """Equality in which null meets null."""
    return [a[c].eqNullSafe(b[c]) for c in names]


def _replay_in_chunks(timed: DataFrame, large: DataFrame, key: list[str], named: str, block: int) -> DataFrame:
    timed = timed.join(large, _same(timed, large, key)).select(
        *[timed[c] for c in key], F.floor(F.col("second") / F.col("width")).cast("bigint").alias("chunk"), "second", "gap", "width")
    slim = written(timed, "seconds")
    steps = "enter array<bigint>, leave array<bigint>"
    chunks = written(slim.groupBy(*key, "chunk").applyInPandas(_chunk_plan, f"{named}, chunk bigint, {steps}").withColumn(
        "block", F.floor(F.col("chunk") / block).cast("bigint")), "chunks")
    blocks = chunks.groupBy(*key, "block").applyInPandas(_block_plan, f"{named}, block bigint, {steps}")
    before = blocks.withColumn("carried", F.lit(NEVER)).groupBy(*key).applyInPandas(_walk("block"), f"{named}, block bigint, carried bigint")
    carried = chunks.join(before, [*_same(chunks, before, key), chunks["block"] == before["block"]]).select(
        *[chunks[c] for c in (*key, "chunk", "enter", "leave", "block")], "carried").groupBy(*key, "block").applyInPandas(
        _walk("chunk"), f"{named}, chunk bigint, carried bigint")
    replayed = slim.join(carried, [*_same(slim, carried, key), slim["chunk"] == carried["chunk"]]).select(
        *[slim[c] for c in (*key, "chunk", "second", "gap")], "carried")
    return replayed.groupBy(*key, "chunk").applyInPandas(_replay, f"{named}, second bigint")
