"""Registered queries over stored results: risk, trends, alerts, telemetry, retrieval, streams, SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade import rules as R
from palisade.functions import registration, risk
from palisade.operators import near as N
from palisade.operators import alerts as A
from palisade.operators import external as X
from palisade.operators import reports as RP
from palisade.operators import retrieval as V
from palisade.operators import risk_score as RS
from palisade.operators import store as ST
from palisade.operators import detect as D
from palisade.operators.classify import scan_columns
from palisade.operators.versioned import KeyedTable
from palisade.streaming import streams as STR
from workload import metadata as M
from workload import sql as S
from workload.inputs import conversation_pages, document_pages, pick, shared_dir, table
from workload.samples import SNIPPETS

QUERIES, ORACLES = {}, {}


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


# Every event is one scan result; its value sets the severity. --------------------
RES_SQL = ("res AS (SELECT event_id, 'user' || user_id AS source_id, CAST(ts AS DATE) AS day, ts, event_type || '.' || json_extract_string(props, '$.k') AS entity_name, "
           "CASE event_type WHEN 'error' THEN 'PII' WHEN 'click' THEN 'confidential' WHEN 'signup' THEN 'abuse' ELSE event_type END AS check_type, "
           "CASE WHEN value >= 200 THEN 'critical' WHEN value >= 100 THEN 'high' WHEN value >= 50 THEN 'medium' WHEN value >= 10 THEN 'low' ELSE 'unknown' END AS risk_level, "
           "event_type, value FROM events)")
_W = "CASE risk_level WHEN 'critical' THEN 25.0 WHEN 'high' THEN 10.0 WHEN 'medium' THEN 3.0 ELSE 1.0 END"
_T = {"pii": "lower(check_type) = 'pii'", "confidential": "check_type = 'confidential'", "abuse": "check_type = 'abuse'",
      "custom": "lower(check_type) NOT IN ('pii', 'confidential', 'abuse')"}
MET_SQL = ("met AS (SELECT source_id, day AS trend_date, CAST(least(100, round_even(sum(" + _W + "), 1)) AS DOUBLE) AS risk_score, "
           "CAST(round_even(greatest(0, (1 - count(DISTINCT entity_name) / CAST(20 AS DOUBLE)) * 100), 1) AS DOUBLE) AS compliance_pct, "
           + S.label(f"max({S.rank('risk_level')})") + " AS highest_risk, "
           + ", ".join(f"count(*) FILTER ({t}) AS {n}_count" for n, t in _T.items())
           + ", count(*) AS total_violations FROM res GROUP BY source_id, day)")
TREND_COLS = ", ".join(RS.TREND)


def results(spark, sf, events=None):
    e = events if events is not None else table(spark, sf, "events")
    v = F.col("value")
    return e.select(
        "event_id", F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("source_id"), F.to_date("ts").alias("day"), "ts",
        F.concat_ws(".", "event_type", F.get_json_object("props", "$.k")).alias("entity_name"),
        F.when(F.col("event_type") == "error", "PII").when(F.col("event_type") == "click", "confidential")
        .when(F.col("event_type") == "signup", "abuse").otherwise(F.col("event_type")).alias("check_type"),
        F.when(v >= 200, "critical").when(v >= 100, "high").when(v >= 50, "medium").when(v >= 10, "low").otherwise("unknown").alias("risk_level"),
        "event_type", "value")


def metrics(spark, sf):
    r = results(spark, sf).withColumn("trend_date", F.col("day"))
    totals = r.select("source_id", "trend_date").distinct().withColumn("total_columns", F.lit(20))
    return RS.risk_metrics(r, totals, ("source_id", "trend_date"))


def trends(spark, sf):
    return RS.trend_rows(metrics(spark, sf), F.col("trend_date"))


def _metric(name, *cols):
    register(name, lambda spark, sf: metrics(spark, sf).select("source_id", "trend_date", *cols),
             f"WITH {RES_SQL}, {MET_SQL} SELECT source_id, trend_date, {', '.join(cols)} FROM met")


_metric("risk_score", "risk_score")
_metric("risk_compliance_pct", "compliance_pct")
_metric("risk_type_counts", "pii_count", "confidential_count", "abuse_count", "custom_count", "total_violations")
_metric("risk_highest", "highest_risk")
TRENDS = f"WITH {RES_SQL}, {MET_SQL}"
register("trend_entry", trends, f"{TRENDS} SELECT {TREND_COLS} FROM met")
register("trend_scan_pct", lambda spark, sf: RS.scan_page_trend(metrics(spark, sf), F.col("trend_date")).select(
    "source_id", "trend_date", "compliance_pct"),
    f"{TRENDS} SELECT source_id, trend_date, greatest(0, 100 - risk_score) AS compliance_pct FROM met")


def _fresh(spark, sf):
    """A second run over the same sources: each source's newest day again, with other numbers, and one day more."""
    last = RS.latest_trends(trends(spark, sf)).withColumns({"risk_score": F.lit(0.0), "seq": F.lit(2)})
    rows = last.unionByName(last.withColumn("trend_date", F.date_add("trend_date", 1)))
    return rows.unionByName(rows.withColumns({"risk_score": F.lit(50.0), "seq": F.lit(1)}))  # an earlier try of each




def _trend_upsert(spark, sf):
    kept = KeyedTable(spark, shared_dir(spark, "trends"), STR.TREND_ROW, ["source_id", "trend_date"], 16)
    kept.upsert(trends(spark, sf))
    kept.upsert(_fresh(spark, sf), order=F.col("seq"))
    return kept.read().select("source_id", "trend_date", "risk_score")


register("trend_upsert", _trend_upsert,
         f"{TRENDS}, la AS (SELECT source_id, max(trend_date) AS d FROM met GROUP BY source_id) "
         "SELECT source_id, trend_date, CASE WHEN trend_date = d THEN CAST(0 AS DOUBLE) ELSE risk_score END AS risk_score FROM met JOIN la USING (source_id) "
         "UNION ALL SELECT source_id, CAST(d + 1 AS DATE), CAST(0 AS DOUBLE) FROM la")


def _sink_upsert(spark, sf):
    """The customers as a keyed table; then an upsert, which rewrites the buckets of its keys."""
    kept = KeyedTable(spark, shared_dir(spark, "customers"), "c_custkey bigint, c_name string, c_nationkey int", ["c_custkey"], 32)
    kept.upsert(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"))
    kept.upsert(table(spark, sf, "orders").where(F.col("o_orderstatus") == "P").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_name"), F.lit(-1).alias("c_nationkey"), "o_orderkey"),
        order=F.col("o_orderkey"))
    return kept.read()


register("sink_upsert", _sink_upsert,
    "WITH n AS (SELECT o_custkey AS c_custkey, arg_max(o_orderpriority, o_orderkey) AS c_name, CAST(-1 AS INT) AS c_nationkey FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) "
    "SELECT * FROM n UNION ALL SELECT c_custkey, c_name, c_nationkey FROM customer ANTI JOIN n USING (c_custkey)")
register("sink_insert_ignore", lambda spark, sf: ST.insert_ignore(
    table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
    table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).unionByName(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("zzz").alias("name"))), "id"),
    "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
register("trend_last_n", lambda spark, sf: RS.last_trends(trends(spark, sf), 5).select("source_id", "trend_date", "position", "risk_score"),
         f"{TRENDS} SELECT source_id, trend_date, CAST(row_number() OVER (PARTITION BY source_id ORDER BY trend_date) AS INT) AS position, risk_score FROM "
         "(SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY trend_date DESC) AS rn FROM met) WHERE rn <= 5")
register("trend_latest_per_source", lambda spark, sf: RS.latest_trends(trends(spark, sf)),
         f"{TRENDS} SELECT {', '.join('m.' + c for c in RS.TREND)} FROM met m JOIN (SELECT source_id, max(trend_date) AS d FROM met GROUP BY source_id) l "
         "ON m.source_id = l.source_id AND m.trend_date = l.d")
register("trend_tile_risk", lambda spark, sf: trends(spark, sf).select("source_id", "trend_date", RS.tile_risk(F.col("compliance_pct")).alias("tile")),
         f"{TRENDS} SELECT source_id, trend_date, CASE WHEN compliance_pct < 70 THEN 'critical' WHEN compliance_pct < 85 THEN 'high' WHEN compliance_pct < 95 THEN 'medium' "
         "ELSE 'low' END AS tile FROM met")
register("trend_gauge_band", lambda spark, sf: trends(spark, sf).select("source_id", "trend_date", RS.gauge_band(F.col("compliance_pct")).alias("band")),
         f"{TRENDS} SELECT source_id, trend_date, CASE WHEN compliance_pct < 70 THEN 'red' WHEN compliance_pct < 90 THEN 'amber' ELSE 'green' END AS band FROM met")


def _halves(spark, sf):
    r = results(spark, sf)
    mid = F.lit("2024-01-16").cast("date")
    return r.where(F.col("day") < mid), r.where(F.col("day") >= mid)


register("drift_between_scans", lambda spark, sf: RS.drift(*_halves(spark, sf)),
         f"WITH {RES_SQL}, b AS (SELECT source_id, entity_name, max({S.rank('risk_level')}) AS b FROM res WHERE day < DATE '2024-01-16' GROUP BY ALL), "
         f"a AS (SELECT source_id, entity_name, max({S.rank('risk_level')}) AS a FROM res WHERE day >= DATE '2024-01-16' GROUP BY ALL), "
         "j AS (SELECT * FROM b FULL JOIN a USING (source_id, entity_name)) SELECT source_id, entity_name, "
         f"CASE WHEN b IS NOT NULL THEN {S.label('b')} END AS risk_before, CASE WHEN a IS NOT NULL THEN {S.label('a')} END AS risk_after, "
         "CAST(coalesce(a, -1) - coalesce(b, -1) AS INT) AS risk_delta, CASE WHEN b IS NULL THEN 'new' WHEN a IS NULL THEN 'resolved' WHEN a > b THEN 'escalated' "
         "ELSE 'reduced' END AS drift_type FROM j WHERE b IS DISTINCT FROM a")

# Alerts: one scan per event type and hour, one rule per nation. --------------------
SCAN_SQL = (f"{RES_SQL}, scans AS (SELECT event_type AS source_id, date_trunc('hour', ts) AS hour, event_type || '-' || strftime(date_trunc('hour', ts), '%Y%m%d%H') AS scan_id, "
            f"max(ts) AS scanned_at, {S.label('max(' + S.rank('risk_level') + ')')} AS highest_risk, count(*) AS total_flags, "
            f"CAST(least(100, sum({_W})) AS DOUBLE) AS risk_score FROM res GROUP BY event_type, date_trunc('hour', ts))")
_LEVELS = ('["critical"]', '["high", "critical"]', '["medium"]', '["bogus"]', '["low", "high"]')
_COOL = (30, 60, 240, 1440)
_L_SQL = "[" + ", ".join(map(S.lit, _LEVELS)) + "]"
CFG_SQL = (f"cfg AS (SELECT 'c' || n_nationkey AS config_id, n_name AS name, list_extract({_L_SQL}, n_nationkey % 5 + 1) AS levels, "
           "n_regionkey <> 2 AS is_active, list_extract([30, 60, 240, 1440], n_nationkey % 4 + 1) AS cooldown_minutes FROM nation), "
           "act AS (SELECT *, list_min(list_filter(list_transform(from_json(levels, '[\"VARCHAR\"]'), lambda l: CASE l WHEN 'critical' THEN 3 WHEN 'high' THEN 2 "
           "WHEN 'medium' THEN 1 WHEN 'low' THEN 0 END), lambda r: r IS NOT NULL)) AS lo FROM cfg WHERE is_active)")
FIRE_SQL = f"{SCAN_SQL}, {CFG_SQL}, fired AS (SELECT s.*, a.config_id, a.name, CASE WHEN s.total_flags % 3 = 0 THEN a.cooldown_minutes // 2 ELSE a.cooldown_minutes END AS cooldown_minutes FROM scans s JOIN act a ON {S.rank('s.highest_risk')} >= a.lo)"


def scans(spark, sf):
    r = results(spark, sf)
    hour = F.date_trunc("hour", "ts")
    g = r.groupBy(F.col("event_type").alias("source_id"), hour.cast("timestamp_ntz").alias("hour")).agg(
        F.max("ts").alias("scanned_at"), F.max(risk.rank(F.col("risk_level"))).alias("_r"),
        F.count(F.lit(1)).alias("total_flags"), F.least(F.lit(100.0), F.sum(RS.severity_weight(F.col("risk_level")))).alias("risk_score"))
    return g.select("source_id", F.concat_ws("-", "source_id", F.date_format("hour", "yyyyMMddHH")).alias("scan_id"), "scanned_at",
                    risk.label(F.col("_r")).alias("highest_risk"), "total_flags", "risk_score", F.col("source_id").alias("source_name"))


def configs(spark, sf):
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    return n.select(F.concat(F.lit("c"), k.cast("string")).alias("config_id"), F.col("n_name").alias("name"),
                    pick(_LEVELS, k).alias("trigger_risk_levels"), (F.col("n_regionkey") != 2).alias("is_active"),
                    pick(_COOL, k).alias("cooldown_minutes"))


def fired(spark, sf):
    matched = A.match_alerts(scans(spark, sf), A.active_configs(configs(spark, sf))).withColumn("sent_at", F.col("scanned_at"))
    # A scan with many flags halves its alerts' gap, so gaps differ inside one key.
    return matched.withColumn("cooldown_minutes", F.when(F.col("total_flags") % 3 == 0, (F.col("cooldown_minutes") / 2).cast("int")).otherwise(
        F.col("cooldown_minutes")))


register("alert_configs_active", lambda spark, sf: A.active_configs(configs(spark, sf)).select(
    "config_id", "name", F.array_join("trigger_risk_levels", "+").alias("levels")),
    f"WITH {CFG_SQL} SELECT config_id, name, array_to_string(from_json(levels, '[\"VARCHAR\"]'), '+') AS levels FROM act")
register("alert_match", lambda spark, sf: fired(spark, sf).select("scan_id", "config_id", "highest_risk"),
         f"WITH {FIRE_SQL} SELECT scan_id, config_id, highest_risk FROM fired")
register("alert_message", lambda spark, sf: A.alert_message(scans(spark, sf)).select("scan_id", "message", "message_preview"),
         f"WITH {SCAN_SQL}, m AS (SELECT scan_id, '🚨 *Compliance Alert — ' || source_id || '*' || chr(10) || 'Risk Level: *' || upper(highest_risk) || '*' || chr(10) || "
         "'Total Flags: ' || total_flags || chr(10) || 'Risk Score: ' || printf('%.1f', risk_score) || '/100' || chr(10) || 'Scan ID: `' || scan_id || '`' || chr(10) || "
         "'Timestamp: ' || strftime(scanned_at, '%Y-%m-%d %H:%M') || ' UTC' AS message FROM scans) SELECT scan_id, message, message[:200] AS message_preview FROM m")


def _log(spark, sf):
    rows = fired(spark, sf).select(F.concat_ws("-", "config_id", "source_id").alias("alert_id"), "scan_id", "sent_at")
    first = rows.groupBy("alert_id").agg(F.min_by("scan_id", "sent_at").alias("scan_id"), F.min("sent_at").alias("sent_at"))
    return A.log_alerts(first.where(F.col("alert_id").endswith("error")), rows.withColumn("scan_id", F.lit("late"))).select("alert_id", "scan_id")


register("alert_log", _log,
         f"WITH {FIRE_SQL}, r AS (SELECT config_id || '-' || source_id AS alert_id, min_by(scan_id, scanned_at) AS scan_id FROM fired GROUP BY ALL) "
         "SELECT alert_id, CASE WHEN alert_id LIKE '%error' THEN scan_id ELSE 'late' END AS scan_id FROM r")
COOL_SQL = (f"WITH RECURSIVE {FIRE_SQL}, se AS (SELECT config_id, source_id, CAST(floor(epoch(scanned_at)) AS BIGINT) AS second, CAST(min(cooldown_minutes) * 60 AS BIGINT) AS gap FROM fired GROUP BY 1, 2, 3), "
            "kept AS (SELECT config_id, source_id, min(second) AS second FROM se GROUP BY ALL UNION ALL SELECT k.config_id, k.source_id, min(s.second) FROM kept k "
            "JOIN se s ON k.config_id = s.config_id AND k.source_id = s.source_id AND s.second >= k.second + s.gap GROUP BY k.config_id, k.source_id, k.second)")
register("alert_cooldown", lambda spark, sf: A.apply_cooldown(fired(spark, sf)).select(
    "config_id", "source_id", F.floor(F.unix_micros(F.col("sent_at").cast("timestamp")) / 1000000).cast("bigint").alias("second")),
    f"{COOL_SQL} SELECT config_id, source_id, second FROM kept")

# Store queries and telemetry: one stored scan per document. -------------------------
ST_SQL = ("sc AS (SELECT 'u' || doc_id AS upload_id, source AS pdf_name, TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id * 7 % 43200 AS INT)) AS scanned_at, "
          "CAST(n_chars % 12 AS INT) AS total_flags, list_extract(['low', 'medium', 'high', 'critical'], CAST(n_chars % 4 AS INT) + 1) AS highest_risk, "
          "CASE WHEN n_chars % 9 = 0 THEN 'n/a' ELSE CAST(n_chars // 4 AS VARCHAR) END AS total_tokens, CASE WHEN n_chars % 8 = 0 THEN '' ELSE CAST(n_chars % 50 AS VARCHAR) "
          "|| '.5' END AS execution_time_sec, list_extract(['groq', 'gemini', 'openai'], CAST(doc_id % 3 AS INT) + 1) AS ai_provider, n_chars FROM documents)")


def stored(spark, sf):
    n, k = F.col("n_chars"), F.col("doc_id")
    minutes = (k * 7 % 43200).cast("int")
    return table(spark, sf, "documents").select(
        F.concat(F.lit("u"), k.cast("string")).alias("upload_id"), F.col("source").alias("pdf_name"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=minutes)).alias("scanned_at"),
        F.lit(1).alias("total_pages"), (n % 12).cast("int").alias("total_flags"), pick(R.RISK_LEVELS, n).alias("highest_risk"),
        F.lit("completed").alias("status"), F.lit(None).cast("string").alias("report_path"),
        F.when(n % 9 == 0, "n/a").otherwise(F.floor(n / 4).cast("string")).alias("total_tokens"),
        F.when(n % 8 == 0, "").otherwise(F.concat((n % 50).cast("string"), F.lit(".5"))).alias("execution_time_sec"),
        pick(("groq", "gemini", "openai"), k).alias("ai_provider"),
        F.to_json(F.struct(F.struct((n % 12).alias("total_flags"), pick(R.RISK_LEVELS, n).alias("highest_risk")).alias("summary"))).alias("result_json"))


register("q_recent_scans", lambda spark, sf: RP.recent_scans(stored(spark, sf)).select("upload_id", "pdf_name", "scanned_at", "total_flags", "highest_risk"),
         f"WITH {ST_SQL} SELECT upload_id, pdf_name, scanned_at, total_flags, highest_risk FROM sc ORDER BY scanned_at DESC, upload_id DESC LIMIT 50")
register("q_get_scan", lambda spark, sf: stored(spark, sf).join(
    table(spark, sf, "labels").where("toxic = 1").select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("upload_id")), "upload_id", "left_semi")
    .select("upload_id", F.from_json("result_json", "summary struct<total_flags:bigint,highest_risk:string>").alias("d"))
    .select("upload_id", F.col("d.summary.total_flags").alias("total_flags"), F.col("d.summary.highest_risk").alias("highest_risk")),
    f"WITH {ST_SQL} SELECT upload_id, CAST(total_flags AS BIGINT) AS total_flags, highest_risk FROM sc WHERE upload_id IN (SELECT 'u' || doc_id FROM labels WHERE toxic = 1)")
register("q_delete_scan", lambda spark, sf: ST.delete(stored(spark, sf), table(spark, sf, "labels").where("toxic = 1").select(
    F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("upload_id")), "upload_id").select("upload_id", "pdf_name"),
    f"WITH {ST_SQL} SELECT upload_id, pdf_name FROM sc WHERE upload_id NOT IN (SELECT 'u' || doc_id FROM labels WHERE toxic = 1)")
register("q_scan_runs", lambda spark, sf: ST.newest(scans(spark, sf).where(F.col("source_id") == "error"), 30, "scanned_at").select("scan_id", "scanned_at", "total_flags"),
         f"WITH {SCAN_SQL} SELECT scan_id, scanned_at, total_flags FROM scans WHERE source_id = 'error' ORDER BY scanned_at DESC LIMIT 30")


def _complete(spark, sf):
    done = scans(spark, sf)
    running = done.select("scan_id", F.lit("running").alias("status"), F.lit(0).cast("bigint").alias("total_flags"))
    finished = done.where(F.col("highest_risk") != "low").select("scan_id", F.lit("completed").alias("status"), "total_flags", F.lit(2).alias("seq"))
    tries = finished.withColumns({"status": F.lit("failed"), "total_flags": F.lit(-1).cast("bigint"), "seq": F.lit(1)})
    return ST.update(running, tries.unionByName(finished), "scan_id", order=F.col("seq"))


register("q_scan_run_complete", _complete,
         f"WITH {SCAN_SQL} SELECT scan_id, CASE WHEN highest_risk <> 'low' THEN 'completed' ELSE 'running' END AS status, CASE WHEN highest_risk <> 'low' THEN total_flags ELSE 0 END "
         "AS total_flags FROM scans")
register("q_scan_results", lambda spark, sf: RP.scan_results(scan_columns(M.curr_columns(spark, sf))).select("source_id", "entity_name", "risk_level"),
         f"{M.PAIR}, {M.CLS_SQL}, {M.SCAN_SQL} SELECT source_id, entity_name, risk_level FROM sc ORDER BY risk_level DESC, entity_name")
register("q_type_risk_filter", lambda spark, sf: RP.type_risk_filter(scan_columns(M.curr_columns(spark, sf)), ("pii", "custom"), ("critical", "high", "medium"))
         .select("source_id", "entity_name", "check_type", "risk_level"),
         f"{M.PAIR}, {M.CLS_SQL}, {M.SCAN_SQL} SELECT source_id, entity_name, check_type, risk_level FROM sc WHERE check_type IN ('pii', 'custom') AND risk_level IN ('critical', 'high', 'medium')")
_TOK = "coalesce(try_cast(total_tokens AS BIGINT), 0)"
register("t_kpis", lambda spark, sf: RP.kpis(stored(spark, sf)),
         f"WITH {ST_SQL} SELECT count(*) AS total_scans, CAST(round_even(avg(coalesce(try_cast(execution_time_sec AS DOUBLE), 0)), 2) AS DOUBLE) AS avg_latency, "
         f"CAST(sum({_TOK}) AS BIGINT) AS total_tokens FROM sc")
register("t_scans_by_day", lambda spark, sf: RP.scans_by_day(stored(spark, sf)), f"WITH {ST_SQL} SELECT CAST(scanned_at AS DATE) AS date, count(*) AS scans FROM sc GROUP BY ALL")
register("t_tokens_by_day", lambda spark, sf: RP.tokens_by_day(stored(spark, sf)),
         f"WITH {ST_SQL} SELECT CAST(scanned_at AS DATE) AS date, CAST(sum({_TOK}) AS BIGINT) AS tokens FROM sc GROUP BY ALL")
register("t_risk_freq", lambda spark, sf: RP.risk_frequency(stored(spark, sf)),
         f"WITH {ST_SQL} SELECT highest_risk, count(*) AS count, CAST({S.rank('highest_risk')} AS INT) AS position FROM sc GROUP BY highest_risk")
register("t_provider_dist", lambda spark, sf: RP.provider_distribution(stored(spark, sf)), f"WITH {ST_SQL} SELECT ai_provider, count(*) AS count FROM sc GROUP BY ai_provider")
register("t_cost", lambda spark, sf: RP.cost(stored(spark, sf)),
         f"WITH {ST_SQL} SELECT CAST(round_even(CAST(sum({_TOK}) AS DOUBLE) * 0.03 / 1000, 2) AS DOUBLE) AS cost FROM sc")
register("t_tokens_total", lambda spark, sf: RP.total_tokens(table(spark, sf, "lineitem").select(
    F.col("l_orderkey").alias("upload_id"), F.col("l_linenumber").alias("check"), F.col("l_quantity").cast("bigint").alias("tokens"))),
    "SELECT l_orderkey AS upload_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_tokens FROM lineitem GROUP BY l_orderkey")

# Snapshot and change history: one snapshot per source (nation) and order month. -----
SNAP_SQL = ("sn AS (SELECT c_nationkey AS source_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS captured_at, count(*) AS column_count, "
            "count(DISTINCT c_custkey) AS table_count, CAST(max(o_orderkey) AS VARCHAR) AS schema_hash FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)")


def snapshots(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_nationkey").alias("source_id"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("captured_at"), "c_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("m")).groupBy("source_id", "captured_at").agg(
        F.sum("n").alias("column_count"), F.count(F.lit(1)).alias("table_count"), F.max("m").cast("string").alias("schema_hash"))


register("snap_latest", lambda spark, sf: ST.latest_per(snapshots(spark, sf), "source_id", "captured_at"),
         f"WITH {SNAP_SQL} SELECT * FROM sn QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY captured_at DESC) = 1")
register("snap_history", lambda spark, sf: ST.newest_per(snapshots(spark, sf), 10, "source_id", "captured_at").drop("_rank"),
         f"WITH {SNAP_SQL} SELECT * FROM sn QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY captured_at DESC) <= 10")


def _history(spark, sf):
    """Stored changes with their detail as JSON text, read back and decoded."""
    e = table(spark, sf, "events").select(
        F.concat(F.lit("ch"), F.col("event_id").cast("string")).alias("change_id"), F.col("event_type").alias("source_id"),
        F.col("ts").alias("detected_at"), F.col("props").alias("change_detail"))
    top = ST.newest_per(e, 50, "source_id", "detected_at", "change_id")
    return top.select("source_id", "change_id", "detected_at", F.from_json("change_detail", "map<string,string>")["k"].alias("k"))


register("chg_history", _history,
         "SELECT event_type AS source_id, 'ch' || event_id AS change_id, ts AS detected_at, json_extract_string(props, '$.k') AS k FROM events "
         "QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, 'ch' || event_id DESC) <= 50")


def _registry(spark, sf):
    """Sources registered, some deleted, some set to another status; names stay unique."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("name"), F.lit("active").alias("status"))
    seen = ST.insert_ignore(c.where(F.col("source_id") < 0), c, "name").select("source_id", "name", "status")
    gone = table(spark, sf, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("source_id"))
    bad = table(spark, sf, "customer").where(F.col("c_acctbal") > 9000).select(F.col("c_custkey").alias("source_id"), F.lit("error").alias("status"))
    twice = bad.withColumn("seq", F.lit(2)).unionByName(bad.withColumns({"status": F.lit("paused"), "seq": F.lit(1)}))
    return ST.update(ST.delete(seen, gone, "source_id"), twice, "source_id", order=F.col("seq"))


register("src_registry", _registry,
         "SELECT c_custkey AS source_id, c_name AS name, CASE WHEN c_acctbal > 9000 THEN 'error' ELSE 'active' END AS status FROM customer WHERE c_acctbal >= 0")


def _csv(spark, sf):
    path = shared_dir(spark, "csv")
    results(spark, sf).select("event_id", "source_id", "entity_name", "risk_level").write.csv(path, header=True)
    return spark.read.schema("event_id bigint, source_id string, entity_name string, risk_level string").csv(path, header=True)


register("sink_csv", _csv, f"WITH {RES_SQL} SELECT event_id, source_id, entity_name, risk_level FROM res")
register("sink_json", lambda spark, sf: results(spark, sf).select("event_id", F.to_json(F.struct("event_id", "source_id", "entity_name", "risk_level")).alias("json")),
         f"WITH {RES_SQL} SELECT event_id, CAST(to_json({{'event_id': event_id, 'source_id': source_id, 'entity_name': entity_name, 'risk_level': risk_level}}) AS VARCHAR) AS json FROM res")

# Stored model replies and external findings ------------------------------------------
_V = "'value' || (conv_id * 8 + turn)"
REPLY_SQL = ("rp AS (SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page_num, conv_id * 8 + turn AS k, '{\"findings\": [{\"category\": \"NAME\", \"value\": \"Jane ' || "
             "(conv_id * 8 + turn) || '\", \"context\": \"\", \"confidence\": 0.9, \"risk_level\": \"high\"}, {\"category\": \"NAME\", \"value\": \"jane\", \"context\": \"\", "
             "\"confidence\": 0.95, \"risk_level\": \"medium\"}, {\"category\": \"TRADE_SECRET\", \"value\": \"@\", \"context\": \"\", \"confidence\": 0.8, \"risk_level\": \"critical\"}, "
             "{\"category\": \"EMAIL\", \"value\": \"low\", \"context\": \"\", \"confidence\": 0.1, \"risk_level\": \"low\"}]}' AS body FROM conversations)")


def replies(spark, sf):
    c = table(spark, sf, "conversations")
    k = F.col("conv_id") * 8 + F.col("turn")

    def finding(category, value, confidence, level):
        return (f'{{"category": "{category}", "value": "{value}", "context": "", "confidence": {confidence}, "risk_level": "{level}"}}')

    head, rest = '{"findings": [{"category": "NAME", "value": "Jane ', ", ".join(
        [finding("NAME", "jane", 0.95, "medium"), finding("TRADE_SECRET", "@", 0.8, "critical"), finding("EMAIL", "low", 0.1, "low")])
    body = F.concat(F.lit(head), k.cast("string"), F.lit('", "context": "", "confidence": 0.9, "risk_level": "high"}, ' + rest + "]}"))
    raw = F.when(k % 4 == 0, body).when(k % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))) \
        .when(k % 4 == 2, F.concat(F.lit("Here it is: "), body, F.lit(" - done."))).otherwise(F.concat(F.lit("{broken "), F.col("role")))
    return c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_num"), raw.alias("raw"))


register("f_parse_response", lambda spark, sf: X.parse_responses(replies(spark, sf)).select(
    "doc_id", "page_num", "outcome", F.size("findings").alias("n"), F.get("findings", F.lit(0))["value"].alias("first")),
    f"WITH {REPLY_SQL} SELECT doc_id, page_num, CASE k % 4 WHEN 2 THEN 'extracted' WHEN 3 THEN 'failed' ELSE 'parsed' END AS outcome, "
    "CAST(CASE k % 4 WHEN 3 THEN 0 ELSE 4 END AS INT) AS n, CASE k % 4 WHEN 3 THEN NULL ELSE 'Jane ' || k END AS first FROM rp")


def _merged(spark, sf, check):
    from palisade.plans.scan import detect_all
    from workload.inputs import conversation_pages
    rules = R.default_rules()
    for section in ("encoding", "abuse"):
        rules[section]["enabled"] = False
    parsed = X.parse_responses(replies(spark, sf))
    external = X.explode_responses(parsed, "pii", 0.75).unionByName(X.explode_responses(parsed, "confidential", 0.70))
    found = detect_all(conversation_pages(spark, sf), rules, external)
    return D.explode_findings(found, {check: check}).where(F.col("detection_method") == "ai").select(
        "doc_id", "page_num", "category", "value", "confidence", "risk_level")


def _merge_sql():
    from workload import documents as DOC
    live = f"WITH {S.CONVS}, {S.STRIPPED}, {DOC.PII_RANKED}, {DOC.SEC_RANKED}, {REPLY_SQL}, ok AS (SELECT * FROM rp WHERE k % 4 <> 3)"
    # Of a page's three confident values, "jane" lies inside "Jane n" and "@" inside any e-mail address.
    pii = (f"{live}, cand AS (SELECT doc_id, page_num, 'NAME' AS category, 'Jane ' || k AS value, CAST(0.9 AS DOUBLE) AS confidence, 'high' AS risk_level FROM ok UNION ALL "
           "SELECT doc_id, page_num, 'TRADE_SECRET', '@', CAST(0.8 AS DOUBLE), 'critical' FROM ok), jane AS (SELECT doc_id, page_num, 'NAME' AS category, 'jane' AS value, "
           "CAST(0.95 AS DOUBLE) AS confidence, 'medium' AS risk_level FROM ok o WHERE EXISTS (SELECT 1 FROM pf p WHERE p.doc_id = o.doc_id AND p.page_num = o.page_num AND "
           "(contains('jane ' || k, lower(p.val)) OR contains(lower(p.val), 'jane ' || k))) AND NOT EXISTS (SELECT 1 FROM pf p WHERE p.doc_id = o.doc_id AND p.page_num = o.page_num AND "
           "(contains(lower(p.val), 'jane') OR contains('jane', lower(p.val))))) "
           "SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM pf p WHERE p.doc_id = c.doc_id AND p.page_num = c.page_num AND "
           "(contains(lower(p.val[:80]), lower(c.value)) OR contains(lower(c.value), lower(p.val[:80])))) UNION ALL SELECT * FROM jane")
    sec = (f"{live} SELECT doc_id, page_num, 'TRADE_SECRET' AS category, '@' AS value, CAST(0.8 AS DOUBLE) AS confidence, 'critical' AS risk_level FROM ok o WHERE NOT EXISTS "
           "(SELECT 1 FROM sf p WHERE p.doc_id = o.doc_id AND p.page_num = o.page_num AND p.category = 'TRADE_SECRET')")
    return pii, sec


_PII_MERGE, _SEC_MERGE = _merge_sql()
register("f_merge_pii", lambda spark, sf: _merged(spark, sf, "pii"), _PII_MERGE)
register("f_merge_secret", lambda spark, sf: _merged(spark, sf, "confidential"), _SEC_MERGE)



def _merged_abuse(spark, sf):
    """External findings as the third layer of the abuse check, one of their categories a zero-tolerance one."""
    from palisade.plans.scan import detect_all
    rules = R.default_rules()
    for section in ("encoding", "pii", "confidentiality"):
        rules[section]["enabled"] = False
    rules["abuse"]["zero_tolerance_categories"] = ["name", "harass"]
    external = X.explode_responses(X.parse_responses(replies(spark, sf)), "abuse", 0.0)
    found = detect_all(conversation_pages(spark, sf), rules, external)
    return D.explode_findings(found, {"abuse": "abuse"}).select(
        "doc_id", "page_num", "category", "value", "confidence", "risk_level", "detection_method")


def _merge_abuse_sql():
    from workload import documents as DOC
    level = "CASE WHEN contains(lower(category), 'name') OR contains(lower(category), 'harass') THEN 'critical' ELSE risk_level END AS risk_level"
    rows = " UNION ALL ".join(
        f"SELECT doc_id, page_num, '{c}' AS category, '{v}' AS value, CAST({p} AS DOUBLE) AS confidence, '{r}' AS risk_level, 'ai' AS detection_method "
        "FROM rp WHERE k % 4 <> 3" for c, v, p, r in (("NAME", "jane", 0.95, "medium"), ("TRADE_SECRET", "@", 0.8, "critical"), ("EMAIL", "low", 0.1, "low")))
    return (f"WITH {S.CONVS}, {S.STRIPPED}, {DOC.ABUSE_CTE}, {REPLY_SQL}, al AS (SELECT doc_id, page_num, category, '[REDACTED]' AS value, confidence, risk_level, "
            f"detection_method FROM abz UNION ALL {rows}) SELECT doc_id, page_num, category, value, confidence, {level}, detection_method FROM al")


register("f_merge_abuse", _merged_abuse, _merge_abuse_sql())

# Retrieval --------------------------------------------------------------------------

def _scan_findings(spark, sf):
    return scan_columns(M.curr_columns(spark, sf)).withColumns({
        "scan_id": F.col("source_id"), "source_name": F.upper("source_id")})


RAG_SQL = (f"{M.PAIR}, {M.CLS_SQL}, {M.SCAN_SQL}, rg AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY md5(entity_name || '|' || flag_category), entity_name, flag_category) - 1 AS i FROM sc)")
_DOC = ("'Data source: ' || upper(source_id) || chr(10) || 'Entity: ' || entity_name || chr(10) || 'Risk type: ' || check_type || ' — ' || flag_category || chr(10) || "
        "'Risk level: ' || risk_level || chr(10) || 'Evidence: ' || evidence || chr(10) || 'Recommendation: ' || recommendation")
register("rag_doc", lambda spark, sf: V.finding_documents(_scan_findings(spark, sf)).select("id", "text"),
         f"{RAG_SQL} SELECT source_id || '_' || i || '_' || entity_name[:20] AS id, {_DOC} AS text FROM rg")
register("rag_meta", lambda spark, sf: V.finding_documents(_scan_findings(spark, sf)).select("id", *[F.col("metadata")[k].alias(k) for k in V.META]),
         f"{RAG_SQL} SELECT source_id || '_' || i || '_' || entity_name[:20] AS id, source_id, upper(source_id) AS source_name, source_id AS scan_id, entity_name, check_type, risk_level, "
         "flag_category FROM rg")
register("rag_id", lambda spark, sf: V.finding_documents(_scan_findings(spark, sf)).select("id"),
         f"{RAG_SQL} SELECT source_id || '_' || i || '_' || entity_name[:20] AS id FROM rg")


def _index_twice(spark, sf):
    docs = V.finding_documents(_scan_findings(spark, sf)).select("id", "text")
    changed = docs.where(F.contains("text", F.lit("Risk level: critical"))).withColumn("text", F.lit("new"))
    twice = changed.withColumn("seq", F.lit(2)).unionByName(changed.withColumns({"text": F.lit("old try"), "seq": F.lit(1)}))
    kept = KeyedTable(spark, shared_dir(spark, "knowledge"), "id string, text string", ["id"], 32)
    kept.upsert(docs)
    kept.upsert(twice, order=F.col("seq"))
    return kept.read().groupBy((F.col("text") == "new").alias("replaced")).agg(F.count(F.lit(1)).alias("n"))


register("rag_upsert", _index_twice, f"{RAG_SQL} SELECT risk_level = 'critical' AS replaced, count(*) AS n FROM rg GROUP BY ALL")


def _centroids(spark, sf, *keys):
    e = table(spark, sf, "embeddings").select(*keys, F.posexplode("embedding").alias("pos", "x"))
    mean = e.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("query_vector"))


_EXPL = "ue AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)"
_FAR = "(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv))"
_COS = f"(CAST(round({_FAR}, 6) AS DOUBLE) + 0)"
register("rag_topk", lambda spark, sf: V.top_k(
    table(spark, sf, "embeddings"), _centroids(spark, sf), 5, F.col("label") != 3, id_col="vec_id").select("vec_id", "label", "distance"),
    f"WITH {_EXPL}, mn AS (SELECT pos, avg(CAST(x AS DOUBLE)) AS x FROM ue GROUP BY pos), q AS (SELECT list(x ORDER BY pos) AS qv FROM mn) "
    f"SELECT vec_id, label, {_COS} AS distance FROM embeddings, q WHERE label <> 3 ORDER BY {_FAR}, vec_id LIMIT 5")
BY_LABEL = (f"WITH {_EXPL}, mn AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM ue GROUP BY label, pos), q AS (SELECT label, list(x ORDER BY pos) AS qv FROM mn GROUP BY label), "
            f"d AS (SELECT label, vec_id, {_FAR} AS far, {_COS} AS distance FROM embeddings JOIN q USING (label)), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY far, vec_id) AS place FROM d)")


def _by_label(spark, sf):
    q = _centroids(spark, sf, "label").withColumn("query_id", F.col("label"))
    return V.top_k_by(table(spark, sf, "embeddings"), q, "label", 5, id_col="vec_id")


register("rag_topk_filtered", lambda spark, sf: _by_label(spark, sf).select("label", "vec_id", "place", "distance"),
         f"{BY_LABEL} SELECT label, vec_id, CAST(place AS INT) AS place, distance FROM r WHERE place <= 5")


def _many(spark, sf):
    """Every twentieth vector as a query against the whole index."""
    e = table(spark, sf, "embeddings")
    queries = e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return V.top_k_all(e, queries, 5, id_col="vec_id")


# Copies of a vector are equally far, but for the last bits that differ with the order of summing; so only distances are compared.
register("rag_topk_many", lambda spark, sf: _many(spark, sf).select("query_id", "place", "distance"),
         f"WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, {_FAR} AS far FROM embeddings e, "
         "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 20 = 0) q) "
         "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY far, vec_id) AS INT) AS place, CAST(round(far, 6) AS DOUBLE) + 0 AS distance "
         "FROM d QUALIFY place <= 5")


def _near(spark, sf):
    """The same queries, approximately."""
    e = table(spark, sf, "embeddings")
    queries = e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return N.top_k_near(e, queries, 5, id_col="vec_id")


# Which rows are missed has no SQL; that every query finds a vector equal to itself first has.
register("rag_topk_near", lambda spark, sf: _near(spark, sf).where("place = 1").select("query_id", "place", "distance"),
         "SELECT vec_id AS query_id, CAST(1 AS INT) AS place, CAST(0 AS DOUBLE) AS distance FROM embeddings WHERE vec_id % 20 = 0")
register("rag_stats", lambda spark, sf: V.index_stats(V.finding_documents(_scan_findings(spark, sf))),
         f"{RAG_SQL} SELECT count(*) AS total_documents, 'compliance_knowledge' AS collection_name FROM rg")


def _retrieved(spark, sf):
    hits = V.top_k(table(spark, sf, "embeddings"), _centroids(spark, sf), 5, id_col="vec_id")
    text = F.concat(F.lit("vector "), F.col("vec_id").cast("string"))
    return V.retrieval_context(hits.select(
        F.row_number().over(V.Window.orderBy("distance", "vec_id")).alias("place"), text.alias("text")))


register("rag_context", _retrieved,
         f"WITH {_EXPL}, mn AS (SELECT pos, avg(CAST(x AS DOUBLE)) AS x FROM ue GROUP BY pos), q AS (SELECT list(x ORDER BY pos) AS qv FROM mn), "
         f"t AS (SELECT vec_id, row_number() OVER (ORDER BY {_FAR}, vec_id) AS place FROM embeddings, q QUALIFY place <= 5) "
         "SELECT string_agg('[Finding ' || place || ']' || chr(10) || 'vector ' || vec_id, chr(10) || chr(10) ORDER BY place) AS context FROM t")


def _state(spark, sf):
    runs = scans(spark, sf).where(F.col("source_id") == "error").withColumnRenamed("scanned_at", "started_at")
    trend = trends(spark, sf).where(F.col("source_id") == "user1")
    changes = table(spark, sf, "events").where(F.col("event_type") == "error").select(
        F.col("event_id").alias("change_id"), F.col("ts").alias("detected_at"), F.lit("new_column").alias("change_type"),
        F.concat(F.lit("t.c"), F.col("user_id").cast("string")).alias("entity_name"), F.lit("high").alias("severity"))
    return V.state_context(runs, trend, changes)


register("rag_state_context", _state,
         f"WITH {SCAN_SQL}, {MET_SQL}, a AS (SELECT * FROM scans WHERE source_id = 'error' ORDER BY scanned_at DESC LIMIT 3), "
         "b AS (SELECT * FROM met WHERE source_id = 'user1' ORDER BY trend_date DESC LIMIT 1), c AS (SELECT * FROM events WHERE event_type = 'error' ORDER BY ts DESC LIMIT 3) "
         "SELECT concat_ws(chr(10), (SELECT 'Recent Scans: ' || string_agg('Scan ' || scan_id[:8] || ' on ' || strftime(scanned_at, '%Y-%m-%d') || ': ' || total_flags || ' flags, risk=' || highest_risk, '; ' "
         "ORDER BY scanned_at DESC) FROM a), (SELECT 'Latest Risk Trend: score=' || printf('%.1f', risk_score) || ', compliance=' || printf('%.1f', compliance_pct) || '%, violations=' || total_violations FROM b), "
         "(SELECT 'Recent Schema Changes: ' || string_agg('new_column on t.c' || user_id || ' (high)', '; ' ORDER BY ts DESC) FROM c)) AS context")

# Streams ------------------------------------------------------------------------------


def _stream(spark, sf, name):
    """A table as a stream, whether it is one file or a folder of them: by a pattern, since a stream takes a plain path for a folder."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _run(spark, stream, name):
    root = shared_dir(spark, name)
    STR.run_available(stream, f"{root}/out", f"{root}/state")
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def _stream_results(spark, sf):
    v = F.col("value")
    return _stream(spark, sf, "events").select(
        F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("ts"), "user_id",
        F.when(v >= 200, "critical").when(v >= 100, "high").when(v >= 50, "medium").otherwise("low").alias("risk_level"))


def _st_scan(spark, sf):
    out = _run(spark, STR.scan_stream(document_pages(spark, sf, _stream(spark, sf, "documents"))), "scan")
    return out.select("doc_id", "page_num", "check_type", "category", F.coalesce("value", F.lit("")).alias("value"), "risk_level", "rule_order", "start")


def _scan_sql():
    from workload import documents as DOC
    return (f"WITH {S.DOCS}, {DOC.FIND_CTE} SELECT doc_id, page_num, lower(type) AS check_type, category, value, risk_level, "
            "CAST(rule_order AS INT) AS rule_order, CAST(start AS INT) AS start FROM fi")


register("st_scan", _st_scan, _scan_sql())


def _st_trend(spark, sf):
    root = shared_dir(spark, "trend")
    found = results(spark, sf, _stream(spark, sf, "events"))
    STR.run_trend(found.select(F.col("event_type").alias("source_id"), "day", "entity_name", "check_type", "risk_level"), root)
    return STR.read_trend(spark, root).select(*RS.TREND)


register("st_trend", _st_trend,
         f"WITH {RES_SQL.replace(chr(39) + 'user' + chr(39) + ' || user_id AS source_id', 'event_type AS source_id')}, {MET_SQL} SELECT {TREND_COLS} FROM met")
register("st_dedupe", lambda spark, sf: _run(spark, STR.dedupe_stream(
    _stream_results(spark, sf).withColumn("finding_id", F.concat_ws("-", "source", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))),
    "ts", "finding_id", "2 days").select("finding_id"), "dedupe"),
    "SELECT DISTINCT event_type || '-' || user_id || '-' || strftime(ts, '%Y%m%d') AS finding_id FROM events")


# Gaps differ inside one key; some alerts name none, some have none.
_GAPS = (None, 0, -5, 60, 240, 1440, 30)


def _gap_alerts(events):
    return events.where("value >= 100").select(
        F.lit("c0").alias("config_id"), F.col("event_type").alias("source_id"), F.col("ts").alias("sent_at"),
        F.element_at(F.array(*[F.lit(g).cast("int") for g in _GAPS]), (F.col("user_id") % len(_GAPS) + 1).cast("int")).alias("cooldown_minutes"))


GAP_SQL = ("WITH RECURSIVE al AS (SELECT event_type AS source_id, CAST(floor(epoch(ts)) AS BIGINT) AS second, "
           "60 * coalesce(list_extract([NULL, 0, -5, 60, 240, 1440, 30], CAST(user_id % 7 + 1 AS INT)), 30) AS gap FROM events WHERE value >= 100), "
           "se AS (SELECT source_id, second, min(gap) AS gap FROM al WHERE gap > 0 GROUP BY ALL), "
           "kept AS (SELECT source_id, min(second) AS second FROM se GROUP BY ALL UNION ALL SELECT k.source_id, min(s.second) FROM kept k "
           "JOIN se s ON k.source_id = s.source_id AND s.second - s.gap >= k.second GROUP BY k.source_id, k.second) "
           "SELECT 'c0' AS config_id, source_id, second FROM kept UNION ALL SELECT 'c0', source_id, second FROM al WHERE gap <= 0")


def _st_cooldown(spark, sf):
    root = shared_dir(spark, "cooldown")
    stream = STR.cooldown_stream(_gap_alerts(_stream(spark, sf, "events")), longest_minutes=1440)
    STR.run_available(stream, f"{root}/out", f"{root}/state", rocksdb=True)
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


register("st_alert_cooldown", _st_cooldown, GAP_SQL)
register("alert_cooldown_gaps", lambda spark, sf: A.apply_cooldown(_gap_alerts(table(spark, sf, "events"))).select(
    "config_id", "source_id", A.whole_seconds(F.col("sent_at"), "timestamp_ntz").alias("second")), GAP_SQL)

# SQL functions ---------------------------------------------------------------------------


def _sql_functions(spark, sf):
    registration.register(spark)
    M.curr_columns(spark, sf).createOrReplaceTempView("palisade_columns")
    return spark.sql("SELECT source_id, table_name, column_name, classify_column(column_name).classification AS classification, "
                     "mask_value('GENERIC', column_name) AS masked FROM palisade_columns")


register("fn_sql", _sql_functions,
         f"{M.PAIR}, {M.CLS_SQL} SELECT source_id, table_name, column_name, classification, CASE WHEN length(column_name) > 6 THEN column_name[:3] || repeat('*', length(column_name) - 5) || "
         "right(column_name, 2) ELSE repeat('*', length(column_name)) END AS masked FROM cls")


def _detect_in_sql(spark, sf):
    registration.register(spark)
    table(spark, sf, "benchmark").select(
        "item_id", F.concat("text", pick(SNIPPETS, F.col("item_id"))).alias("text")).createOrReplaceTempView("palisade_texts")
    return spark.sql("SELECT item_id, f.category, f.value, f.risk_level FROM (SELECT item_id, detect_pii(text) AS found FROM palisade_texts) LATERAL VIEW explode(found) AS f")


def _detect_sql(source=None):
    from workload import documents as DOC
    src = source or f"pg AS (SELECT item_id AS doc_id, 1 AS page_num, text || list_extract({S.SNIPPET_LIST}, CAST(item_id % {S.N} AS INT) + 1) AS text FROM benchmark)"
    return f"WITH {src}, {S.STRIPPED}, {DOC.PII_RANKED} SELECT doc_id AS {'doc_id' if source else 'item_id'}, category, val AS value, risk_level FROM pf"


def _pii_in_sql(spark, sf):
    registration.register(spark)
    document_pages(spark, sf).createOrReplaceTempView("palisade_pages")
    return spark.sql("SELECT doc_id, f.category, f.value, f.risk_level FROM (SELECT doc_id, detect_pii(text) AS found FROM palisade_pages) LATERAL VIEW explode(found) AS f")


register("fn_detect_pii", _pii_in_sql, _detect_sql(S.DOCS))
register("fn_detect_findings", _detect_in_sql, _detect_sql())
