"""Report tables, store queries and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions import risk
from palisade.functions.masking import HIDDEN, mask_value
from palisade.functions.text import percent, strip
from palisade.operators import store
from palisade.operators.detect import explode_findings
from palisade.operators.scoring import CHECKS

PAGE = ("doc_id", "page_num")


def findings_table(page_results: DataFrame) -> DataFrame:
    """Long findings table of scored pages."""
    return explode_findings(page_results, {c: f"{c}_flags" for c in CHECKS})


def _severity(f: DataFrame) -> Column:
    return F.upper(F.coalesce("risk_level", F.lit("medium")))


def confidence_label(confidence: Column, severity: Column) -> Column:
    guess = F.when(severity == "critical", "95%+").when(severity == "high", "90%+") \
        .when(severity == "medium", "75%+").when(severity == "low", "65%+").otherwise("70%")
    return F.when(confidence.isNotNull(), percent(confidence)).otherwise(guess)


def report_rows(findings: DataFrame) -> DataFrame:
    """The flattened findings of the report."""
    value, shown = F.col("value"), F.coalesce(F.nullif("context", F.lit("")), F.nullif("note", F.lit("")), F.lit(""))
    context = strip(F.translate(shown, "\n", " "))
    return findings.select(
        *PAGE, F.upper("check_type").alias("type"), "category", "rule_order", "start",
        F.when(value.isNull() | (value == "") | (value == HIDDEN[1]), "[redacted]")
        .otherwise(F.substring(value, 1, 50)).alias("matched"),
        _severity(findings).alias("severity"),
        F.when(F.col("detection_method").isin("regex", "keyword"), "Regex").otherwise("AI").alias("method"),
        confidence_label(F.col("confidence"), F.col("risk_level")).alias("confidence"),
        F.when(F.length(context) > 70, F.concat(F.substring(context, 1, 70), F.lit("…"))).otherwise(context)
        .alias("context"))


def redaction_table(findings: DataFrame) -> DataFrame:
    """One row per finding with the value as it may be shown."""
    return findings.select(
        *PAGE, F.upper("check_type").alias("type"), F.coalesce("category", F.lit("UNKNOWN")).alias("category"),
        "rule_order", "start",
        F.when(F.col("value").isin(*HIDDEN), "—").otherwise(F.col("value")).alias("matched"),
        mask_value(F.col("category"), F.col("value")).alias("masked"),
        F.coalesce(percent(F.col("confidence")), F.lit("N/A")).alias("confidence"),
        _severity(findings).alias("severity"),
        F.substring(F.coalesce(F.nullif("context", F.lit("")), F.nullif("note", F.lit("")), F.lit("")), 1, 80)
        .alias("context"),
        F.initcap(F.coalesce("detection_method", F.lit("ai"))).alias("method"))


def type_risk_filter(results: DataFrame, types, levels, type_col="check_type", risk_col="risk_level") -> DataFrame:
    return results.where(F.col(type_col).isin(*types) & F.coalesce(risk_col, F.lit("low")).isin(*levels))


def heatmap(page_results: DataFrame) -> DataFrame:
    return page_results.select(*PAGE, *[F.size(f"{c}_flags").alias(c) for c in CHECKS],
                               F.col("total_flags").alias("total"), F.upper("overall_risk").alias("risk"))


def summary_rows(summary: DataFrame) -> DataFrame:
    """Metric/value rows per document."""
    # Names of the metrics.
    named = {
        "Total Pages Scanned": "total_pages", "Total Compliance Flags": "total_flags",
        "Pages with Issues": "pages_with_issues", "Clean Pages": "clean_pages", "Highest Risk Level": "_risk",
        "PII Violations": "pii_issues", "Confidentiality Issues": "confidential_issues",
        "Encoding Issues": "encoding_issues", "Abuse / Unlawful": "abuse_issues",
    }
    wide = summary.withColumn("_risk", F.upper("highest_risk")).select(
        "doc_id", *[F.col(c).cast("string").alias(n) for n, c in named.items()])
    return wide.unpivot("doc_id", list(named), "metric", "value")


# Store queries -----------------------------------------------------------------

SCAN_LIST = ("upload_id", "pdf_name", "scanned_at", "total_pages", "total_flags", "highest_risk", "status",
             "report_path", "total_tokens", "execution_time_sec", "ai_provider")


def recent_scans(scans: DataFrame, n: int = 50) -> DataFrame:
    """Newest scans without the result blob."""
    return store.newest(scans.select(*SCAN_LIST), n, "scanned_at", "upload_id")


def scan_results(results: DataFrame, by_rank: bool = False) -> DataFrame:
    """Results in stored order: the label sorts as text, or by rank when asked."""
    key = risk.rank(F.col("risk_level")) if by_rank else F.col("risk_level")
    return results.orderBy(key.desc(), "entity_name")


# Telemetry ---------------------------------------------------------------------

def numeric(col: str, kind: str) -> Column:
    """A number, or zero when the stored text is not one."""
    return F.coalesce(F.col(col).try_cast(kind),
                      F.lit(0).cast(kind))


def kpis(scans: DataFrame) -> DataFrame:
    return scans.agg(
        F.count(F.lit(1)).alias("total_scans"),
        F.bround(F.avg(numeric("execution_time_sec", "double")), 2).alias("avg_latency"),
        F.sum(numeric("total_tokens", "bigint")).alias("total_tokens"))


def scans_by_day(scans: DataFrame) -> DataFrame:
    return scans.groupBy(F.to_date("scanned_at").alias("date")).agg(F.count(F.lit(1)).alias("scans"))


def tokens_by_day(scans: DataFrame) -> DataFrame:
    return scans.groupBy(F.to_date("scanned_at").alias("date")).agg(
        F.sum(numeric("total_tokens", "bigint")).alias("tokens"))


def risk_frequency(scans: DataFrame) -> DataFrame:
    """Scans per risk level with the level's place in the order."""
    return scans.groupBy("highest_risk").agg(F.count(F.lit(1)).alias("count")) \
        .withColumn("position", risk.rank(F.col("highest_risk"))).orderBy("position")


def provider_distribution(scans: DataFrame) -> DataFrame:
    return scans.groupBy("ai_provider").agg(F.count(F.lit(1)).alias("count"))


def cost(scans: DataFrame, per_thousand: float = 0.03) -> DataFrame:
    tokens = F.sum(numeric("total_tokens", "bigint"))
    return scans.agg(F.bround(tokens * per_thousand / 1000, 2).alias("cost"))


def total_tokens(usage: DataFrame) -> DataFrame:
    """Tokens per scan over its model checks."""
    return usage.groupBy("upload_id").agg(F.sum("tokens").alias("total_tokens"))
