"""Sensitivity of columns by their names and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions import risk
from palisade.functions.patterns import compile_pattern
from palisade.rules import COLUMN_RULES, UNCLASSIFIED, VALUE_RULES

FIELDS = ("classification", "confidence", "risk_level", "recommendation", "match_method")


def _label(values) -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in zip(FIELDS, values)])


def classify_column(name: Column, samples: Column | None = None) -> Column:
    """Struct with label, confidence, risk, recommendation and method.

    First matching name rule wins; samples (an array of values) are looked at
    only when the name says nothing.
    """
    lowered = F.lower(name)
    expr = None
    for rule in COLUMN_RULES:
        hit = lowered.rlike("|".join(compile_pattern(p) for p in rule.patterns))
        label = _label((rule.label, rule.confidence, rule.risk, rule.recommendation, "name_pattern"))
        expr = F.when(hit, label) if expr is None else expr.when(hit, label)
    if samples is not None:
        joined = F.array_join(F.slice(samples, 1, 10), " ")
        for label, pattern, confidence, level, advice, edges in VALUE_RULES:
            expr = expr.when(joined.rlike(compile_pattern(pattern, edges=edges)),
                             _label((label, confidence, level, advice, "value_pattern")))
    return expr.otherwise(_label(UNCLASSIFIED))


def classify_columns(columns: DataFrame, samples: str | None = None) -> DataFrame:
    """Every column with its classification."""
    found = columns.withColumn("_c", classify_column(F.col("column_name"), F.col(samples) if samples else None))
    return found.select(*columns.columns, "_c.*")


def check_type(classification: Column) -> Column:
    upper = F.upper(F.coalesce(classification, F.lit("")))
    return F.when(upper.rlike("^(PII|PHI)"), "pii").when(upper.rlike("^(PCI|CONFIDENTIAL)"), "confidential") \
        .otherwise("custom")


def evidence(column: Column, data_type: Column, method: Column) -> Column:
    return F.concat(F.lit("Column name: "), column, F.lit(" | Type: "), F.coalesce(data_type, F.lit("")),
                    F.lit(" | Method: "), F.coalesce(method, F.lit("")))


def scan_columns(columns: DataFrame, scope: DataFrame | None = None, samples: str | None = None) -> DataFrame:
    """Scan results for the classified columns.

    ``scope``: distinct ``(source_id, table_name)`` to look at; without it, everything.
    """
    rows = columns.join(scope, ["source_id", "table_name"], "left_semi") if scope is not None else columns
    found = classify_columns(rows, samples).where(F.col("classification") != UNCLASSIFIED[0])
    return found.select(
        "source_id", "table_name", "column_name",
        F.concat_ws(".", "table_name", "column_name").alias("entity_name"),
        F.lit("column").alias("entity_type"),
        check_type(F.col("classification")).alias("check_type"),
        F.col("classification").alias("flag_category"),
        "confidence", "risk_level", "match_method", "data_type",
        evidence(F.col("column_name"), F.col("data_type"), F.col("match_method")).alias("evidence"),
        "recommendation")


def merge_external(results: DataFrame, external: DataFrame, min_confidence: float = 0.70) -> DataFrame:
    """Add external classifications of entities no rule classified.

    Of several for one entity the first given (least ``seq``) stands.
    """
    fresh = (external.where((F.col("entity_name") != "") & (F.col("confidence") >= min_confidence))
             .join(results.select("source_id", "entity_name"), ["source_id", "entity_name"], "left_anti"))
    first = fresh.groupBy("source_id", "entity_name").agg(F.min_by(
        F.struct("classification", "risk_level", "confidence", "recommendation"), F.col("seq")).alias("f"))
    table = F.substring_index("entity_name", ".", 1)
    column = F.when(F.contains("entity_name", F.lit(".")),
                    F.substring("entity_name", F.length(table) + 2, F.length("entity_name"))) \
        .otherwise(F.col("entity_name"))
    label = F.coalesce("f.classification", F.lit("AI_FLAGGED"))
    rows = first.select(
        "source_id", table.alias("table_name"), column.alias("column_name"), "entity_name",
        F.lit("column").alias("entity_type"), check_type(label).alias("check_type"), label.alias("flag_category"),
        F.col("f.confidence").alias("confidence"),
        F.coalesce("f.risk_level", F.lit("medium")).alias("risk_level"),
        F.lit("ai").alias("match_method"), F.lit("").alias("data_type"),
        evidence(column, F.lit(""), F.lit("ai")).alias("evidence"),
        F.coalesce("f.recommendation", F.lit("Review this column.")).alias("recommendation"))
    return results.unionByName(rows)


def classify_tables(classified: DataFrame) -> DataFrame:
    """Per table: highest risk, personal-data and sensitive columns, compliance score."""
    sensitive = F.col("classification") != UNCLASSIFIED[0]
    n, s = F.count(F.lit(1)), F.count_if(sensitive)
    return classified.groupBy("source_id", "table_name").agg(
        risk.label(F.max(risk.rank(F.col("risk_level")))).alias("highest_risk"),
        F.count_if(F.col("classification").startswith("PII")).alias("pii_columns"),
        s.alias("sensitive_columns"), n.alias("total_columns"),
        F.bround((1 - s / F.greatest(n, F.lit(1))) * 100, 1).alias("compliance_score"))
