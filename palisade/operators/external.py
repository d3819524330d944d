"""Findings that come from outside (a model's stored replies) and how they join the pattern findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.text import let, strip
from palisade.operators.detect import FINDINGS_TYPE
from palisade.rules import SEMANTIC_SECRET_CATEGORIES

REPLY_TYPE = ("array<struct<category:string,value:string,context:string,"
              "confidence:double,risk_level:string>>")
PAGE = ("doc_id", "page_num")


def unfence(raw: Column) -> Column:
    """Remove a Markdown code fence around a reply."""
    text = strip(raw)
    text = F.when(text.startswith("```json"), F.substring(text, 8, 2147483647)) \
        .when(text.startswith("```"), F.substring(text, 4, 2147483647)).otherwise(text)
    text = F.when(text.endswith("```"), F.substring(text, F.lit(1), F.length(text) - 3)).otherwise(text)
    return strip(text)


def parse_responses(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Parse stored replies: the text itself, else its widest ``{...}``.

    Adds ``parsed`` (variant), ``outcome`` and ``findings``; a reply that is no
    JSON either way keeps a null ``parsed`` and no findings.
    """
    body = responses.withColumn("_body", unfence(F.col(raw)))
    body = body.withColumn("_whole", F.try_parse_json("_body")).withColumn(
        "_inner", F.when(F.col("_whole").isNull(), F.try_parse_json(F.regexp_extract("_body", r"(?s)\{.*\}", 0))))
    return body.select(
        *responses.columns,
        F.coalesce("_whole", "_inner").alias("parsed"),
        F.when(F.col("_whole").isNotNull(), "parsed").when(F.col("_inner").isNotNull(), "extracted")
        .otherwise("failed").alias("outcome"),
        F.coalesce(F.try_variant_get(F.coalesce("_whole", "_inner"), "$.findings", REPLY_TYPE),
                   F.array().cast(REPLY_TYPE)).alias("findings"))


def explode_responses(parsed: DataFrame, check_type: str, min_confidence: float) -> DataFrame:
    """External findings table from parsed replies, in reply order."""
    return (parsed.select(*PAGE, F.posexplode("findings").alias("seq", "f"))
            .select(*PAGE, F.lit(check_type).alias("check_type"), "seq", "f.*")
            .where(F.coalesce("confidence", F.lit(0.0)) >= min_confidence))


def group_external(external: DataFrame, check_type: str) -> DataFrame:
    """One array of external findings per page, in ``seq`` order.

    The unit is one model reply for one page.  For personal data a repeat of a
    value can never survive the merge after its first occurrence, so repeats
    are dropped by a partial aggregate before anything is collected.
    """
    rows = external.where(F.col("check_type") == check_type)
    entry = F.struct("seq", "category", "value", "context", "confidence", "risk_level")
    if check_type == "pii":
        rows = rows.groupBy(*PAGE, strip(F.lower(F.coalesce("value", F.lit("")))).alias("_v")).agg(F.min(entry).alias("f"))
    else:
        rows = rows.select(*PAGE, entry.alias("f"))
    return rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list("f")).alias(f"{check_type}_external"))


def _as_finding(e: Column) -> Column:
    return F.struct(
        (F.lit(1000) + e["seq"]).cast("int").alias("rule_order"), F.lit(-1).alias("start"), F.lit(-1).alias("end"),
        e["category"].alias("category"), e["value"].alias("value"), e["context"].alias("context"),
        e["confidence"].alias("confidence"), e["risk_level"].alias("risk_level"),
        F.lit("ai").alias("detection_method"), F.lit("").alias("note"))


def merge_pii(found: Column, external: Column) -> Column:
    """Add external findings whose value neither contains nor is contained in an accepted one.

    Order matters: an accepted value blocks later ones, so this is a fold.
    """
    start = F.struct(
        F.filter(F.transform(found, lambda f: F.lower(f["value"])), lambda v: v != "").alias("seen"),
        F.array().cast(FINDINGS_TYPE).alias("kept"))

    def step(acc, e):
        value = strip(F.lower(F.coalesce(e["value"], F.lit(""))))
        clash = F.exists(acc["seen"], lambda v: F.contains(v, value) | F.contains(value, v))
        take = (value != "") & ~clash
        return F.struct(
            F.when(take, F.concat(acc["seen"], F.array(value))).otherwise(acc["seen"]).alias("seen"),
            F.when(take, F.concat(acc["kept"], F.array(_as_finding(e)).cast(FINDINGS_TYPE)))
            .otherwise(acc["kept"]).alias("kept"))

    return F.when(external.isNull(), found).otherwise(
        F.concat(found, F.aggregate(external, start, step, lambda acc: acc["kept"])))


def merge_secrets(found: Column, external: Column) -> Column:
    """Keep external findings only for meanings no pattern can see and no pattern found."""
    def kept(names):
        return F.transform(
            F.filter(external, lambda e: e["category"].isin(*SEMANTIC_SECRET_CATEGORIES)
                     & ~F.array_contains(names, e["category"])),
            lambda e: _as_finding(e)).cast(FINDINGS_TYPE)

    return F.when(external.isNull(), found).otherwise(
        let(F.transform(found, lambda f: f["category"]), lambda names: F.concat(found, kept(names))))


def external_layer(external: Column) -> Column:
    """External findings as one more layer for the abuse merge."""
    return F.coalesce(F.transform(external, lambda e: _as_finding(e)).cast(FINDINGS_TYPE),
                      F.array().cast(FINDINGS_TYPE))
