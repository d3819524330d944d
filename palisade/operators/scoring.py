"""From page findings to page, document and corpus risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palisade.functions import risk

CHECKS = ("pii", "confidential", "encoding", "abuse")


def score_pages(found: DataFrame) -> DataFrame:
    """Page results: one array, count and risk per check, plus the page's overall risk.

    Everything comes from the row itself; the text is dropped here.
    """
    ranks = {f"_{c}": risk.array_rank(F.col(c)) for c in CHECKS}
    # The encoding guard never reports above high.
    ranks["_encoding"] = F.least(ranks["_encoding"], F.lit(2))
    sized = found.withColumns({**ranks, "total_flags": sum((F.size(c) for c in CHECKS), F.lit(0))})
    overall = F.greatest(*[F.col(f"_{c}") for c in CHECKS], risk.count_rank(F.col("total_flags")))
    kept = [c for c in found.columns if c not in ("text", *CHECKS)]
    return sized.select(
        *kept,
        F.substring("text", 1, 200).alias("text_preview"),
        *[F.col(c).alias(f"{c}_flags") for c in CHECKS],
        *[risk.label(F.col(f"_{c}")).alias(f"{c}_risk") for c in CHECKS],
        "total_flags", risk.label(overall).alias("overall_risk"), overall.alias("risk_rank"))


def document_summary(page_results: DataFrame, *keys: str) -> DataFrame:
    """Counts by check and by risk, clean pages and document risk.

    ``keys`` defaults to the document; partial aggregates run before the
    shuffle, so one huge document costs no more than many small ones.
    """
    keys = keys or ("doc_id",)
    flags = {c: F.sum(F.size(f"{c}_flags")).alias(f"{c}_issues") for c in CHECKS}
    totals = page_results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_pages"),
        *flags.values(),
        F.sum("total_flags").alias("total_flags"),
        *[F.count_if(F.col("overall_risk") == name).alias(f"{name}_pages") for name in risk.RISK_LEVELS],
        F.count_if(F.col("total_flags") > 0).alias("pages_with_issues"),
        F.count_if(F.col("total_flags") == 0).alias("clean_pages"),
        F.max("risk_rank").alias("_page_rank"))
    final = F.greatest("_page_rank", risk.count_rank(F.col("total_flags")))
    return totals.withColumn("highest_risk", risk.label(final)).drop("_page_rank")


def corpus_rollup(document_summaries: DataFrame, *keys: str) -> DataFrame:
    """The same totals over documents, with subtotals for every prefix of ``keys``."""
    return document_summaries.rollup(*keys).agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("total_flags").alias("total_flags"),
        *[F.sum(f"{c}_issues").alias(f"{c}_issues") for c in CHECKS],
        F.max(risk.rank(F.col("highest_risk"))).alias("_rank"),
    ).withColumn("highest_risk", risk.label(F.col("_rank"))).drop("_rank")


def as_nested(page_results: DataFrame, summary: DataFrame) -> DataFrame:
    """One nested JSON result per document, for export.

    Pages go out as one JSON line each beside their document, keyed by both;
    a document is never gathered into one row.
    """
    pages = page_results.select(
        "doc_id", "page_num", F.lit("page").alias("kind"),
        F.to_json(F.struct(*[c for c in page_results.columns if c != "doc_id"])).alias("json"))
    heads = summary.select(
        "doc_id", F.lit(0).alias("page_num"), F.lit("summary").alias("kind"),
        F.to_json(F.struct(*[c for c in summary.columns if c != "doc_id"])).alias("json"))
    return heads.unionByName(pages)
