"""Document scan: pages in, page results, findings and document summaries out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.operators import detect as D
from palisade.operators import external as X
from palisade.operators.encoding import detect_encoding
from palisade.operators.reports import findings_table
from palisade.operators.scoring import document_summary, score_pages
from palisade.rules import ABUSE_PHRASES, ABUSE_SIGNALS, PII_RULES, SECRET_RULES, default_rules

PAGE = ("doc_id", "page_num")


def detect_all(pages: DataFrame, rules: dict | None = None, external: DataFrame | None = None,
               language: Column | None = None) -> DataFrame:
    """Pages with one array of findings per check.

    All detectors run in the stage that reads the text.  ``external`` findings
    are joined only after the text has been dropped down to its preview.
    """
    rules = rules or default_rules()
    pii, conf, enc, abuse = (rules.get(k, {}) for k in ("pii", "confidentiality", "encoding", "abuse"))
    families = {}
    if pii.get("enabled", True):
        families["pii"] = (D.at_least(PII_RULES, pii.get("min_confidence", 0.75)), 60)
    if conf.get("enabled", True):
        families["confidential"] = (D.at_least(SECRET_RULES, conf.get("min_confidence", 0.70)), 60)
    if abuse.get("enabled", True):
        families["_phrases"], families["_signals"] = (ABUSE_PHRASES, 80), (ABUSE_SIGNALS, 40)
    found = D.locate_matches(pages, families)
    if enc.get("enabled", True):
        found = detect_encoding(found, enc, language=language)
    else:
        found = found.withColumn("encoding", D.no_findings())
    keywords = conf.get("custom_keywords", []) if conf.get("enabled", True) and conf.get("match_keywords", False) else []
    if keywords:
        found = found.withColumn("_keywords", D.custom_keyword_findings(F.col("text"), keywords))
    found = found.withColumn("text", F.substring("text", 1, 200))
    columns = {
        "pii": D.pii_findings(F.col("pii"), families["pii"][0]) if families.get("pii", [()])[0] else D.no_findings(),
        "confidential": D.secret_findings(F.col("confidential"), families["confidential"][0])
        if families.get("confidential", [()])[0] else D.no_findings(),
    }
    if keywords:
        columns["confidential"] = F.concat(columns["confidential"], F.col("_keywords"))
    terms = abuse.get("zero_tolerance_categories", ["child_safety", "terrorism"])
    layers = []
    if "_phrases" in families:
        layers = [D.phrase_findings(F.col("_phrases")), D.signal_findings(F.col("_signals"))]
    if external is None:
        columns["abuse"] = D.merge_abuse(*[D.zero_tolerance(x, terms) for x in layers]) if layers else D.no_findings()
        return found.withColumns(columns).drop("_phrases", "_signals", "_keywords")
    kept = external.where(F.coalesce("confidence", F.lit(0.0)) >= F.when(
        F.col("check_type") == "pii", pii.get("min_confidence", 0.75)).when(
        F.col("check_type") == "confidential", conf.get("min_confidence", 0.70)).otherwise(0.0))
    found = found.withColumns(columns)
    for check in ("pii", "confidential", "abuse"):
        found = found.join(X.group_external(kept, check), list(PAGE), "left")
    merged = {
        "pii": X.merge_pii(F.col("pii"), F.col("pii_external")) if "pii" in families else D.no_findings(),
        "confidential": X.merge_secrets(F.col("confidential"), F.col("confidential_external"))
        if "confidential" in families else D.no_findings(),
        "abuse": D.merge_abuse(*[D.zero_tolerance(x, terms) for x in (
            *layers, X.external_layer(F.col("abuse_external")))]) if layers else D.no_findings(),
    }
    return found.withColumns(merged).drop("_phrases", "_signals", "_keywords", "pii_external", "confidential_external",
                                          "abuse_external")


def scan_pages(pages: DataFrame, rules: dict | None = None, external: DataFrame | None = None,
               language: Column | None = None) -> DataFrame:
    """Page results.  Write these to a table when more than one output is wanted."""
    return score_pages(detect_all(pages, rules, external, language))


def scan_documents(pages: DataFrame, rules: dict | None = None, external: DataFrame | None = None,
                   language: Column | None = None, results_path: str | None = None):
    """(findings, page results, document summary).

    With ``results_path`` the page results are written there once and the
    other outputs are read from it, so the text is scanned a single time and a
    lost executor never repeats the scan.
    """
    results = scan_pages(pages, rules, external, language)
    if results_path:
        results.write.mode("errorifexists").parquet(results_path)
        results = pages.sparkSession.read.parquet(results_path)
    return findings_table(results), results, document_summary(results)
