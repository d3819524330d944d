"""URL filter: host and path rules first, then gradient-boosted trees on lexical features.

Built from DataFrame functions and Spark's own tree learner alone.  URLs that a rule fits are the labelled ones; the trees are
trained on at most ``sample`` different ones (a documented bound: half from each label, those with the smallest hash, weighted by their rows) and judge the URLs no rule fits.

Features: length, path depth, share of digits, entropy of the characters, number of query parameters, length of the host,
and suffix statistics: the smoothed share of blocked URLs per top-level label and per last two labels of the host, counted
over **all** labelled URLs.  The statistics are joined back by suffix; they hold one row per suffix, so a suffix of a third
of all rows is a small row on one side, and Spark may broadcast them or split the other side.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from palisade.llm import base

#: (verdict, rule): host suffix, then the start of the path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["f_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_host", "f_top", "f_domain"]


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule whose host is the URL's or a domain above it and whose path starts the URL's; and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):  # longer ones stand outside and win
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    logs = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda total, c: total + F.when(
        F.length(c) > 0, (n - F.length(F.replace(text, c, F.lit("")))) * F.log2(n - F.length(F.replace(text, c, F.lit(""))))).otherwise(0.0))
    return F.when(n > 0, F.log2(n) - logs / n).otherwise(0.0)


def features(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, ruled, the lexical features, and the suffixes ``top`` and ``domain``."""
    url = F.coalesce("url", F.lit(""))
    own = base.only(pages, "page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return own.withColumns({
        "rule": rule, "ruled": verdict,
        "f_length": F.length(url).cast("double"),
        "f_depth": F.size(F.filter(F.split("path", "/"), lambda part: part != "")).cast("double"),
        "f_digits": F.coalesce(F.try_divide(F.length(F.regexp_replace(url, "[^0-9]", "")), F.length(url)), F.lit(0.0)),
        "f_entropy": entropy(url),
        "f_params": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
        "f_host": F.length("host").cast("double"),
        "top": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2)})


def suffix_statistics(rows: DataFrame, suffix: str, name: str, weight: float = 20.0) -> DataFrame:
    """Share of blocked URLs per suffix among labelled ones, drawn to one half with the weight of ``weight`` URLs."""
    blocked = F.sum((F.col("ruled") == "block").cast("long"))
    stats = rows.where("ruled is not null").groupBy(suffix).agg(((blocked + weight / 2) / (F.count("*") + weight)).alias(name))
    return base.written(stats, name)


def judged(pages: DataFrame, rules=RULES, sample: int = 20_000, trees: int = 15, depth: int = 4, seed: int = 42) -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    Only ``page_id`` and ``url`` are read.  A null URL, or one without ``://``, has an empty host and path and is left to
    the trees.  Equal URLs get equal verdicts.  If the rules label nothing, or only one way, there are no trees and
    what no rule fits gets ``allow`` (or the one verdict there is).  A long URL is read whole; an empty table gives an empty one.
    """
    rows = features(pages, rules)
    for suffix, name in (("top", "f_top"), ("domain", "f_domain")):
        rows = rows.join(suffix_statistics(rows, suffix, name), suffix, "left").withColumn(name, F.coalesce(name, F.lit(0.5)))
    label = (F.col("ruled") == "block").cast("double").alias("label")
    urls = rows.where("ruled is not null").groupBy("url").agg(
        *[F.first(c).alias(c) for c in FEATURES], F.first(label).alias("label"), F.count("*").cast("double").alias("weight"))
    urls = urls.withColumn("h", F.xxhash64("url"))
    half = [urls.where(F.col("label") == x).orderBy("h", "url").limit(sample // 2).drop("h", "url") for x in (0.0, 1.0)]
    known = base.written(half[0].unionByName(half[1]), "labelled")
    kinds = [r["label"] for r in known.select("label").distinct().collect()]
    if len(kinds) == 2:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, cacheNodeIds=False, weightCol="weight").fit(vectors.transform(known))
        scored = model.transform(vectors.transform(rows))
        scored = scored.withColumn("blocked", F.col("prediction") == 1.0)
    else:
        scored = rows.withColumn("blocked", F.lit(kinds == [1.0]))
    return scored.select("page_id", "host", "path", "rule", F.coalesce(
        "ruled", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))


def op2(spark, sf_dir):
    return judged(base.table(spark, sf_dir, "pages"))
