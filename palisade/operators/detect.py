"""Pattern detectors over pages of text.

A page is one row and everything a detector needs to know about a page is in
that row, so matching, locating, cutting contexts and removing duplicates all
happen inside the row: the text is read once, never shuffled, and only short
findings leave the stage.  Work per page is n·sqrt(n) in its n matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from palisade.functions import risk
from palisade.functions.patterns import compile_pattern, compile_rule, gate_pattern
from palisade.functions.text import first_per_key, let, running_sum, sql_string, strip
from palisade.rules import ABUSE_PHRASES, ABUSE_SIGNALS, PII_RULES, SECRET_RULES, TextRule

FINDING = T.StructType([
    T.StructField("rule_order", T.IntegerType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("category", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("detection_method", T.StringType()),
    T.StructField("note", T.StringType()),
])
FINDINGS_TYPE = f"array<{FINDING.simpleString()}>"
MATCHES_TYPE = "array<struct<family:int,rule_order:int,start:int,end:int,raw:string,context:string>>"
REDACTED = "[REDACTED]"


def scannable_text(text: Column) -> Column:
    """Stripped text, or null for blank pages and page markers."""
    body = strip(text)
    return let(body, lambda t: F.when((t != "") & ~t.startswith("[PAGE"), t))


def _gated(rule: TextRule) -> bool:
    return rule.ignore_case and not rule.guard


def _gate_of(rule: TextRule) -> str:
    return "_gate_word" if rule.pattern.startswith(r"\b") else "_gate_free"


def _guarded(rule: TextRule) -> Column:
    """All hits of one rule, tried only on pages that pass the rule's cheap test."""
    test = "true"
    if rule.guard and rule.guard.startswith("near:"):
        test = f"rlike(_near, {sql_string(compile_pattern(rule.guard.split(':', 1)[1]))})"
    elif rule.guard:
        test = f"contains(_text, {sql_string(rule.guard.split(':', 1)[1])})"
    elif _gated(rule):
        test = _gate_of(rule)
    return F.expr(f"CASE WHEN {test} THEN regexp_extract_all(_text, {sql_string(compile_rule(rule))}, 0) END")


def _context(hits: Column, gaps: Column, i: Column, start: Column, end: Column, total: Column, width: Column) -> Column:
    """``width`` characters either side of hit ``i``.

    The text beside a hit is put together from the gaps between hits (trimmed
    to ``width`` beforehand), so a context never walks the page from its start.
    """
    n = F.size(hits)

    def tail(s):
        return F.substring(s, -width, width)

    def head(s):
        return F.substring(s, F.lit(1), width)

    near_left, near_right = F.get(gaps, i)["tail"], F.get(gaps, i + 1)["head"]
    back = F.least(i, width)
    before = F.zip_with(F.slice(gaps, i - back + 1, back), F.slice(hits, i - back + 1, back),
                        lambda g, h: F.concat(g["tail"], tail(h)))
    ahead = F.least(n - i - 1, width)
    after = F.zip_with(F.slice(hits, i + 2, ahead), F.slice(gaps, i + 3, ahead),
                       lambda h, g: F.concat(head(h), g["head"]))
    left = F.when((i == 0) | (F.length(near_left) >= width), near_left).otherwise(
        tail(F.concat(F.array_join(before, ""), near_left)))
    right = F.when((i == n - 1) | (F.length(near_right) >= width), near_right).otherwise(
        head(F.concat(near_right, F.array_join(after, ""))))
    snippet = strip(F.translate(F.concat(left, F.get(hits, i), right), "\n", " "))
    return F.concat(F.when(start > width, "…").otherwise(""), snippet,
                    F.when(total - end > width, "…").otherwise(""))


def _ends(hits: Column, gaps: Column, size) -> Column:
    return running_sum(F.zip_with(F.transform(gaps, size), F.transform(hits, size), lambda g, h: g + F.coalesce(h, F.lit(0))))


def _locate(group: Column, byte_offsets: bool = False) -> Column:
    """All hits of one rule as structs: family, rule, raw match, offsets and context, or byte offsets instead of the latter."""
    hits, gaps, width = group["hits"], group["gaps"], group["width"]
    if byte_offsets:
        return let(_ends(hits, gaps, F.octet_length), lambda ends: F.transform(hits, lambda h, i: F.struct(
            group["family"].alias("family"), group["rule_order"].alias("rule_order"),
            (F.get(ends, i) - F.octet_length(h)).alias("first"), F.get(ends, i).alias("last"), h.alias("raw"))))
    trimmed = F.transform(gaps, lambda g: F.struct(
        F.substring(g, -width, width).alias("tail"), F.substring(g, F.lit(1), width).alias("head")))

    def rows(ends):
        total = F.element_at(ends, -1)
        return let(trimmed, lambda parts: F.transform(hits, lambda h, i: let(
            F.get(ends, i), lambda end: F.struct(
                group["family"].alias("family"), group["rule_order"].alias("rule_order"),
                (end - F.length(h)).alias("start"), end.alias("end"), h.alias("raw"),
                _context(hits, parts, i, end - F.length(h), end, total, width).alias("context")))))

    return let(_ends(hits, gaps, F.length), rows)


def locate_matches(pages: DataFrame, rules: dict, text: str = "text", byte_offsets: bool = False) -> DataFrame:
    """Add one array column of located matches per rule family.

    ``rules`` maps the new column's name to ``(rule tuples, context width)``.
    Three narrow steps: cheap tests, then hits per rule, then offsets and
    contexts of whatever was hit.
    """
    base = pages.withColumn("_text", scannable_text(F.col(text)))
    # The digits with up to two characters between them; longer stretches without digits are two spaces.
    tests = {"_near": F.regexp_replace("_text", r"[^\p{Nd}]{2}[^\p{Nd}]++", "  ")}
    # Rules without a test of their own share one gate per kind over all families.
    for gate in ("_gate_word", "_gate_free"):
        gated = [r for family, _ in rules.values() for r in family if _gated(r) and _gate_of(r) == gate]
        if gated:
            tests[gate] = F.col("_text").rlike(gate_pattern(gated))
    hit_cols, groups = {}, []
    for n, (family, width) in enumerate(rules.values()):
        for k, rule in enumerate(family):
            hits = f"_hits{n}_{k}"
            hit_cols[hits] = _guarded(rule)
            groups.append(F.expr(
                f"CASE WHEN size({hits}) > 0 THEN struct({n} AS family, {k} AS rule_order, {width} AS width, {hits} AS hits, "
                f"split(_text, {sql_string(compile_rule(rule))}, -1) AS gaps) END"))
    if not groups:
        return pages.withColumns({name: F.array().cast(MATCHES_TYPE) for name in rules})
    base = base.withColumns(tests).withColumns(hit_cols)
    base = base.withColumn("_groups", F.array_compact(F.array(*groups))).drop(*hit_cols, *tests, "_text")
    base = base.withColumn("_matches", F.flatten(F.transform("_groups", lambda g: _locate(g, byte_offsets)))).drop("_groups")
    return base.withColumns({
        name: F.expr(f"filter(_matches, m -> m.family = {n})") for n, name in enumerate(rules)}).drop("_matches")


def _meta(rules: tuple, field: str, order: Column) -> Column:
    """A rule attribute looked up by rule number."""
    values = [getattr(r, field) for r in rules]
    items = ", ".join(sql_string(v) if isinstance(v, str) else f"{v}D" for v in values)
    return F.get(F.expr(f"array({items})"), order)


def _finding(match: Column, rules: tuple, key: Column, value: Column, context: Column, method: str) -> Column:
    order = match["rule_order"]
    return F.struct(
        key.alias("key"), order.alias("rule_order"), match["start"].alias("start"), match["end"].alias("end"),
        _meta(rules, "category", order).alias("category"), value.alias("value"), context.alias("context"),
        _meta(rules, "confidence", order).alias("confidence"), _meta(rules, "risk", order).alias("risk_level"),
        F.lit(method).alias("detection_method"), F.lit("").alias("note"))


def _in_order(items: Column) -> Column:
    """Drop the key; what is left begins with rule and offset, so sorting restores page order."""
    return F.array_sort(F.transform(items, lambda f: F.struct(*[f[n].alias(n) for n in FINDING.names])))


def pii_findings(matches: Column, rules: tuple = PII_RULES) -> Column:
    """First occurrence of each value on the page, earlier rules first."""
    rows = F.transform(matches, lambda m: let(strip(m["raw"]), lambda v: _finding(
        m, rules, v, F.substring(v, 1, 80), m["context"], "regex")))
    return _in_order(first_per_key(F.filter(rows, lambda f: f["key"] != "")))


def mask_secret(value: Column) -> Column:
    return F.when(F.length(value) > 12, F.concat(F.substring(value, 1, 6), F.lit("…"), F.substring(value, -4, 4))) \
        .otherwise(F.concat(F.substring(value, 1, 4), F.lit("…")))


def secret_findings(matches: Column, rules: tuple = SECRET_RULES) -> Column:
    """First occurrence of each *masked* value on the page; the secret itself is not kept."""
    rows = F.transform(matches, lambda m: let(mask_secret(strip(m["raw"])), lambda v: _finding(
        m, rules, v, v, m["context"], "regex")))
    return _in_order(first_per_key(rows))


def phrase_findings(matches: Column, rules: tuple = ABUSE_PHRASES) -> Column:
    """Phrases, once per category and first thirty characters, whatever their case."""
    rows = F.transform(matches, lambda m: _finding(
        m, rules,
        F.concat(_meta(rules, "category", m["rule_order"]), F.lit("\u0001"), F.substring(F.lower(m["raw"]), 1, 30)),
        F.lit(REDACTED), m["context"], "regex"))
    return _in_order(first_per_key(rows))


def signal_findings(matches: Column, rules: tuple = ABUSE_SIGNALS) -> Column:
    """Signals, once per leading fifty characters of context across all categories."""
    rows = F.transform(matches, lambda m: _finding(
        m, rules, F.substring(m["context"], 1, 50), F.lit(REDACTED), m["context"], "keyword"))
    return _in_order(first_per_key(rows))


def zero_tolerance(findings: Column, terms) -> Column:
    """Raise to critical every finding whose category contains one of ``terms``."""
    if not terms:
        return findings
    hot = lambda f: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(f["category"]), t))
    return F.transform(findings, lambda f: f.withField(
        "risk_level", F.when(hot(f), F.lit("critical")).otherwise(f["risk_level"])))


def merge_abuse(*layers: Column) -> Column:
    """Most confident finding per category and leading context; earlier layers win ties."""
    def entry(k):
        return lambda f: F.struct(
            F.struct(f["category"].alias("category"),
                     strip(F.substring(f["context"], 1, 40)).alias("lead")).alias("key"),
            (-f["confidence"]).alias("doubt"), F.lit(k).alias("layer"),
            f["rule_order"].alias("at_rule"), f["start"].alias("at"), f.alias("finding"))

    rows = F.flatten(F.array(*[F.transform(layer, entry(k)) for k, layer in enumerate(layers)]))
    ranked = F.array_sort(F.transform(first_per_key(rows), lambda r: F.struct(
        r["doubt"].alias("doubt"), r["layer"].alias("layer"), r["at_rule"].alias("at_rule"), r["at"].alias("at"),
        r["finding"].alias("finding"))))
    return F.transform(ranked, lambda r: r["finding"])


def no_findings() -> Column:
    return F.array().cast(FINDINGS_TYPE)


def at_least(rules: tuple, confidence: float) -> tuple:
    """Rules worth running at this threshold; the rest are pruned before the plan is built."""
    return tuple(r for r in rules if r.confidence >= confidence)


def detect_pii(pages: DataFrame, rules: tuple = PII_RULES, min_confidence: float = 0.75,
               text: str = "text", into: str = "pii") -> DataFrame:
    chosen = at_least(rules, min_confidence)
    found = locate_matches(pages, {into: (chosen, 60)}, text)
    return found.withColumn(into, pii_findings(F.col(into), chosen) if chosen else no_findings())


def detect_secrets(pages: DataFrame, rules: tuple = SECRET_RULES, min_confidence: float = 0.70,
                   text: str = "text", into: str = "confidential") -> DataFrame:
    chosen = at_least(rules, min_confidence)
    found = locate_matches(pages, {into: (chosen, 60)}, text)
    return found.withColumn(into, secret_findings(F.col(into), chosen) if chosen else no_findings())


def detect_abuse(pages: DataFrame, phrases: tuple = ABUSE_PHRASES, signals: tuple = ABUSE_SIGNALS,
                 terms=("child_safety", "terrorism"), text: str = "text", into: str = "abuse") -> DataFrame:
    found = locate_matches(pages, {"_ph": (phrases, 80), "_si": (signals, 40)}, text)
    layers = [phrase_findings(F.col("_ph"), phrases) if phrases else no_findings(),
              signal_findings(F.col("_si"), signals) if signals else no_findings()]
    return found.withColumn(into, merge_abuse(*[zero_tolerance(x, terms) for x in layers])).drop("_ph", "_si")


def keyword_findings(text: Column, keywords) -> Column:
    """Custom keywords present in the text, each once, whatever their case; the text is lowered once for all of them."""
    words = list(dict.fromkeys(k for k in keywords if k.strip()))
    if not words:
        return F.array().cast("array<string>")
    return let(F.lower(text), lambda t: F.filter(F.array(*[F.lit(k) for k in words]), lambda k: F.contains(t, F.lower(k))))


def custom_keyword_findings(text: Column, keywords) -> Column:
    """Keywords as findings, in the order given, at the first place each stands."""
    words = [k for k in dict.fromkeys(keywords) if k.strip()]

    def finding(k):
        order = F.array_position(F.array(*[F.lit(w) for w in words]), k).cast("int") - 1
        start = F.position(F.lower(k), F.lower(scannable_text(text))) - 1
        return F.struct(
            (F.lit(500) + order).cast("int").alias("rule_order"), start.cast("int").alias("start"), (start + F.length(k)).cast("int").alias("end"),
            F.lit("CUSTOM_KEYWORD").alias("category"), k.alias("value"), F.lit("").alias("context"), F.lit(0.95).alias("confidence"),
            F.lit("high").alias("risk_level"), F.lit("keyword").alias("detection_method"), F.lit("").alias("note"))

    if not words:
        return no_findings()
    return F.transform(keyword_findings(F.coalesce(scannable_text(text), F.lit("")), words), finding).cast(FINDINGS_TYPE)


def explode_findings(pages: DataFrame, checks: dict, keys=("doc_id", "page_num")) -> DataFrame:
    """The long findings table from per-page arrays; ``checks`` maps check type to column.

    The outer form of explode is used because the inner one makes the optimizer
    add a filter on the array's size, which would evaluate the detectors twice.
    """
    def tagged(name):
        return lambda f: F.struct(F.lit(name).alias("check_type"), f.alias("f"))

    rows = F.flatten(F.array(*[F.transform(F.col(c), tagged(name)) for name, c in checks.items()]))
    return (pages.select(*keys, F.explode_outer(rows).alias("r")).where(F.col("r").isNotNull())
            .select(*keys, "r.check_type", "r.f.*"))


def page_risk(findings: Column) -> Column:
    """Highest label on the page; none means low."""
    return risk.label(risk.array_rank(findings))
