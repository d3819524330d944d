"""Building blocks of the independent SQL: the same semantics written for an RE2 SQL engine."""

from __future__ import annotations

from palisade.functions.patterns import SPACE, compile_pattern, compile_rule
from workload.samples import SNIPPETS


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


SNIPPET_LIST = "[" + ", ".join(lit(s) for s in SNIPPETS) + "]"
N = len(SNIPPETS)

ENCODING_COLS = (
    "CASE {k} % 11 WHEN 0 THEN 'ISO-8859-1' WHEN 1 THEN 'unknown' ELSE 'utf-8' END AS detected_encoding, "
    "CASE {k} % 10 WHEN 0 THEN CAST(0.5 AS DOUBLE) WHEN 1 THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.99 AS DOUBLE) END "
    "AS encoding_confidence")
MARK = "[PAGE 1: Image-only page detected. Contains 1 image(s). OCR required for full compliance scan.] "

DOCS = (f"pg AS (SELECT doc_id, 1 AS page_num, text || list_extract({SNIPPET_LIST}, CAST(doc_id % {N} AS INT) + 1) AS text, "
        f"lang, source, {ENCODING_COLS.format(k='doc_id')} FROM documents)")
_CK = "(conv_id * 8 + turn)"
CONVS = (f"pg AS (SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page_num, "
         f"CASE WHEN {_CK} % 29 = 0 THEN {lit(MARK)} ELSE '' END || text || "
         f"list_extract({SNIPPET_LIST}, CAST({_CK} % {N} AS INT) + 1) AS text, role, "
         f"{ENCODING_COLS.format(k=_CK)} FROM conversations)")
STRIPPED = (f"st AS (SELECT * EXCLUDE (text, s), text AS raw_text, CASE WHEN s <> '' AND NOT starts_with(s, '[PAGE') "
            f"THEN s END AS t FROM (SELECT *, {strip('text')} AS s FROM pg))")


def pattern(rule) -> str:
    return lit(compile_rule(rule, "re2"))


# The two phone rules look behind and ahead; with every run of digits fenced by
# two control characters the same matches are found without look-around.
_S = SPACE
PHONE = {
    "PHONE_INDIA": (rf"(?:^|[^\x02])(\+\x0191(?:\x02[{_S}\-]\x01)?[6-9]\p{{Nd}}{{9}}\x02)|(\x01[6-9]\p{{Nd}}{{9}}\x02)"),
    "PHONE_US": (
        rf"(?:^|[^\x02])((?:\+\x011(?:\x02[{_S}\-]?\(?\x01\p{{Nd}}{{3}}\x02|\p{{Nd}}{{3}}\x02)|\(\x01\p{{Nd}}{{3}}\x02)"
        rf"\)?[{_S}\-\.]\x01\p{{Nd}}{{3}}\x02[{_S}\-\.]\x01\p{{Nd}}{{4}}\x02)"
        rf"|((?:\x011(?:\x02[{_S}\-]?\(?\x01\p{{Nd}}{{3}}\x02|\p{{Nd}}{{3}}\x02)|\x01\p{{Nd}}{{3}}\x02)"
        rf"\)?[{_S}\-\.]\x01\p{{Nd}}{{3}}\x02[{_S}\-\.]\x01\p{{Nd}}{{4}}\x02)"),
}


def _phone(rule, k: int, name: str) -> str:
    """CTEs of a rule with look-around: hits in the fenced text, offsets by taking the fences before each hit away."""
    pat, cols = lit(PHONE[rule.category]), "doc_id, page_num, t, f"
    fenced = r"regexp_replace(t, '(\p{Nd}+)', chr(1) || '\1' || chr(2), 'g')"
    plain = "replace(replace({0}, chr(1), ''), chr(2), '')"
    return (
        f"{name}_f{k} AS (SELECT doc_id, page_num, t, {fenced} AS f FROM st), "
        f"{name}_g{k} AS (SELECT {cols}, regexp_extract_all(f, {pat}, 0) AS m, regexp_extract_all(f, {pat}, 1) AS a, "
        f"regexp_extract_all(f, {pat}, 2) AS b, string_split_regex(f, {pat}) AS g FROM {name}_f{k} WHERE regexp_matches(f, {pat})), "
        f"{name}_i{k} AS (SELECT {cols}, unnest(m) AS m, unnest(a) AS a, unnest(b) AS b, unnest(g[1:len(m)]) AS gap, "
        f"generate_subscripts(m, 1) AS i FROM {name}_g{k}), "
        f"{name}_j{k} AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, page_num ORDER BY i) AS BIGINT) AS fstop "
        f"FROM {name}_i{k}), "
        f"{name}_p{k} AS (SELECT doc_id, page_num, t, {k} AS rule_order, {plain.format("CASE WHEN a <> '' THEN a ELSE b END")} AS raw, "
        f"CAST(length({plain.format('f[1:fstop]')}) AS INT) AS stop FROM {name}_j{k})")


def located(rules, width: int, name: str = "m") -> str:
    """CTEs giving every match with offsets and context."""
    around = [(k, r) for k, r in enumerate(rules) if r.category in PHONE]
    parts = [
        f"SELECT doc_id, page_num, t, {k} AS rule_order, regexp_extract_all(t, {pattern(r)}) AS v, "
        f"string_split_regex(t, {pattern(r)}) AS g FROM st WHERE regexp_matches(t, {pattern(r)})"
        for k, r in enumerate(rules) if r.category not in PHONE]
    parts = parts or ["SELECT doc_id, page_num, t, -1 AS rule_order, ['x'] AS v, ['x'] AS g FROM st WHERE false"]
    meta = ", ".join(
        f"CASE rule_order {' '.join(f'WHEN {k} THEN {f(r)}' for k, r in enumerate(rules))} END AS {n}"
        for n, f in (("category", lambda r: lit(r.category)), ("risk_level", lambda r: lit(r.risk)),
                     ("confidence", lambda r: f"CAST({r.confidence} AS DOUBLE)")))
    ctx = (f"regexp_replace(replace(substring(t, lo + 1, hi - lo), chr(10), ' '), '^[{SPACE}]+|[{SPACE}]+$', '', 'g')")
    return (
        "".join(f"{_phone(r, k, name)}, " for k, r in around)
        + f"{name}_h AS ({' UNION ALL '.join(parts)}), "
        f"{name}_u AS (SELECT doc_id, page_num, t, rule_order, unnest(v) AS raw, unnest(g[1:len(v)]) AS gap, "
        f"generate_subscripts(v, 1) AS i FROM {name}_h), "
        f"{name}_e AS (SELECT doc_id, page_num, t, rule_order, raw, CAST(sum(length(gap) + length(raw)) OVER (PARTITION BY doc_id, "
        f"page_num, rule_order ORDER BY i) AS INT) AS stop FROM {name}_u"
        + "".join(f" UNION ALL SELECT * FROM {name}_p{k}" for k, _ in around) + "), "
        f"{name}_w AS (SELECT *, CAST(stop - length(raw) AS INT) AS start, greatest(stop - length(raw) - {width}, 0) AS lo, "
        f"least(stop + {width}, length(t)) AS hi FROM {name}_e), "
        f"{name} AS (SELECT doc_id, page_num, rule_order, start, stop, raw, {strip('raw')} AS val, {meta}, "
        f"CASE WHEN lo > 0 THEN '…' ELSE '' END || {ctx} || CASE WHEN hi < length(t) THEN '…' ELSE '' END AS context "
        f"FROM {name}_w)")


def first(name: str, source: str, key: str, order: str = "rule_order, start") -> str:
    return (f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num, {key} "
            f"ORDER BY {order}) AS rn FROM {source}) WHERE rn = 1)")


RANK = "CASE {0} WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"
LABEL = "CASE {0} WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"
COUNT_RANK = "CASE WHEN {0} >= 10 THEN 3 WHEN {0} >= 5 THEN 2 WHEN {0} >= 2 THEN 1 ELSE 0 END"


def rank(e: str) -> str:
    return RANK.format(e)


def label(e: str) -> str:
    return LABEL.format(e)


def re2(p: str, **kw) -> str:
    return lit(compile_pattern(p, engine="re2", **kw))
