"""Registered queries over pages of text (detectors, guard, abuse, scoring, reports)."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade import rules as R
from palisade.functions import risk
from palisade.functions.masking import mask_value
from palisade.operators import detect as D, keywords as K
from palisade.operators.language import LanguageModel
from palisade.operators.masked import mask_pages
from palisade.operators.encoding import detect_encoding, sample_chars, unexpected_chars
from palisade.operators.reports import (
    confidence_label, findings_table, heatmap, redaction_table, report_rows, summary_rows)
from palisade.operators.scoring import CHECKS, corpus_rollup, document_summary
from palisade.plans.scan import scan_pages
from workload import sql as S
from workload.inputs import conversation_pages, document_pages, pick, table

QUERIES, ORACLES = {}, {}


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


COLS = ("doc_id", "page_num", "category", "value", "context", "confidence", "risk_level", "rule_order", "start")
SQL_COLS = "doc_id, page_num, category, {v} AS value, context, confidence, risk_level, rule_order, start"


def _long(df, col):
    return D.explode_findings(df, {"x": col})


# One query per personal-data and secret rule ---------------------------------
_NAMES = {
    "EMAIL": "pii_email", "PHONE_INDIA": "pii_phone_india", "PHONE_US": "pii_phone_us", "SSN": "pii_ssn",
    "AADHAAR": "pii_aadhaar", "PAN_CARD": "pii_pan_card", "PASSPORT": "pii_passport",
    "CREDIT_CARD": "pii_credit_card", "BANK_ACCOUNT": "pii_bank_account", "IBAN": "pii_iban",
    "IP_ADDRESS": "pii_ip_address", "DATE_OF_BIRTH": "pii_date_of_birth",
    "API_KEY_OPENAI": "sec_openai", "API_KEY_ANTHROPIC": "sec_anthropic", "API_KEY_GROQ": "sec_groq",
    "AWS_ACCESS_KEY": "sec_aws_access", "AWS_SECRET_KEY": "sec_aws_secret", "GITHUB_TOKEN": "sec_github",
    "GOOGLE_API_KEY": "sec_google", "STRIPE_KEY": "sec_stripe", "JWT_TOKEN": "sec_jwt",
    "PASSWORD_INLINE": "sec_password", "SECRET_INLINE": "sec_secret", "DB_CONNECTION_STRING": "sec_db_uri",
    "PRIVATE_KEY_BLOCK": "sec_private_key", "SALARY_DATA": "sec_salary",
}
MASKED = "CASE WHEN length(val) > 12 THEN val[:6] || '…' || right(val, 4) ELSE val[:4] || '…' END"


def pii_sql(rules, source=S.DOCS, tail=None):
    return (f"WITH {source}, {S.STRIPPED}, {S.located(rules, 60)}, {S.first('f', 'm', 'val')} "
            + (tail or f"SELECT {SQL_COLS.format(v='val[:80]')} FROM f"))


def secret_sql(rules, source=S.DOCS, tail=None):
    return (f"WITH {source}, {S.STRIPPED}, {S.located(rules, 60)}, k AS (SELECT *, {MASKED} AS masked FROM m), "
            f"{S.first('f', 'k', 'masked')} " + (tail or f"SELECT {SQL_COLS.format(v='masked')} FROM f"))


for _rule in R.PII_RULES:
    def _q(spark, sf, rule=_rule):
        return _long(D.detect_pii(document_pages(spark, sf), (rule,), 0.0), "pii").select(*COLS)
    register(_NAMES[_rule.category], _q, pii_sql((_rule,)))

for _rule in R.SECRET_RULES:
    def _q(spark, sf, rule=_rule):
        return _long(D.detect_secrets(document_pages(spark, sf), (rule,), 0.0), "confidential").select(*COLS)
    register(_NAMES[_rule.category], _q, secret_sql((_rule,)))


# Secrets helpers, keywords ----------------------------------------------------
register("sec_mask",
         lambda spark, sf: _long(D.detect_secrets(document_pages(spark, sf)), "confidential")
         .groupBy("value", "category").agg(F.count(F.lit(1)).alias("n")),
         secret_sql(R.SECRET_RULES, tail="SELECT masked AS value, category, count(*) AS n FROM f GROUP BY ALL"))

KEYWORDS = R.DEFAULT_RULES["confidentiality"]["custom_keywords"]
register("kw_custom",
         lambda spark, sf: document_pages(spark, sf).select(
             "doc_id", F.explode(D.keyword_findings(F.col("text"), KEYWORDS)).alias("keyword"),
             F.lit("CUSTOM_KEYWORD").alias("category")),
         f"WITH {S.DOCS}, k AS (SELECT unnest([{', '.join(map(S.lit, KEYWORDS))}]) AS keyword) "
         "SELECT doc_id, keyword, 'CUSTOM_KEYWORD' AS category FROM pg JOIN k ON contains(lower(text), lower(keyword))")



def _keyword_table(spark, sf):
    """Every customer's market segment, every nation and the default keywords, as a table of keywords."""
    words = spark.createDataFrame([(k,) for k in KEYWORDS], "keyword string").unionByName(
        table(spark, sf, "nation").select(F.lower("n_name").alias("keyword"))).unionByName(
        table(spark, sf, "customer").select(F.substring(F.lower("c_mktsegment"), 1, 4).alias("keyword")))
    return K.find_keywords(document_pages(spark, sf), words)


register("kw_table", lambda spark, sf: _keyword_table(spark, sf).select("doc_id", "keyword"),
         f"WITH {S.DOCS}, k AS (SELECT unnest([{', '.join(map(S.lit, KEYWORDS))}]) AS keyword UNION SELECT lower(n_name) FROM nation UNION "
         "SELECT lower(c_mktsegment)[:4] FROM customer) SELECT doc_id, keyword FROM pg JOIN k ON contains(lower(text), lower(keyword))")


def _many_keywords(spark, sf):
    """Every sixteenth stretch of sixteen characters of the documents: some hundred thousand keywords."""
    docs = table(spark, sf, "documents")
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit("(?s).{16}"), F.lit(0))).alias("keyword"))
    return K.find_keywords(document_pages(spark, sf), words.where("length(lower(keyword)) = 16"))


register("kw_many", lambda spark, sf: _many_keywords(spark, sf).select("doc_id", "keyword", "start", "n"),
         f"WITH {S.DOCS}, k AS (SELECT DISTINCT text[i:i + 15] AS keyword FROM (SELECT text, unnest(range(1, length(text) + 1, 16)) AS i FROM documents)), "
         f"w AS (SELECT keyword, lower(keyword) AS low FROM k WHERE length(keyword) = 16 AND length(lower(keyword)) = 16 AND {S.strip('keyword')} <> ''), "
         "lo AS (SELECT doc_id, lower(text) AS t FROM pg), g AS (SELECT doc_id, t[i:i + 15] AS low, i FROM (SELECT doc_id, t, unnest(range(1, length(t) - 14)) AS i FROM lo)) "
         "SELECT doc_id, keyword, CAST(min(i) - 1 AS INT) AS start, count(*) AS n FROM g JOIN w USING (low) GROUP BY doc_id, keyword")


def _keyword_scan(spark, sf):
    rules = R.default_rules()
    rules["confidentiality"]["match_keywords"] = True
    found = findings_table(scan_pages(document_pages(spark, sf), rules)).where("check_type = 'confidential'")
    return found.select("doc_id", "page_num", "category", "value", "start")


register("kw_scan", _keyword_scan, secret_sql(
    R.SECRET_RULES, tail="SELECT doc_id, page_num, category, masked AS value, start FROM f UNION ALL SELECT doc_id, page_num, 'CUSTOM_KEYWORD', keyword, "
    f"CAST(instr(lower(t), lower(keyword)) - 1 AS INT) FROM st JOIN (SELECT unnest([{', '.join(map(S.lit, KEYWORDS))}]) AS keyword) ON contains(lower(t), lower(keyword))"))

# Encoding guard ---------------------------------------------------------------
ENC = R.DEFAULT_RULES["encoding"]


def _enc(spark, sf, category):
    rows = _long(detect_encoding(document_pages(spark, sf), ENC), "encoding")
    return rows.where(F.col("category") == category).select(
        "doc_id", "page_num", "category", "risk_level", "confidence", "note")


ODD = f"regexp_replace(text, '[\\x00-\\x7F{R.ALLOWED_NON_ASCII}]', '', 'g')"
IMG = f"(starts_with({S.strip('text')}, '[PAGE') AND contains(text, 'Image-only'))"
SCRIPT_LIST = "list_filter([" + ", ".join(
    f"CASE WHEN length(regexp_replace(odd, '[^\\x{{{lo:X}}}-\\x{{{hi:X}}}]', '', 'g')) >= 3 THEN {S.lit(n)} END"
    for n, lo, hi in R.SCRIPTS) + "], lambda x: x IS NOT NULL)"
OCR_LIST = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(text, {S.re2(p)}) THEN {S.lit(n)} END" for n, p, _ in R.OCR_RULES) \
    + "], lambda x: x IS NOT NULL)"
_WORDS = sorted({w for ws in R.STOP_WORDS.values() for w in ws})
_LANGS = ", ".join(
    f"{{'n': len(list_filter(words, lambda w: list_contains([{', '.join(map(S.lit, ws))}], w))), 'o': {-i}, 'c': {S.lit(c)}}}"
    for i, (c, ws) in enumerate(R.STOP_WORDS.items()))
LANG_CTE = (
    f"lw AS (SELECT *, list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda w: list_contains("
    f"[{', '.join(map(S.lit, _WORDS))}], w)) AS words FROM pg), "
    f"lg AS (SELECT *, list_max([{_LANGS}]) AS best FROM lw), "
    f"ln AS (SELECT * EXCLUDE (words, best), CASE WHEN best.n > 0 THEN best.c END AS detected FROM lg)")
ENC_CTE = (
    f"{LANG_CTE}, e0 AS (SELECT *, {ODD} AS odd, {IMG} AS img FROM ln), "
    f"e1 AS (SELECT *, {SCRIPT_LIST} AS scripts, {OCR_LIST} AS ocr, length(odd) AS odd_n, "
    f"length(regexp_replace({S.strip('text')}, '[{S.SPACE}]+', ' ', 'g')) AS folded FROM e0), "
    "enc AS ("
    "SELECT doc_id, page_num, 'IMAGE_ONLY_PAGE' AS category, 'info' AS risk_level, CAST(1.0 AS DOUBLE) AS confidence, "
    "'No extractable text — OCR required for compliance scan' AS note FROM e1 WHERE img UNION ALL "
    "SELECT doc_id, page_num, 'NON_ASCII_CHARS', CASE WHEN odd_n > 50 THEN 'high' ELSE 'medium' END, 0.97, "
    "odd_n || ' unexpected non-ASCII characters found' FROM e1 WHERE NOT img AND odd_n > 5 UNION ALL "
    "SELECT doc_id, page_num, 'MULTILINGUAL_CONTENT', 'medium', 0.93, 'Non-Latin scripts detected: ' || "
    "array_to_string(scripts, ', ') FROM e1 WHERE NOT img AND len(scripts) > 0 UNION ALL "
    "SELECT doc_id, page_num, 'OCR_CORRUPTION', CASE WHEN len(ocr) >= 2 THEN 'high' ELSE 'medium' END, 0.85, "
    "'OCR corruption patterns: ' || array_to_string(ocr[1:3], ', ') FROM e1 WHERE NOT img AND len(ocr) > 0 UNION ALL "
    "SELECT doc_id, page_num, 'LOW_ENCODING_CONFIDENCE', CASE WHEN encoding_confidence < 0.6 THEN 'high' ELSE 'medium' END, "
    "0.90, 'chardet detected ''' || detected_encoding || ''' with ' || CAST(encoding_confidence * 100 AS INT) || "
    "'% confidence' FROM e1 WHERE NOT img AND encoding_confidence < 0.85 UNION ALL "
    "SELECT doc_id, page_num, 'NON_UTF8_ENCODING', 'high', 0.88, 'Expected UTF-8, detected ''' || detected_encoding || '''' "
    "FROM e1 WHERE NOT img AND lower(detected_encoding) NOT IN ('utf-8', 'ascii', 'utf-8-sig', 'utf_8') UNION ALL "
    "SELECT doc_id, page_num, 'NON_ALLOWED_LANGUAGE', 'medium', 0.80, 'Language ''' || detected || ''' detected; allowed: "
    "[''en'']' FROM e1 WHERE NOT img AND folded > 80 AND detected <> 'en')")

for _name, _cat in (("enc_non_ascii", "NON_ASCII_CHARS"), ("enc_scripts", "MULTILINGUAL_CONTENT"),
                    ("enc_ocr", "OCR_CORRUPTION"), ("enc_low_confidence", "LOW_ENCODING_CONFIDENCE"),
                    ("enc_non_utf8", "NON_UTF8_ENCODING"), ("enc_language", "NON_ALLOWED_LANGUAGE")):
    register(_name, lambda spark, sf, cat=_cat: _enc(spark, sf, cat),
             f"WITH {S.DOCS}, {ENC_CTE} SELECT * FROM enc WHERE category = {S.lit(_cat)}")



def _language(spark, sf):
    """Profiles of the even documents; the language of every document."""
    docs = table(spark, sf, "documents")
    return LanguageModel(docs.where("doc_id % 2 = 0")).detected(docs.select("doc_id", "lang", "text")).select("doc_id", "lang", "language")


# A model has no SQL; its accuracy on texts it has not seen is tested.
register("enc_language_model", _language)
register("enc_image_only",
         lambda spark, sf: _long(detect_encoding(conversation_pages(spark, sf), ENC), "encoding")
         .where(F.col("category") == "IMAGE_ONLY_PAGE").select("doc_id", "page_num", "category", "risk_level", "note"),
         f"WITH {S.CONVS} SELECT doc_id, page_num, 'IMAGE_ONLY_PAGE' AS category, 'info' AS risk_level, "
         f"'No extractable text — OCR required for compliance scan' AS note FROM pg WHERE {IMG}")
register("enc_non_ascii_sample",
         lambda spark, sf: document_pages(spark, sf).select(
             "doc_id", F.array_join(sample_chars(unexpected_chars(F.col("text"))), "").alias("sample")),
         f"WITH {S.DOCS}, o AS (SELECT doc_id, {ODD} AS odd FROM pg), "
         "u AS (SELECT doc_id, unnest(string_split(odd, '')) AS c, generate_subscripts(string_split(odd, ''), 1) AS i "
         "FROM o WHERE odd <> ''), f AS (SELECT doc_id, c, min(i) AS i FROM u GROUP BY ALL), "
         "r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM f), "
         "a AS (SELECT doc_id, string_agg(c, '' ORDER BY i) AS s FROM r WHERE rn <= 8 GROUP BY doc_id) "
         "SELECT o.doc_id, coalesce(s, '') AS sample FROM o LEFT JOIN a USING (doc_id)")
register("enc_page_risk",
         lambda spark, sf: detect_encoding(conversation_pages(spark, sf), ENC).select(
             "doc_id", "page_num", risk.label(F.least(risk.array_rank(F.col("encoding")), F.lit(2))).alias("encoding_risk")),
         f"WITH {S.CONVS}, {ENC_CTE}, r AS (SELECT doc_id, page_num, max({S.rank('risk_level')}) AS k FROM enc GROUP BY ALL) "
         f"SELECT pg.doc_id, pg.page_num, {S.label('least(coalesce(k, 0), 2)')} AS encoding_risk FROM pg "
         "LEFT JOIN r ON pg.doc_id = r.doc_id AND pg.page_num = r.page_num")

# Abuse ------------------------------------------------------------------------
PH = (f"{S.located(R.ABUSE_PHRASES, 80, 'ph')}, "
      f"{S.first('p1', 'ph', 'category, lower(raw)[:30]')}")
SI = f"{S.located(R.ABUSE_SIGNALS, 40, 'si')}, {S.first('s1', 'si', 'context[:50]')}"
ABUSE_CTE = (
    f"{PH}, {SI}, ab AS (SELECT *, 0 AS layer, 'regex' AS detection_method FROM p1 UNION ALL "
    f"SELECT *, 1, 'keyword' FROM s1), "
    + S.first("abz", "(SELECT * EXCLUDE rn FROM ab)", f"category, {S.strip('context[:40]')}",
              "confidence DESC, layer, rule_order, start"))
ABUSE_COLS = "doc_id, page_num, category, '[REDACTED]' AS value, context, confidence, risk_level, rule_order, start"


def _abuse(spark, sf, part):
    pages = document_pages(spark, sf)
    if part == "phrase":
        m = D.locate_matches(pages, {"x": (R.ABUSE_PHRASES, 80)})
        return _long(m.withColumn("x", D.phrase_findings(F.col("x"))), "x").select(*COLS)
    if part == "signal":
        m = D.locate_matches(pages, {"x": (R.ABUSE_SIGNALS, 40)})
        return _long(m.withColumn("x", D.signal_findings(F.col("x"))), "x").select(*COLS)
    return _long(D.detect_abuse(pages), "abuse").select(*COLS, "detection_method")


register("abuse_phrase", lambda spark, sf: _abuse(spark, sf, "phrase"),
         f"WITH {S.DOCS}, {S.STRIPPED}, {PH} SELECT {ABUSE_COLS} FROM p1")
register("abuse_keyword", lambda spark, sf: _abuse(spark, sf, "signal"),
         f"WITH {S.DOCS}, {S.STRIPPED}, {SI} SELECT {ABUSE_COLS} FROM s1")
register("abuse_dedupe", lambda spark, sf: _abuse(spark, sf, "all"),
         f"WITH {S.DOCS}, {S.STRIPPED}, {ABUSE_CTE} SELECT {ABUSE_COLS}, detection_method FROM abz")
ZERO = ("harass", "slur")
register("abuse_zero_tolerance",
         lambda spark, sf: _long(D.detect_abuse(document_pages(spark, sf), terms=ZERO), "abuse")
         .groupBy("category", "risk_level").agg(F.count(F.lit(1)).alias("n")),
         f"WITH {S.DOCS}, {S.STRIPPED}, {ABUSE_CTE} SELECT category, CASE WHEN lower(category) LIKE '%harass%' OR "
         "lower(category) LIKE '%slur%' THEN 'critical' ELSE risk_level END AS risk_level, count(*) AS n FROM abz GROUP BY ALL")
register("abuse_page_risk",
         lambda spark, sf: D.detect_abuse(conversation_pages(spark, sf)).select(
             "doc_id", "page_num", D.page_risk(F.col("abuse")).alias("abuse_risk")),
         f"WITH {S.CONVS}, {S.STRIPPED}, {ABUSE_CTE}, r AS (SELECT doc_id, page_num, max({S.rank('risk_level')}) AS k "
         f"FROM abz GROUP BY ALL) SELECT pg.doc_id, pg.page_num, {S.label('coalesce(k, 0)')} AS abuse_risk FROM pg "
         "LEFT JOIN r ON pg.doc_id = r.doc_id AND pg.page_num = r.page_num")

# Shared finding operators -------------------------------------------------------
register("f_skip_blank",
         lambda spark, sf: conversation_pages(spark, sf).select(
             "doc_id", "page_num", D.scannable_text(F.col("text")).isNotNull().alias("scanned"),
             F.length(D.scannable_text(F.col("text"))).alias("n")),
         f"WITH {S.CONVS}, {S.STRIPPED} SELECT doc_id, page_num, t IS NOT NULL AS scanned, CAST(length(t) AS INT) AS n FROM st")


def _located(spark, sf):
    m = D.locate_matches(conversation_pages(spark, sf), {"x": (R.PII_RULES, 60)})
    return m.select("doc_id", "page_num", F.explode("x").alias("m")).select("doc_id", "page_num", "m.*")


register("f_positions",
         lambda spark, sf: _located(spark, sf).select("doc_id", "page_num", "rule_order", "start", F.col("end").alias("stop"), "raw"),
         f"WITH {S.CONVS}, {S.STRIPPED}, {S.located(R.PII_RULES, 60)} SELECT doc_id, page_num, rule_order, start, stop, raw FROM m")
register("f_context",
         lambda spark, sf: _located(spark, sf).select("doc_id", "page_num", "rule_order", "start", "context"),
         f"WITH {S.CONVS}, {S.STRIPPED}, {S.located(R.PII_RULES, 60)} SELECT doc_id, page_num, rule_order, start, context FROM m")
register("f_min_confidence",
         lambda spark, sf: _long(D.detect_pii(document_pages(spark, sf), R.PII_RULES, 0.95), "pii")
         .groupBy("category", "confidence").agg(F.count(F.lit(1)).alias("n")),
         pii_sql([r for r in R.PII_RULES if r.confidence >= 0.95],
                 tail="SELECT category, confidence, count(*) AS n FROM f GROUP BY ALL"))
register("f_dedupe_value",
         lambda spark, sf: _long(D.detect_pii(document_pages(spark, sf), R.PII_RULES, 0.0), "pii").select(*COLS),
         pii_sql(R.PII_RULES))

PII_RANKED = f"{S.located(R.PII_RULES, 60)}, {S.first('pf', 'm', 'val')}"
SEC_RANKED = (f"{S.located(R.SECRET_RULES, 60, 'sm')}, sk AS (SELECT *, {MASKED} AS masked FROM sm), "
              + S.first("sf", "sk", "masked"))
register("f_page_risk",
         lambda spark, sf: D.detect_pii(conversation_pages(spark, sf)).select(
             "doc_id", "page_num", D.page_risk(F.col("pii")).alias("pii_risk"), F.size("pii").alias("n")),
         f"WITH {S.CONVS}, {S.STRIPPED}, {PII_RANKED}, r AS (SELECT doc_id, page_num, max({S.rank('risk_level')}) AS k, "
         f"count(*) AS n FROM pf GROUP BY ALL) SELECT pg.doc_id, pg.page_num, {S.label('coalesce(k, 0)')} AS pii_risk, "
         "CAST(coalesce(n, 0) AS INT) AS n FROM pg LEFT JOIN r ON pg.doc_id = r.doc_id AND pg.page_num = r.page_num")


def _off(spark, sf):
    rules = R.default_rules()
    for section in ("pii", "abuse", "encoding"):
        rules[section]["enabled"] = False
    return findings_table(scan_pages(document_pages(spark, sf), rules)).groupBy("check_type").agg(
        F.count(F.lit(1)).alias("n"))


register("f_disabled", _off, secret_sql(R.SECRET_RULES, tail="SELECT 'confidential' AS check_type, count(*) AS n FROM f"))

# Aggregation -------------------------------------------------------------------
ALL_CTE = (
    f"{S.STRIPPED}, {PII_RANKED}, {SEC_RANKED}, {ABUSE_CTE}, {ENC_CTE}, "
    "af AS (SELECT doc_id, page_num, 'pii' AS check_type, category, risk_level FROM pf UNION ALL "
    "SELECT doc_id, page_num, 'confidential', category, risk_level FROM sf UNION ALL "
    "SELECT doc_id, page_num, 'encoding', category, CASE WHEN risk_level = 'critical' THEN 'high' ELSE risk_level END FROM enc "
    "UNION ALL SELECT doc_id, page_num, 'abuse', category, risk_level FROM abz), "
    "pa AS (SELECT doc_id, page_num, "
    + ", ".join(f"count(*) FILTER (check_type = '{c}') AS {c}, coalesce(max({S.rank('risk_level')}) FILTER "
                f"(check_type = '{c}'), 0) AS {c}_k" for c in CHECKS)
    + ", count(*) AS total FROM af GROUP BY ALL), "
    "pr AS (SELECT pg.*, " + ", ".join(f"coalesce({c}, 0) AS {c}, coalesce({c}_k, 0) AS {c}_k" for c in CHECKS)
    + ", coalesce(total, 0) AS total FROM pg LEFT JOIN pa ON pg.doc_id = pa.doc_id AND pg.page_num = pa.page_num), "
    "ps AS (SELECT *, greatest(" + ", ".join(f"{c}_k" for c in CHECKS) + f", {S.COUNT_RANK.format('total')}) AS k FROM pr)")
CONV_ALL = f"WITH {S.CONVS}, {ALL_CTE} "
DOC_ALL = f"WITH {S.DOCS}, {ALL_CTE} "
DOC_SUM = (
    "SELECT doc_id, count(*) AS total_pages, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}_issues" for c in CHECKS)
    + ", CAST(sum(total) AS BIGINT) AS total_flags, "
    + ", ".join(f"count(*) FILTER (k = {i}) AS {n}_pages" for i, n in enumerate(R.RISK_LEVELS))
    + ", count(*) FILTER (total > 0) AS pages_with_issues, count(*) FILTER (total = 0) AS clean_pages, "
    + S.label("greatest(max(k), " + S.COUNT_RANK.format("sum(total)") + ")") + " AS highest_risk FROM ps GROUP BY doc_id")


def _results(spark, sf):
    return scan_pages(conversation_pages(spark, sf))


def _summary(spark, sf):
    return document_summary(_results(spark, sf))


register("agg_page_join",
         lambda spark, sf: _results(spark, sf).select(
             "doc_id", "page_num", *[F.size(f"{c}_flags").alias(c) for c in CHECKS], *[f"{c}_risk" for c in CHECKS]),
         CONV_ALL + "SELECT doc_id, page_num, " + ", ".join(
             f"CAST({c} AS INT) AS {c}, {S.label(c + '_k')} AS {c}_risk" for c in CHECKS) + " FROM ps")
register("agg_page_risk",
         lambda spark, sf: _results(spark, sf).select("doc_id", "page_num", "total_flags", "overall_risk"),
         CONV_ALL + f"SELECT doc_id, page_num, CAST(total AS INT) AS total_flags, {S.label('k')} AS overall_risk FROM ps")
register("agg_doc_issues",
         lambda spark, sf: _summary(spark, sf).select("doc_id", *[f"{c}_issues" for c in CHECKS], "total_flags"),
         CONV_ALL + f"SELECT doc_id, {', '.join(c + '_issues' for c in CHECKS)}, total_flags FROM ({DOC_SUM})")
register("agg_risk_counts",
         lambda spark, sf: _summary(spark, sf).select("doc_id", *[f"{n}_pages" for n in R.RISK_LEVELS]),
         CONV_ALL + f"SELECT doc_id, {', '.join(n + '_pages' for n in R.RISK_LEVELS)} FROM ({DOC_SUM})")
register("agg_doc_risk", lambda spark, sf: _summary(spark, sf).select("doc_id", "total_flags", "highest_risk"),
         CONV_ALL + f"SELECT doc_id, total_flags, highest_risk FROM ({DOC_SUM})")
register("agg_clean_pages",
         lambda spark, sf: _summary(spark, sf).select("doc_id", "total_pages", "pages_with_issues", "clean_pages"),
         CONV_ALL + f"SELECT doc_id, total_pages, pages_with_issues, clean_pages FROM ({DOC_SUM})")
register("agg_preview",
         lambda spark, sf: _results(spark, sf).select("doc_id", "page_num", "text_preview", "char_count"),
         f"WITH {S.CONVS} SELECT doc_id, page_num, text[:200] AS text_preview, CAST(length(text) AS INT) AS char_count FROM pg")
register("agg_count_risk",
         lambda spark, sf: table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("value") >= 100).alias("flags"))
         .withColumn("count_risk", risk.label(risk.count_rank(F.col("flags")))),
         f"SELECT user_id, flags, {S.label(S.COUNT_RANK.format('flags'))} AS count_risk FROM "
         "(SELECT user_id, count(*) FILTER (value >= 100) AS flags FROM events GROUP BY user_id)")
register("agg_normalize_risk",
         lambda spark, sf: table(spark, sf, "orders").select(
             "o_orderkey", risk.normalize(F.lower(F.regexp_extract("o_orderpriority", "[A-Z]+", 0))).alias("risk")),
         "SELECT o_orderkey, CASE WHEN p IN ('low', 'medium', 'high', 'critical') THEN p ELSE 'low' END AS risk FROM "
         "(SELECT o_orderkey, lower(regexp_extract(o_orderpriority, '[A-Z]+', 0)) AS p FROM orders)")


def _corpus(spark, sf):
    results = scan_pages(document_pages(spark, sf))
    return corpus_rollup(document_summary(results, "doc_id", "source", "lang"), "source", "lang")


register("agg_corpus", _corpus,
         DOC_ALL + "SELECT source, lang, count(*) AS documents, CAST(sum(total) AS BIGINT) AS total_flags, "
         + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}_issues" for c in CHECKS)
         + f", {S.label('max(k)')} AS highest_risk FROM ps GROUP BY ROLLUP (source, lang)")

# Reports -----------------------------------------------------------------------
register("r_summary_rows", lambda spark, sf: summary_rows(_summary(spark, sf)),
         CONV_ALL + f"SELECT doc_id, unnest(['Total Pages Scanned', 'Total Compliance Flags', 'Pages with Issues', "
         f"'Clean Pages', 'Highest Risk Level', 'PII Violations', 'Confidentiality Issues', 'Encoding Issues', "
         f"'Abuse / Unlawful']) AS metric, unnest([CAST(total_pages AS VARCHAR), CAST(total_flags AS VARCHAR), "
         f"CAST(pages_with_issues AS VARCHAR), CAST(clean_pages AS VARCHAR), upper(highest_risk), "
         f"CAST(pii_issues AS VARCHAR), CAST(confidential_issues AS VARCHAR), CAST(encoding_issues AS VARCHAR), "
         f"CAST(abuse_issues AS VARCHAR)]) AS value FROM ({DOC_SUM})")
register("r_heatmap", lambda spark, sf: heatmap(_results(spark, sf)),
         CONV_ALL + "SELECT doc_id, page_num, " + ", ".join(f"CAST({c} AS INT) AS {c}" for c in CHECKS)
         + f", CAST(total AS INT) AS total, upper({S.label('k')}) AS risk FROM ps")

# Findings with values and contexts.
FIND_CTE = (
    f"{S.STRIPPED}, {PII_RANKED}, {SEC_RANKED}, {ABUSE_CTE}, {ENC_CTE}, "
    "fi AS (SELECT doc_id, page_num, 'PII' AS type, category, val[:80] AS value, context, confidence, risk_level, "
    "'regex' AS method, rule_order, start FROM pf UNION ALL "
    "SELECT doc_id, page_num, 'CONFIDENTIAL', category, masked, context, confidence, risk_level, 'regex', rule_order, start FROM sf "
    "UNION ALL SELECT doc_id, page_num, 'ENCODING', category, '', note, confidence, risk_level, 'ai', "
    "list_position(['NON_ASCII_CHARS', 'MULTILINGUAL_CONTENT', 'OCR_CORRUPTION', 'LOW_ENCODING_CONFIDENCE', "
    "'NON_UTF8_ENCODING', 'NON_ALLOWED_LANGUAGE'], category) - 1, 0 FROM enc UNION ALL "
    "SELECT doc_id, page_num, 'ABUSE', category, '[REDACTED]', context, confidence, risk_level, detection_method, rule_order, "
    "start FROM abz)")


def _find(spark, sf):
    return findings_table(scan_pages(document_pages(spark, sf)))


def _mask_sql():
    d = r"regexp_replace({0}, '[^\p{{Nd}}]', '', 'g')"
    digits, bare = d.format("value"), "replace(replace(value, ' ', ''), '-', '')"

    def partial(k, fill):
        return (f"CASE WHEN length({digits}) <= {k} THEN repeat('{fill}', length({digits})) ELSE "
                f"repeat('{fill}', length({digits}) - {k}) || right({digits}, {k}) END")
    return (
        "CASE WHEN value = '' OR value IN ('[REDACTED]', '[REDACTED — abuse content]') THEN '[REDACTED]' ELSE CASE category "
        "WHEN 'EMAIL' THEN value[:1] || '***@' || split_part(value, '@', 2)[:1] || '***.' || "
        "substring(split_part(value, '@', 2), length(split_part(split_part(value, '@', 2), '.', 1)) + 2) "
        f"WHEN 'PHONE_INDIA' THEN {partial(2, '*')} WHEN 'PHONE_US' THEN {partial(4, '*')} "
        f"WHEN 'SSN' THEN '***-**-' || right({bare}, 4) WHEN 'AADHAAR' THEN 'XXXX XXXX ' || right({bare}, 4) "
        "WHEN 'PAN_CARD' THEN value[:1] || 'XXXX' || value[6:] WHEN 'PASSPORT' THEN value[:1] || 'XXXXXX' "
        f"WHEN 'CREDIT_CARD' THEN 'XXXX-XXXX-XXXX-' || right({digits}, 4) WHEN 'BANK_ACCOUNT' THEN {partial(4, 'X')} "
        "WHEN 'IP_ADDRESS' THEN split_part(value, '.', 1) || '.' || split_part(value, '.', 2) || '.XXX.XXX' "
        "WHEN 'DATE_OF_BIRTH' THEN 'XX/XX/' || list_last(string_split(replace(value, '-', '/'), '/')) "
        "WHEN 'IBAN' THEN value[:4] || repeat('X', length(value) - 8) || right(value, 4) "
        "ELSE CASE WHEN length(value) > 6 THEN value[:3] || repeat('*', length(value) - 5) || right(value, 2) "
        "ELSE repeat('*', length(value)) END END END")


PCT = "CAST(CAST(round_even(confidence * 100, 0) AS INT) AS VARCHAR) || '%'"
register("r_findings", lambda spark, sf: report_rows(_find(spark, sf)),
         f"WITH {S.DOCS}, {FIND_CTE}, c AS (SELECT *, {S.strip('replace(context, chr(10), chr(32))')} AS cx FROM fi) "
         "SELECT doc_id, page_num, type, category, CAST(rule_order AS INT) AS rule_order, CAST(start AS INT) AS start, "
         "CASE WHEN value = '' THEN '[redacted]' ELSE value[:50] END AS matched, upper(risk_level) AS severity, "
         f"CASE WHEN method IN ('regex', 'keyword') THEN 'Regex' ELSE 'AI' END AS method, {PCT} AS confidence, "
         "CASE WHEN length(cx) > 70 THEN cx[:70] || '…' ELSE cx END AS context FROM c")
register("r_redaction_table", lambda spark, sf: redaction_table(_find(spark, sf)),
         f"WITH {S.DOCS}, {FIND_CTE} SELECT doc_id, page_num, type, category, CAST(rule_order AS INT) AS rule_order, "
         "CAST(start AS INT) AS start, CASE WHEN value = '[REDACTED]' THEN '—' ELSE value END AS matched, "
         f"{_mask_sql()} AS masked, {PCT} AS confidence, upper(risk_level) AS severity, context[:80] AS context, "
         "upper(method[:1]) || method[2:] AS method FROM fi")
register("r_conf_label",
         lambda spark, sf: table(spark, sf, "events").select(
             "event_id", confidence_label(F.when(F.col("value") < 100, F.col("value").cast("int") / 100),
                                          F.when(F.col("value") > 300, "critical").when(F.col("value") > 200, "high")
                                          .when(F.col("value") > 150, "medium").when(F.col("value") > 120, "low")).alias("label")),
         "SELECT event_id, CASE WHEN value < 100 THEN CAST(trunc(value) AS INT) || '%' WHEN value > 300 THEN '95%+' "
         "WHEN value > 200 THEN '90%+' WHEN value > 150 THEN '75%+' WHEN value > 120 THEN '65%+' ELSE '70%' END AS label FROM events")

_MASKED = {"m_email": ("EMAIL",), "m_partial": ("BANK_ACCOUNT", "PHONE_INDIA", "PHONE_US"), "m_ssn": ("SSN",), "m_aadhaar": ("AADHAAR",),
           "m_pan": ("PAN_CARD",), "m_passport": ("PASSPORT",), "m_card": ("CREDIT_CARD",), "m_ip": ("IP_ADDRESS",),
           "m_dob": ("DATE_OF_BIRTH",), "m_iban": ("IBAN",)}
for _name, _cats in _MASKED.items():
    _rules = tuple(r for r in R.PII_RULES if r.category in _cats)

    def _q(spark, sf, rules=_rules):
        return _long(D.detect_pii(document_pages(spark, sf), rules, 0.0), "pii").select(
            "doc_id", "category", "start", "value", mask_value(F.col("category"), F.col("value")).alias("masked"))
    register(_name, _q, pii_sql(_rules, tail=f"SELECT doc_id, category, start, value, {_mask_sql()} AS masked FROM "
                                             "(SELECT doc_id, category, start, val[:80] AS value FROM f)"))
for _name, _src in (("m_generic", "SELECT c_custkey AS id, '' AS category, c_name AS value FROM customer UNION ALL "
                                  "SELECT c_custkey, '', c_mktsegment[:6] FROM customer"),
                    ("m_redacted", "SELECT c_custkey AS id, '' AS category, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN "
                                   "'[REDACTED]' ELSE '[REDACTED — abuse content]' END AS value FROM customer")):
    def _q(spark, sf, name=_name):
        c = table(spark, sf, "customer")
        if name == "m_generic":
            v = c.select(F.col("c_custkey").alias("id"), F.lit("").alias("category"), F.col("c_name").alias("value")).unionByName(
                c.select(F.col("c_custkey").alias("id"), F.lit("").alias("category"),
                         F.substring("c_mktsegment", 1, 6).alias("value")))
        else:
            v = c.select(F.col("c_custkey").alias("id"), F.lit("").alias("category"),
                         pick(("", "[REDACTED]", "[REDACTED — abuse content]"), F.col("c_custkey")).alias("value"))
        return v.select("id", "value", mask_value(F.col("category"), F.col("value")).alias("masked"))
    register(_name, _q, f"SELECT id, value, {_mask_sql()} AS masked FROM ({_src})")
# Hits in order of start, longer ones first; what an earlier one covers is not shown twice.
_MASK_PIECE = (f"CASE WHEN stop <= before THEN '' WHEN start >= before THEN t[before + 1:start] || {_mask_sql()} "
               "ELSE repeat('*', CAST(stop - before AS INT)) END")
register("m_text",
         lambda spark, sf: mask_pages(document_pages(spark, sf)).select("doc_id", F.md5("masked").alias("masked_md5")),
         f"WITH {S.DOCS}, {S.STRIPPED}, {S.located(R.PII_RULES, 60)}, "
         "o AS (SELECT doc_id, start, stop, category, val AS value, row_number() OVER w AS n, coalesce(max(stop) OVER (PARTITION BY doc_id "
         "ORDER BY start, stop DESC, rule_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m "
         "WINDOW w AS (PARTITION BY doc_id ORDER BY start, stop DESC, rule_order)), "
         f"g AS (SELECT doc_id, string_agg({_MASK_PIECE}, '' ORDER BY n) AS pieces, max(stop) AS stop FROM o JOIN st USING (doc_id) GROUP BY doc_id) "
         f"SELECT pg.doc_id, md5(CASE WHEN pieces IS NULL THEN text ELSE regexp_extract(text, '^[{S.SPACE}]*') || pieces || t[stop + 1:] || "
         f"regexp_extract(text, '[{S.SPACE}]*$') END) AS masked_md5 FROM pg LEFT JOIN g USING (doc_id) LEFT JOIN st USING (doc_id)")
