"""Detectors against a plain-Python restatement of their definition."""

import re

import pytest
from pyspark.sql import functions as F

from palisade import rules as R
from palisade.operators import detect as D
from palisade.operators.encoding import detect_encoding, longer_than, ocr_issues
from workload.inputs import document_pages, table
from workload.samples import SNIPPETS

SF = "/root/testdata/sf0.001"


def context(text, a, b, width):
    lo, hi = max(0, a - width), min(len(text), b + width)
    return ("…" if lo else "") + text[lo:hi].replace("\n", " ").strip() + ("…" if hi < len(text) else "")


def brute(text, rules, key, width=60):
    """(category, key, start, end, context) of first occurrences."""
    text, seen, out = text.strip(), set(), []
    if not text or text.startswith("[PAGE"):
        return out
    for rule in rules:
        for m in re.finditer(rule.pattern, text, re.I if rule.ignore_case else 0):
            ctx = context(text, m.start(), m.end(), width)
            k = key(rule, m.group(), ctx)
            if k and k not in seen:
                seen.add(k)
                out.append((rule.category, m.start(), m.end(), ctx))
    return out


def masked(_, raw, __):
    v = raw.strip()
    return v[:6] + "…" + v[-4:] if len(v) > 12 else v[:4] + "…"


CASES = {
    "pii": (R.PII_RULES, lambda r, raw, c: raw.strip(), 60, lambda d: D.detect_pii(d, min_confidence=0.0, into="x")),
    "secret": (R.SECRET_RULES, masked, 60, lambda d: D.detect_secrets(d, min_confidence=0.0, into="x")),
    "phrase": (R.ABUSE_PHRASES, lambda r, raw, c: (r.category, raw.lower()[:30]), 80,
               lambda d: D.locate_matches(d, {"x": (R.ABUSE_PHRASES, 80)}).withColumn("x", D.phrase_findings(F.col("x")))),
    "signal": (R.ABUSE_SIGNALS, lambda r, raw, c: c[:50], 40,
               lambda d: D.locate_matches(d, {"x": (R.ABUSE_SIGNALS, 40)}).withColumn("x", D.signal_findings(F.col("x")))),
}

# Texts that meet the corners: dense hits, hits at both ends, wide characters, odd white space.
HARD = [
    "", "   \n\t ", "[PAGE 3: Image-only page]", "a@b.co", "x 1.2.3.4", "a@b.co,c@d.co,e@f.co;" * 40,
    "é.foo@x.com ñ4111111111111111", "😀 a@b.co 😀" * 30, "1.1.1.1 " * 150, "  a@b.co  \x1c",
    "account            ", "Account no.: 12 34 56 78 90 12 end", "dob 1/2/1990 BORN: 01-01-2001",
    "٠١٢-٣٤-٥٦٧٨ and 123-45-6789", "paſſword=topsecret PASSWORD = \"abcdef\"", "salary  -   USD   1,000,000",
    "KILL you İ kill you Kill   them", "²123-45-6789 _123-45-6789 123-45-6789_", "nig* spic. k*ke* chinks!",
    "99876543210 +919876543210 +91-9876543210 91 9876543210", "(123) 456-7890 1(123)456-7890 1-123.456.7890 0123-456-7890",
    "sk-" + "a" * 40 + "-" + "b" * 4, "eyJ" + "a" * 25 + "." + "b" * 25 + "." + "c" * 25 + "-",
    "\n".join(f"user{i}@mail{i}.example.com\t10.0.{i % 256}.7" for i in range(400)),
]


@pytest.fixture(scope="module")
def texts(spark):
    hard = [(10_000 + i, t) for i, t in enumerate(HARD + list(SNIPPETS))]
    rows = spark.createDataFrame(hard, "doc_id bigint, text string").unionByName(
        document_pages(spark, SF).select("doc_id", "text")).unionByName(
        table(spark, SF, "pages").select((F.col("page_id") + 50_000).alias("doc_id"), F.col("html").alias("text")))
    return rows.withColumn("page_num", F.lit(1)).cache()


@pytest.mark.parametrize("name", CASES)
def test_against_plain_python(texts, name):
    rules, key, width, run = CASES[name]
    got = {r["doc_id"]: [(f["category"], f["start"], f["end"], f["context"]) for f in r["x"]]
           for r in run(texts).select("doc_id", "x").collect()}
    for row in texts.collect():
        assert got[row["doc_id"]] == brute(row["text"], rules, key, width), row["doc_id"]


def test_ocr_patterns_against_plain_python(texts):
    labels = {r["doc_id"]: r["o"] for r in texts.select("doc_id", ocr_issues(F.col("text")).alias("o")).collect()}
    for row in texts.collect():
        want = [n for n, p, _ in R.OCR_RULES if re.search(p.replace(r"\x{FFFD}", "�"), row["text"])]
        assert labels[row["doc_id"]] == want, row["doc_id"]


def test_longer_than(spark):
    rows = spark.createDataFrame([("a" * 80,), ("a" * 81,), (" " * 100 + "ab" + " " * 100,), ("a   " * 41,), ("a   " * 40,)], "t string")
    assert [r[0] for r in rows.select(longer_than(F.col("t"), 80)).collect()] == [False, True, False, True, False]


def test_custom_keywords_ignore_case(spark):
    df = spark.createDataFrame([("This is CONFIDENTIAL. Project titan!",), ("nothing",), ("Kelvin",)], "t string")
    got = [r[0] for r in df.select(D.keyword_findings(F.col("t"), ["PROJECT TITAN", "confidential", "kelvin", "confidential"])).collect()]
    assert got == [["PROJECT TITAN", "confidential"], [], ["kelvin"]]


def test_many_hits_on_one_page(spark):
    text = " ".join(f"u{i}@x.org" for i in range(20_000))
    page = spark.createDataFrame([(1, 1, text)], "doc_id bigint, page_num int, text string")
    found = D.detect_pii(page, (R.PII_RULES[0],), into="x").select(F.size("x"), F.element_at("x", -1)["start"]).collect()[0]
    assert found[0] == 20_000 and found[1] == text.rindex("u19999")


def test_encoding_cases(spark):
    rows = [(1, "Hello " + "こんにちは" * 10 + " world", "utf-8", 0.99), (2, "plain words", "utf-8", 0.5),
            (3, "plain words", "utf-8", 0.99), (4, "plain", "unknown", 0.7)]
    pages = spark.createDataFrame(rows, "doc_id bigint, text string, detected_encoding string, encoding_confidence double")
    got = {r[0]: {f["category"]: f["risk_level"] for f in r[1]}
           for r in detect_encoding(pages, R.DEFAULT_RULES["encoding"]).select("doc_id", "encoding").collect()}
    assert "NON_ASCII_CHARS" in got[1]
    assert got[2] == {"LOW_ENCODING_CONFIDENCE": "high"}
    assert got[3] == {}
    assert got[4] == {"LOW_ENCODING_CONFIDENCE": "medium", "NON_UTF8_ENCODING": "high"}


def test_tests_on_the_digits_turn_no_hit_away(spark):
    """Every rule finds the same with its cheap test and without, over digits and signs put together at random."""
    import random

    rnd = random.Random(5)
    parts = ["1", "22", "333", "4444", "4111", "987654321", "-", " ", "\u00a0", ".", "/", "(", ")", "+91", "A", "AB", "GB29", "ABCDE", "born ", "DOB: ", "\u0665\u0666", "x", "\n"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(3, 40))) for _ in range(3000)] + list(SNIPPETS)
    pages = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = [r for r in R.PII_RULES if (r.guard or "").startswith("near:")]
    assert len(near) == 10
    one, other = (D.locate_matches(pages, {"x": (rules, 20)}).select("doc_id", "x").collect() for rules in (
        near, [r._replace(guard="lit:") for r in near]))
    assert one == other and {m["rule_order"] for r in one for m in r["x"]} == set(range(10))
