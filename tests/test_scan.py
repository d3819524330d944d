"""Scan plan: page and document scoring, switches, external findings, invariants."""

import pytest
from pyspark.sql import functions as F

from palisade import rules as R
from palisade.functions.masking import mask_value
from palisade.operators.scoring import document_summary
from palisade.plans.scan import scan_documents, scan_pages
from workload.inputs import conversation_pages, shared_dir

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id bigint, page_num int, text string, char_count int, detected_encoding string, encoding_confidence double")


def pages(spark, *texts):
    return spark.createDataFrame([(1, i + 1, t, len(t), "utf-8", 0.99) for i, t in enumerate(texts)], SCHEMA)


def test_pages_and_document(spark):
    df = pages(spark, "Mail jane@example.com please", "password = hunter22", "all is well", "")
    findings, results, summary = scan_documents(df)
    risks = {r["page_num"]: r["overall_risk"] for r in results.collect()}
    assert risks == {1: "high", 2: "critical", 3: "low", 4: "low"}
    s = summary.collect()[0]
    assert (s["total_flags"], s["highest_risk"], s["pages_with_issues"], s["clean_pages"]) == (2, "critical", 2, 2)
    assert {r["category"] for r in findings.collect()} == {"EMAIL", "PASSWORD_INLINE"}


@pytest.mark.parametrize("flags,label", [(0, "low"), (1, "medium"), (2, "medium"), (4, "medium"), (5, "high"), (9, "high"), (10, "critical")])
def test_flag_count_raises_risk(spark, flags, label):
    text = "hosts " + " ".join(f"10.0.0.{i}" for i in range(flags))
    assert scan_pages(pages(spark, text)).collect()[0]["overall_risk"] == label


def test_document_total_raises_risk(spark):
    texts = [f"host 10.0.0.{i} is up" for i in range(10)]
    results = scan_pages(pages(spark, *texts))
    assert {r["overall_risk"] for r in results.collect()} == {"medium"}
    assert document_summary(results).collect()[0]["highest_risk"] == "critical"


def test_switches(spark):
    rules = R.default_rules()
    for section in ("pii", "confidentiality", "encoding", "abuse"):
        rules[section]["enabled"] = False
    row = scan_pages(pages(spark, "jane@example.com password=abcdef kill you"), rules).collect()[0]
    assert row["total_flags"] == 0 and row["overall_risk"] == "low"


def test_external_findings(spark):
    df = pages(spark, "Mail jane@example.com please")
    external = spark.createDataFrame([
        (1, 1, "pii", 0, "NAME", "Jane", "", 0.9, "high"), (1, 1, "pii", 1, "NAME", "Dr. Jones", "", 0.9, "high"),
        (1, 1, "pii", 2, "NAME", "jones", "", 0.99, "high"), (1, 1, "pii", 3, "NAME", "Unsure", "", 0.2, "high"),
        (1, 1, "confidential", 0, "SOURCE_CODE", "f()", "", 0.9, "medium"), (1, 1, "confidential", 1, "SOURCE_CODE", "f()", "", 0.9, "medium"),
        (1, 1, "confidential", 2, "PASSWORD_INLINE", "x", "", 0.9, "critical"),
        (1, 1, "abuse", 0, "TERRORISM", "v", "some context", 0.5, "low"),
    ], "doc_id bigint, page_num int, check_type string, seq int, category string, value string, context string, confidence double, risk_level string")
    row = scan_pages(df, external=external).collect()[0]
    assert [f["value"] for f in row["pii_flags"]] == ["jane@example.com", "Dr. Jones"]
    assert [f["category"] for f in row["confidential_flags"]] == ["SOURCE_CODE", "SOURCE_CODE"]
    assert [(f["category"], f["risk_level"]) for f in row["abuse_flags"]] == [("TERRORISM", "critical")]


def test_invariants_and_stored_results(spark):
    df = conversation_pages(spark, SF)
    findings, results, summary = scan_documents(df, results_path=shared_dir(spark, "results"))
    totals = summary.agg(*[F.sum(c).alias(c) for c in (
        "total_pages", "pages_with_issues", "clean_pages", "total_flags", "pii_issues", "confidential_issues", "encoding_issues",
        "abuse_issues", *[f"{n}_pages" for n in R.RISK_LEVELS])]).collect()[0]
    assert totals["total_pages"] == df.count() == totals["pages_with_issues"] + totals["clean_pages"]
    assert totals["total_pages"] == sum(totals[f"{n}_pages"] for n in R.RISK_LEVELS)
    assert totals["total_flags"] == sum(totals[f"{c}_issues"] for c in ("pii", "confidential", "encoding", "abuse")) == findings.count()


@pytest.mark.parametrize("category,value,want", [
    ("EMAIL", "jane.doe@mail.example.org", "j***@m***.example.org"), ("EMAIL", "no-at-sign", "***@***.***"), ("EMAIL", "@x.com", "***@x***.com"),
    ("EMAIL", "a@localhost", "a***@l***."), ("EMAIL", "abcdef@", "abc**f@"),
    ("PHONE_INDIA", "+91 9876543210", "**********10"), ("PHONE_US", "(415) 555-2671", "******2671"), ("PHONE_US", "123", "***"),
    ("SSN", "123-45-6789", "***-**-6789"), ("SSN", "12", "***-**-****"), ("AADHAAR", "2345 6789 0123", "XXXX XXXX 0123"),
    ("PAN_CARD", "ABCDE1234F", "AXXXX1234F"), ("PAN_CARD", "ABC", "XXXXX****X"), ("PASSPORT", "A1234567", "AXXXXXX"), ("PASSPORT", "A", "XXXXXXX"),
    ("CREDIT_CARD", "4111-1111-1111-1234", "XXXX-XXXX-XXXX-1234"), ("CREDIT_CARD", "12", "XXXX-XXXX-XXXX-XXXX"),
    ("BANK_ACCOUNT", "Account no: 123456789", "XXXXX6789"), ("IP_ADDRESS", "10.20.30.40", "10.20.XXX.XXX"), ("IP_ADDRESS", "x", "X.X.X.X"),
    ("DATE_OF_BIRTH", "DOB: 12-05-1990", "XX/XX/1990"), ("DATE_OF_BIRTH", "1990", "XX/XX/XXXX"), ("IBAN", "GB29NWBK60161331926819", "GB29XXXXXXXXXXXXXX6819"),
    ("IBAN", "GB29", "XXXXXXXX"), ("OTHER", "abcdef", "******"), ("OTHER", "abcdefg", "abc**fg"), ("OTHER", "", "[REDACTED]"),
    ("EMAIL", "[REDACTED]", "[REDACTED]"),
])
def test_masks(spark, category, value, want):
    df = spark.createDataFrame([(category, value)], "c string, v string")
    assert df.select(mask_value(F.col("c"), F.col("v"))).collect()[0][0] == want


def masked(spark, *texts):
    from palisade.operators.masked import mask_pages
    return [r["masked"] for r in mask_pages(pages(spark, *texts)).orderBy("page_num").collect()]


def test_masking_by_place(spark):
    long = "x" * 90 + "@example.com"
    got = masked(spark, f"  to {long} end \n", "v1.2.3.4 and 1.2.3.4 here", "nothing", "", "card 4111 1111 1111 1111.", "+91 9876543210 and (415) 555-2671")
    assert got[0] == "  to x***@e***.com end \n"
    assert got[1] == "v1.2.3.4 and 1.2.XXX.XXX here"
    assert got[2:4] == ["nothing", ""]
    assert "4111 1111" not in got[4] and got[4].startswith("card ") and got[4].endswith(".")
    assert "98765" not in got[5] and "555" not in got[5]


def test_masking_of_overlapping_hits(spark):
    """Nothing a hit covers stays readable where hits of several rules overlap."""
    texts = ["account no: 123456789012 12", "4111 1111 1111 1111 1111", "a@b.co" * 40, "10.0.0.1" + " 10.0.0.2" * 300]
    for text, out in zip(texts, masked(spark, *texts)):
        assert "123456" not in out and "1111 1111 1111 1111" not in out and "0.0.2 " not in out
        assert len(out) > 5


def test_keywords_in_the_scan(spark):
    rules = R.default_rules()
    df = pages(spark, "about Project TITAN, internal use only", "nothing")
    assert not any(r["total_flags"] for r in scan_pages(df, rules).collect())
    rules["confidentiality"]["match_keywords"] = True
    rows = {r["page_num"]: r for r in scan_pages(df, rules).collect()}
    assert [(f["category"], f["value"], f["start"]) for f in rows[1]["confidential_flags"]] == [
        ("CUSTOM_KEYWORD", "PROJECT TITAN", 6), ("CUSTOM_KEYWORD", "internal use only", 21)]
    assert not rows[2]["confidential_flags"]


def test_nested_export(spark):
    import json

    from palisade.operators.scoring import as_nested
    results = scan_pages(pages(spark, "Mail jane@example.com please", "fine"))
    rows = as_nested(results, document_summary(results)).collect()
    assert sorted((r["kind"], r["page_num"]) for r in rows) == [("page", 1), ("page", 2), ("summary", 0)]
    body = {(r["kind"], r["page_num"]): json.loads(r["json"]) for r in rows}
    assert body["summary", 0]["total_flags"] == 1 and body["page", 1]["pii_flags"][0]["category"] == "EMAIL"


def test_a_file_of_rules_overlays_the_defaults(spark, tmp_path):
    import json
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"pii": {"enabled": False}, "confidentiality": {"match_keywords": True, "custom_keywords": ["ünternehmen x"]},
                                "own": {"a": 1}, "ignored": 3}), encoding="utf-8")
    rules = R.load_rules(str(path))
    assert rules["pii"] == R.default_rules()["pii"] | {"enabled": False} and rules["own"] == {"a": 1} and "ignored" not in rules
    assert R.load_rules() == R.default_rules()
    row = scan_pages(pages(spark, "Mail jane@example.com about ÜNTERNEHMEN X"), rules).collect()[0]
    assert not row["pii_flags"] and [f["value"] for f in row["confidential_flags"]] == ["ünternehmen x"]
