"""Language profiles by held-out accuracy, and the statistics and samples of columns against exact ones."""

import random

import pytest
from pyspark.sql import functions as F

from palisade.operators.language import LanguageModel
from palisade.sources import columns as C
from workload.inputs import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents").where("length(text) > 200")
    model = LanguageModel(docs.where("doc_id % 2 = 0"))
    rows = model.detected(docs.where("doc_id % 2 = 1").select("doc_id", "lang", "text")).collect()
    right = sum(r["lang"] == r["language"] for r in rows)
    assert len(rows) > 300 and right >= 0.95 * len(rows), (right, len(rows))


SAMPLES = {
    "ja": "日本語の文章はひらがなとカタカナと漢字で書かれます。私は毎朝コーヒーを飲みます。東京はとても大きい都市です。",
    "zh": "中文句子由汉字组成没有空格。我每天早上喝咖啡。北京是一个非常大的城市。他们昨天去了图书馆。",
    "th": "ภาษาไทยเขียนโดยไม่มีช่องว่างระหว่างคำ ฉันดื่มกาแฟทุกเช้า กรุงเทพเป็นเมืองใหญ่มาก",
    "ru": "русский текст пишется кириллицей и слова разделяются пробелами каждое утро я пью кофе москва очень большой город",
    "en": "english text is written in the latin script and words are parted by spaces every morning i drink coffee in the city",
}


def test_languages_without_spaces_and_odd_texts(spark):
    rnd = random.Random(1)
    cut = lambda t: "".join(t[i:i + 12] for i in sorted(rnd.sample(range(len(t) - 12), 6)))
    rows = [(t, lang) for lang, t in SAMPLES.items()] + [("no language", None), (None, "en"), ("", "en"), ("x", "")]
    model = LanguageModel(spark.createDataFrame(rows, "text string, lang string"))
    pages = [(lang, cut(t)) for lang, t in SAMPLES.items() for _ in range(5)]
    odd = [(None, None), (None, ""), (None, "12345 !!! ---"), (None, "Hi")]
    got = model.detected(spark.createDataFrame(pages + odd, "want string, text string")).collect()
    assert [r["language"] for r in got] == [r["want"] for r in got]
    assert all(r["language_margin"] >= 0 for r in got if r["language"])
    nothing = LanguageModel(spark.createDataFrame([], "text string, lang string"))
    assert nothing.of(SAMPLES["en"]) == (None, None)
    long = SAMPLES["ru"] * 60_000
    assert model.of(long)[0] == "ru"


def test_samples_of_all_columns_in_one_scan(spark):
    rows = [(i, f"v{i % 50}", None if i % 3 else 1.5, "x", i % 2 == 0) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, `a b` string, c double, value string, d boolean").repartition(6)
    got = {}
    for r in C.sample_columns(df, 7).collect():
        got.setdefault(r["column_name"], []).append(r["value"])
    assert {k: sorted(v) for k, v in got.items()} == {
        c: sorted(r["value"] for r in C.sample_column(df.withColumnRenamed("a b", "ab"), c.replace(" ", ""), 7).collect()) for c in df.columns}
    assert C.sample_columns(df.limit(0), 7).collect() == []
    plan = C.sample_columns(df, 7)._jdf.queryExecution().toString()
    assert plan.count("Scan ExistingRDD") // max(1, plan.count("== Optimized Logical Plan ==")) <= 2 and "WindowGroupLimit" in plan


def test_sketches_of_days_merge_to_those_of_all(spark):
    e = table(spark, SF, "events")
    days = [e.where(F.pmod("event_id", F.lit(4)) == k) for k in range(4)]
    sketches = C.column_sketches(days[0])
    for d in days[1:]:
        sketches = sketches.unionByName(C.column_sketches(d))
    got = {r["column_name"]: r for r in C.sketched_stats(C.merge_sketches(sketches)).collect()}
    n = e.count()
    for c, kind in e.dtypes:
        exact = e.select(c).where(f"{c} IS NOT NULL").distinct().count()
        assert got[c]["n"] == n and abs(got[c]["n_distinct"] - exact) <= max(2, 0.06 * exact)
        if kind in ("double", "bigint", "int"):
            for q, value in zip((0.25, 0.5, 0.75), got[c]["quantiles"]):
                below = e.where(F.col(c) <= value).count() / n
                less = e.where(F.col(c) < value).count() / n
                assert less - 0.03 <= q <= below + 0.03
    nothing = C.sketched_stats(C.column_sketches(e.limit(0))).collect()
    assert all(r["n"] == 0 and r["null_frac"] is None and r["n_distinct"] == 0 and r["quantiles"] is None for r in nothing)
