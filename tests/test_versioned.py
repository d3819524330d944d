"""Tables updated in place: only what is touched is read and written, and a crash before the commit changes nothing."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from palisade.operators import risk_score as RS, versioned
from palisade.streaming import streams as STR

SCHEMA = "id string, name string, n int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def keyed(spark, folder, **settings):
    return versioned.KeyedTable(spark, f"{folder}/t", SCHEMA, ["id"], **settings)


def made(spark, *rows):
    return spark.createDataFrame(list(rows), f"{SCHEMA}, seq int")


def test_upserts(spark, tmp_path):
    t = keyed(spark, tmp_path, buckets=8)
    assert (t.version(), rows_of(t.read())) == (0, [])
    t.upsert(made(spark, ("a", "x", 1, 0), (None, "y", 2, 0), ("", None, 3, 0), ("a", "later", 9, 1)), order=F.col("seq"))
    assert rows_of(t.read()) == [("", None, 3), ("a", "later", 9), (None, "y", 2)]
    assert t.upsert(made(spark).limit(0)) is None and t.version() == 1
    t.upsert(made(spark, (None, "z", 5, 0), ("b", "new", 6, 0)))
    assert rows_of(t.read()) == [("", None, 3), ("a", "later", 9), ("b", "new", 6), (None, "z", 5)]
    assert rows_of(t.read(version=1)) == [("", None, 3), ("a", "later", 9), (None, "y", 2)]


def test_an_upsert_of_few_keys_rewrites_their_buckets_alone(spark, tmp_path):
    t = keyed(spark, tmp_path, buckets=50)
    t.upsert(spark.range(2000).selectExpr("cast(id AS string) AS id", "'old' AS name", "cast(id AS int) AS n"))
    before = t.parts()
    some = spark.range(7).selectExpr("cast(id AS string) AS id", "'new' AS name", "-1 AS n")
    t.upsert(some)
    touched = {r[0] for r in some.select(versioned.bucket(["id"], 50)).collect()}
    after = t.parts()
    assert {p for p in after if after[p] != before[p]} == touched and len(touched) <= 7 and len(before) == 50
    assert t.read().count() == 2000 and t.read().where("name = 'new'").count() == 7
    assert all(any(f"_part={p}/" in f for p in touched) for f in t.read(touched).inputFiles())


def test_a_crash_before_the_commit(spark, tmp_path, monkeypatch):
    t = keyed(spark, tmp_path, buckets=4)
    t.upsert(made(spark, ("a", "old", 1, 0)))
    with monkeypatch.context() as m:
        m.setattr(versioned.VersionedTable, "_written", lambda *_: 1 / 0)  # data are there, the manifest is not
        with pytest.raises(ZeroDivisionError):
            t.upsert(made(spark, ("a", "lost", 2, 0), ("b", "lost", 2, 0)))
    assert rows_of(keyed(spark, tmp_path, buckets=4).read()) == [("a", "old", 1)]
    t.upsert(made(spark, ("a", "kept", 3, 0)))
    assert rows_of(t.read()) == [("a", "kept", 3)] and t.version() == 2


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    a, b = keyed(spark, tmp_path), keyed(spark, tmp_path)
    a.upsert(made(spark, ("a", "x", 1, 0)))
    monkeypatch.setattr(b, "version", lambda: 0)  # it looked before the other one's commit
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        b.upsert(made(spark, ("a", "y", 2, 0)))
    assert rows_of(a.read()) == [("a", "x", 1)]


def test_parts_that_lose_all_rows(spark, tmp_path):
    t = versioned.VersionedTable(spark, f"{tmp_path}/t", SCHEMA)
    rows = spark.createDataFrame([("a", "p", 1), ("b", "q", 2)], SCHEMA)
    t.replace(rows, rows["name"], ["p", "q"])
    t.replace(rows.where("id = 'b'"), rows["name"], ["p", "q"])
    assert rows_of(t.read()) == [("b", "q", 2)]
    t.replace(rows.limit(0), rows["name"], ["q"])
    assert rows_of(t.read()) == [] and t.version() == 3
    with pytest.raises(ValueError):
        t.replace(rows, rows["name"], ["p"])


FINDING = "source_id string, day date, entity_name string, check_type string, risk_level string"


def findings(n, days, seed=1):
    rnd = random.Random(seed)
    return [(rnd.choice(["s", "t", None]), rnd.choice(days), rnd.choice(["e1", "e2", "e3", None]), rnd.choice(["PII", "abuse", "x", None]),
             rnd.choice(["critical", "high", "low", None])) for _ in range(n)]


DAYS = [datetime.date(2024, 1, d) for d in range(1, 9)]


def test_trend_over_ten_batches_equals_all_at_once(spark, tmp_path):
    root, batches = str(tmp_path / "t"), [findings(30, DAYS[k // 2:k // 2 + 3], k) for k in range(10)]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, FINDING).coalesce(1).write.parquet(f"{tmp_path}/in/k={k}")
        STR.run_trend(spark.readStream.schema(FINDING).parquet(f"{tmp_path}/in/k=*"), root)
    every = spark.createDataFrame([r for b in batches for r in b], FINDING).withColumnRenamed("day", "trend_date")
    keys = ("source_id", "trend_date")
    per = RS.entity_partials(every, keys)
    totals = per.select(*keys).distinct().selectExpr(*keys, "20 AS total_columns")
    want = [r for r in rows_of(RS.metrics_of(per, totals, keys).selectExpr(*RS.TREND))]
    assert rows_of(STR.read_trend(spark, root).select(*RS.TREND)) == want


def test_a_late_batch_reads_its_days_alone_and_counts_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    STR.fold_trend(spark.createDataFrame(findings(200, DAYS), FINDING), 0, root)
    read, plain = [], versioned.VersionedTable.read

    def watched(self, *a, **b):
        df = plain(self, *a, **b)
        read.extend(df.inputFiles())
        return df
    monkeypatch.setattr(versioned.VersionedTable, "read", watched)
    late = spark.createDataFrame([("s", DAYS[2], "late", "PII", "critical")], FINDING)
    STR.fold_trend(late, 1, root)
    assert read and all("_part=2024-01-03/" in f for f in read)
    partials, trend = STR.trend_store(spark, root)
    assert {p for p, v in trend.parts().items() if v == 2} == {p for p, v in partials.parts().items() if v == 2} == {"2024-01-03"}
    monkeypatch.undo()
    once = rows_of(STR.read_trend(spark, root))
    STR.fold_trend(late, 1, root)  # repeated after a failure
    assert rows_of(STR.read_trend(spark, root)) == once
