"""Metadata, changes, scoring, alerts, store and retrieval on small fixtures, with brute force where SQL is no help."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from palisade.functions import registration
from palisade.operators import alerts as A
from palisade.operators import changes as C
from palisade.operators import classify as K
from palisade.operators import retrieval as V
from palisade.operators import risk_score as RS
from palisade.operators import store as ST
from palisade.plans.sources import raise_alerts, scan_sources
from palisade.sources import catalog, docstore, objects, pages as P
from workload import metadata as M
from workload import store as W
from workload.inputs import shared_dir, table

SF = "/root/testdata/sf0.001"
COLS = "source_id string, table_name string, column_name string, ordinal int, data_type string, is_nullable boolean"


def columns(spark, rows):
    return spark.createDataFrame([("s", t, c, i, d, n) for i, (t, c, d, n) in enumerate(rows)], COLS)


@pytest.mark.parametrize("name,label", [
    ("email", "PII_EMAIL"), ("member_id_email", "PII_EMAIL"), ("credit_card_expiry", "PCI_CARD_NUMBER"), ("c_address", "unclassified"),
    ("address", "PII_ADDRESS"), ("cancelled", "PII_PHONE"), ("span", "PCI_CARD_NUMBER"), ("o_state", "unclassified"), ("State", "PII_ADDRESS"),
    ("first name", "PII_NAME"), ("hotel", "PII_PHONE"), ("telex", "unclassified"), ("user_id", "INTERNAL_USER_ID"), ("o_orderkey", "unclassified"),
])
def test_column_names(spark, name, label):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(K.classify_column(F.col("n"))["classification"]).collect()[0][0] == label


def test_structural_changes(spark):
    prev = columns(spark, [("a", "x", "int", True), ("a", "y", "int", True), ("b", "z", "int", True), ("same", "q", "int", True)])
    curr = columns(spark, [("a", "x", "bigint", True), ("a", "w", "int", True), ("c", "z", "int", True), ("same", "q", "int", False)])
    got = {(r["change_type"], r["entity_name"]) for r in C.diff_schemas(prev, curr).collect()}
    assert got == {("new_table", "c"), ("dropped_table", "b"), ("new_column", "a.w"), ("dropped_column", "a.y"), ("type_change", "a.x")}
    assert C.diff_schemas(prev, prev).count() == 0
    back = {(r["change_type"].replace("new", "#").replace("dropped", "new").replace("#", "dropped"), r["entity_name"])
            for r in C.diff_schemas(curr, prev).collect()}
    assert back == got


def test_hash_ignores_order_and_sees_nullability(spark):
    rows = [("a", "x", "int", True), ("a", "y", "text", False)]
    h = lambda r: C.source_hashes(columns(spark, r)).collect()[0]["schema_hash"]
    assert h(rows) == h(rows[::-1]) != h([("a", "x", "int", False), rows[1]])
    table_hash = C.table_hashes(columns(spark, rows)).collect()[0]["table_hash"]
    import hashlib
    import json
    text = json.dumps({"name": "a", "columns": [{"name": "x", "type": "int", "nullable": True}, {"name": "y", "type": "text", "nullable": False}]},
                      sort_keys=True)
    assert table_hash == hashlib.sha256(text.encode()).hexdigest()[:16]


@pytest.mark.parametrize("name", ["größe", 'a"b\\c', "日本 🙂", "tab\tand\x01", "plain"])
def test_hash_escapes_as_the_canonical_form_does(spark, name):
    import hashlib
    import json
    text = json.dumps({"name": name, "columns": [{"name": name, "type": "int", "nullable": True}]}, sort_keys=True)
    got = C.table_hashes(columns(spark, [(name, name, "int", True)])).first()["table_hash"]
    assert got == hashlib.sha256(text.encode()).hexdigest()[:16]


def _scans(df, name):
    """How often a physical plan reads the tagged input."""
    return df._jdf.queryExecution().executedPlan().toString().count(name)


def test_changes_read_each_input_twice_at_most(spark):
    root = shared_dir(spark, "once")
    parts = {}
    for name, df in (("prevc", M.prev_columns(spark, SF)), ("currc", M.curr_columns(spark, SF)),
                     ("prevt", M.table_rows(spark, SF, "prev")), ("currt", M.table_rows(spark, SF, "curr"))):
        df.write.parquet(f"{root}/{name}")
        parts[name] = spark.read.parquet(f"{root}/{name}")
    diff = C.diff_schemas(parts["prevc"], parts["currc"])
    changes = C.detect_changes(*parts.values())
    for name in parts:
        assert _scans(changes, f"{root}/{name}") in (1, 2)
    assert [_scans(diff, f"{root}/{n}") for n in ("prevc", "currc")] == [1, 1]
    routes = {r["source_id"]: r["route"] for r in C.routes(C.compare(parts["prevc"], parts["currc"])).collect()}
    assert set(routes.values()) <= {"initial_scan", "statistics", "structure"} and routes


def test_volume_thresholds(spark):
    cases = {"spike": (100, 301), "edge": (100, 300), "drop": (1001, 200), "small": (1000, 100), "zero": (0, 5)}
    side = lambda i: spark.createDataFrame([("s", k, v[i]) for k, v in cases.items()], "source_id string, table_name string, row_count bigint")
    got = {r["table_name"]: r["change_type"] for r in C.volume_changes(side(0), side(1)).collect()}
    assert got == {"spike": "row_count_spike", "drop": "row_count_drop"}


def test_risk_metrics_edges(spark):
    rows = [("one", "e", "pii", "critical"), ("one", "e", "phi", "high"), ("many", "a", "pii", "critical")] + [("many", f"x{i}", "abuse", "critical") for i in range(5)]
    results = spark.createDataFrame(rows, "source_id string, entity_name string, check_type string, risk_level string")
    totals = spark.createDataFrame([("one", 4), ("many", 0), ("none", 9)], "source_id string, total_columns int")
    got = {r["source_id"]: r for r in RS.risk_metrics(results, totals).collect()}
    assert (got["one"]["risk_score"], got["one"]["compliance_pct"], got["one"]["custom_count"]) == (35.0, 75.0, 1)
    assert (got["many"]["risk_score"], got["many"]["compliance_pct"]) == (100.0, 0.0)
    assert (got["none"]["risk_score"], got["none"]["compliance_pct"], got["none"]["highest_risk"]) == (0.0, 100.0, "low")


@pytest.mark.parametrize("pct,tile", [(69.9, "critical"), (70.0, "high"), (85.0, "medium"), (95.0, "low")])
def test_tiles(spark, pct, tile):
    assert spark.range(1).select(RS.tile_risk(F.lit(pct))).collect()[0][0] == tile


def _walk(seconds, gap):
    kept, last = [], None
    for s in sorted(set(seconds)):
        if last is None or s - last >= gap:
            kept.append(s)
            last = s
    return kept


@pytest.mark.parametrize("chunk", [600, 3600, 604800])
def test_cooldown_against_walk(spark, chunk):
    rnd = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    rows, want = [], set()
    for key, minutes, n in (("hot", 7, 3000), ("cold", 45, 60), ("edge", 30, 0)):
        seconds = [rnd.randrange(0, 86400) for _ in range(n)] or [0, 600, 1800, 1860, 3900]
        rows += [("c", key, start + datetime.timedelta(seconds=s), minutes) for s in seconds]
        want |= {(key, start + datetime.timedelta(seconds=s)) for s in _walk(seconds, minutes * 60)}
    alerts = spark.createDataFrame(rows, "config_id string, source_id string, sent_at timestamp_ntz, cooldown_minutes int")
    got = [(r["source_id"], r["sent_at"]) for r in A.apply_cooldown(alerts, chunk).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("chunk,block", [(3600, 2), (86400, 3), (604800, 64)])
def test_cooldown_with_own_gaps_over_a_clock_change(spark, chunk, block):
    rnd = random.Random(3)
    start, epoch = datetime.datetime(2024, 3, 28), datetime.datetime(1970, 1, 1)
    rows = [(rnd.choice("ab"), rnd.choice("xy"), -1 if i % 50 == 0 else rnd.choice([5, 7, 30, 240, 1440]),
             start + datetime.timedelta(seconds=rnd.randrange(86400 * 9)), i) for i in range(1500)]
    per = {}
    for config, source, gap, time, n in rows:
        if gap > 0:
            at = (config, source, int((time - epoch).total_seconds()))
            per[at] = min(per.get(at, (gap, time, n)), (gap, time, n))
    want, last = [r[4] for r in rows if r[2] <= 0], {}
    for (config, source, second), (gap, _, n) in sorted(per.items()):
        if second - last.get((config, source), -10**12) >= gap * 60:
            want.append(n)
            last[config, source] = second
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        alerts = spark.createDataFrame(rows, "config_id string, source_id string, cooldown_minutes int, sent_at timestamp_ntz, n int")
        assert sorted(r["n"] for r in A.apply_cooldown(alerts, chunk, block).collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_last_row_of_a_key_stands(spark):
    now = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, w int")
    fresh = spark.createDataFrame([(1, "y", 1, 1), (1, "x", 2, 2), (3, "c", 3, 1)], "k int, v string, w int, seq int")
    assert sorted(tuple(r) for r in ST.upsert(now, fresh, "k", order=F.col("seq")).collect()) == [(1, "x", 2), (2, "b", 0), (3, "c", 3)]
    assert sorted(tuple(r) for r in ST.update(now, fresh, "k", order=F.col("seq")).collect()) == [(1, "x", 2), (2, "b", 0)]
    assert ST.upsert(now, fresh.drop("seq"), "k").count() == 3


def test_alert_levels(spark):
    scans = spark.createDataFrame([(f"s{i}", r) for i, r in enumerate(("low", "medium", "high", "critical"))], "scan_id string, highest_risk string")
    configs = spark.createDataFrame([("crit", ["critical"]), ("med", ["medium"]), ("odd", ["bogus"]), ("two", ["bogus", "high"])],
                                    "config_id string, trigger_risk_levels array<string>")
    got = {(r["config_id"], r["highest_risk"]) for r in A.match_alerts(scans, configs).collect()}
    assert got == {("crit", "critical"), ("med", "medium"), ("med", "high"), ("med", "critical"), ("two", "high"), ("two", "critical")}


def test_alert_and_source_plans(spark):
    out = scan_sources(M.prev_columns(spark, SF), M.curr_columns(spark, SF), M.table_rows(spark, SF, "prev"), M.table_rows(spark, SF, "curr"),
                       F.lit("2024-02-01").cast("date"))
    assert out["results"].count() == sum(r["total_violations"] for r in out["metrics"].collect())
    sent = raise_alerts(W.scans(spark, SF), W.configs(spark, SF))
    assert 0 < sent.count() <= W.fired(spark, SF).count()
    assert "Compliance Alert" in sent.first()["message"]


def test_top_k_against_brute_force(spark):
    import numpy as np
    rows = table(spark, SF, "embeddings").collect()
    q = np.asarray(rows[3]["embedding"], dtype=float)
    score = lambda v: 1 - float(q @ v / np.linalg.norm(q) / np.linalg.norm(v))
    want = sorted((score(np.asarray(r["embedding"], dtype=float)), r["vec_id"]) for r in rows if r["label"] == 2)[:7]
    query = spark.createDataFrame([(q.tolist(),)], "v array<double>")
    got = V.top_k(table(spark, SF, "embeddings"), query, 7, F.col("label") == 2, id_col="vec_id").collect()
    assert [r["vec_id"] for r in got] == [w[1] for w in want]
    assert V.top_k(table(spark, SF, "embeddings"), query, 10 ** 6, id_col="vec_id").count() == len(rows)


def test_retrieval_defines_odd_vectors(spark):
    rows = [(1, [1.0, 0.0, 5.0], 0), (2, [1.0, 0.0, -5.0], 0), (3, [0.0, 0.0, 0.0], 0), (4, None, 0), (5, [1.0, 0.0], 0), (6, [1.0, 0.0, 5.0], 1)]
    index = spark.createDataFrame(rows, "id int, embedding array<double>, label int")
    query = spark.createDataFrame([([1.0, 0.0, 5.0],)], "v array<double>")
    assert [r["id"] for r in V.top_k(index, query, 9).collect()] == [1, 6, 2]
    queries = spark.createDataFrame([("q", [1.0, 0.0, 5.0], 0), ("z", [0.0, 0.0, 0.0], 0)], "query_id string, query_vector array<double>, label int")
    by_label = V.top_k_by(index, queries, "label", 2).collect()
    assert [(r["query_id"], r["id"], r["place"]) for r in sorted(by_label, key=lambda r: r["place"])] == [("q", 1, 1), ("q", 2, 2)]
    every = V.top_k_all(index, queries.drop("label"), 2, max_bytes=80).collect()
    assert sorted((r["query_id"], r["id"], r["place"], r["distance"]) for r in every) == [("q", 1, 1, 0.0), ("q", 6, 2, 0.0)]


def test_hot_value_is_salted(spark):
    index = spark.range(2000).select("id", F.array(F.rand(1), F.rand(2)).alias("embedding"), F.lit("hot").alias("label"))
    queries = spark.createDataFrame([("q", [0.3, 0.7], "hot")], "query_id string, query_vector array<double>, label string")
    hint = V.top_k_by(index, queries, "label", 5)
    plan = hint._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and hint.count() == 5


def test_null_keys_have_positions(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), ("k", "c")], "k string, v string")
    got = sorted((r["k"] or "", r["i"]) for r in V.position_within(df, ["k"], ["v"], "i").collect())
    assert got == [("", 0), ("", 1), ("k", 0)]


def test_positions_are_dense(spark):
    df = spark.range(5000).select(F.lit("hot").alias("k"), F.col("id").cast("string").alias("v"))
    got = V.position_within(df, ["k"], ["v"], "i").select("i").collect()
    assert sorted(r[0] for r in got) == list(range(5000))


def test_docstore_missing_is_not_null(spark):
    docs = spark.createDataFrame([("c", '{"a": 1, "b": null}'), ("c", '{"a": "x"}'), ("c", '{"a": 2}'), ("c", "not json")], "c string, body string")
    got = {r["field"]: (r["data_type"], r["is_nullable"]) for r in docstore.infer_fields(docs, "c", "body").collect()}
    assert got == {"a": ("integer", False), "b": ("string", True), "_id": ("ObjectId", False)}


@pytest.mark.parametrize("dialect", list(catalog.DIALECTS))
def test_catalog_queries(dialect):
    q = catalog.catalog_queries(dialect, "o'brien", "db")
    assert {"tables", "columns"} <= set(q) and "{" not in "".join(q.values())
    assert "o''brien" in q["columns"]


def test_catalog_and_objects(spark):
    name = "palisade_t"
    spark.range(3).withColumn("email", F.lit("x")).createOrReplaceTempView(name)
    root = shared_dir(spark, "objects")
    table(spark, SF, "region").coalesce(1).write.csv(f"{root}/a")
    table(spark, SF, "nation").coalesce(1).write.json(f"{root}/b")
    table(spark, SF, "nation").coalesce(1).write.json(f"{root}/deep/er/still")
    for name in (root, f"file:{root}", f"file://{root}/") if root.startswith("/") else (root,):
        found = objects.list_objects(spark, name)
        inv = {r["prefix"]: r["row_count"] for r in objects.inventory(found).collect()}
        assert inv["a"] >= 1 and inv["b"] >= 1 and inv["deep"] >= 1 and set(inv) == {"a", "b", "deep"}
        assert {r["relative"].rsplit("/", 1)[0] for r in found.collect()} == {"a", "b", "deep/er/still"}
    flat = objects.inventory(objects.list_objects(spark, f"{root}/a")).collect()
    assert [r["prefix"] for r in flat] == ["root"]
    samples = objects.sample_objects(spark, root, 10).collect()
    assert len(samples) == 3 and all(0 < len(r["sample"]) <= 500 for r in samples)


def test_text_files_split_into_pages(spark):
    root = shared_dir(spark, "text")
    spark.createDataFrame([("first\fsecond\f",)], "t string").write.text(root)
    got = sorted((r["page_num"], r["text"].strip()) for r in P.read_text_documents(spark, root).collect())
    assert got == [(1, "first"), (2, "second"), (3, "")]


def test_sql_functions(spark):
    registration.register(spark)
    row = spark.sql("SELECT mask_value('EMAIL', 'ann@site.org') AS m, classify_column('cvv').risk_level AS r, check_type('PCI_CVV') AS c").collect()[0]
    assert tuple(row) == ("a***@s***.org", "critical", "confidential")
    texts = ["mail ann@site.org, ann@site.org or 123-45-6789", "", None, "[PAGE 1] ann@site.org"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    frame.createOrReplaceTempView("palisade_some")
    found = {r["i"]: r["f"] for r in spark.sql("SELECT i, detect_pii(x) AS f FROM palisade_some").collect()}
    assert [(f["category"], f["value"]) for f in found[0]] == [("EMAIL", "ann@site.org"), ("SSN", "123-45-6789")]
    assert not found[1] and not found[2] and not found[3]
