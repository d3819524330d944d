"""Retrieval of many queries: the exact way against one that compares all, the approximate way by its recall."""

import numpy as np
import pytest

from palisade.operators import near as N, retrieval as V
from workload.inputs import table

SF = "/root/testdata/sf0.01"
SCHEMA = "id string, embedding array<float>"


def plain(index, queries, k):
    out = {}
    for key, q in queries:
        found = []
        for i, v in index:
            if not q or not v or None in q or None in v or len(q) != len(v) or not np.any(q) or not np.any(v):
                continue
            a, b = np.array(q, np.float32).astype(float), np.array(v, np.float32).astype(float)
            found.append((round(1 - a @ b / np.sqrt((a @ a) * (b @ b)), 6) + 0.0, i))
        out[key] = sorted(found)[:k]
    return {k: [d for d, _ in v] for k, v in out.items() if v}


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(1)
    rows = [(f"r{i:04d}", rng.normal(size=8).tolist()) for i in range(500)]
    rows += [(f"c{i:04d}", rows[7][1]) for i in range(300)] + [(f"s{i}", rng.normal(size=5).tolist()) for i in range(9)]
    rows += [("null", None), ("part", [1.0, None] + [0.0] * 6), ("zero", [0.0] * 8), ("none", [])]
    queries = [(i, rows[k][1]) for i, k in enumerate((0, 7, 8, 120, 805, 808))] + [(20, rows[7][1]), (21, None), (22, [0.0] * 8), (23, [1.0, 2.0, 3.0])]
    return rows, queries, spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(queries, "query_id long, query_vector array<float>")


def distances(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: r["place"]):
        out.setdefault(r["query_id"], []).append(r["distance"])
    return out


@pytest.mark.parametrize("max_bytes", [32_000_000, 300])
def test_all_in_blocks(odd, max_bytes):
    rows, queries, index, asked = odd
    assert distances(V.top_k_all(index, asked, 4, max_bytes=max_bytes)) == plain(rows, queries, 4)


def test_copies_go_by_id(odd):
    _, _, index, asked = odd
    rows = V.top_k_all(index, asked.where("query_id = 1"), 3).collect()
    assert sorted(r["id"] for r in rows) == ["c0000", "c0001", "c0002"]


def test_near_looks_into_every_cell_when_told_to(odd):
    """With all cells probed the approximate way is exact; small groups and blocks change nothing."""
    rows, queries, index, asked = odd
    quantiser = N.Quantiser(index, codes=4)
    got = distances(N.top_k_near(index, asked, 4, quantiser, probes=16, most=20, block=2))
    assert got == plain(rows, queries, 4)


def test_recall(spark):
    e = table(spark, SF, "embeddings")
    queries = e.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS query_vector")
    assert N.recall(e, queries, id_col="vec_id") >= 0.9
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    rows = [(i, (centres[i % 40] + 0.4 * rng.normal(size=32)).tolist()) for i in range(6000)]
    index = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = index.where("id % 20 = 0").selectExpr("id AS query_id", "embedding AS query_vector")
    assert N.recall(index, asked) >= 0.9


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, query_vector array<float>")
    assert V.top_k_all(none, asked, 3).collect() == N.top_k_near(none, asked, 3).collect() == []
    assert V.top_k_all(none, asked.limit(0), 3).collect() == []
