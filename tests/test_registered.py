"""Every registered query against its SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, message = compare(spark, con, SF, QUERIES[name], ORACLES.get(name))
    assert ok, message


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_comparison_notices_a_wrong_value(spark, con):
    sql = ORACLES["t_kpis"].replace("count(*) AS total_scans", "count(*) + 1 AS total_scans")
    assert not compare(spark, con, SF, QUERIES["t_kpis"], sql)[0]


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert sum(r["documents"] for r in rows if r["source"] and r["lang"]) == 200
