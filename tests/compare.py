"""Run registered queries beside their SQL and compare values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, query, sql):
    """(ok, message)"""
    df = query(spark, sf_dir)
    got_cols, got = rows_of(df.columns, df.collect())
    if sql is None:
        return True, f"rows only: {len(got)}"
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w][:2]
        only = (list(set(got) - set(want))[:2], list(set(want) - set(got))[:2]) if len(got) < 200000 else ""
        return False, f"{len(got)} vs {len(want)} rows; first {diff}; only spark/sql {only}"
    kinds = [{type(x).__name__ for x in col if x is not None} for col in zip(*got)]
    wkinds = [{type(x).__name__ for x in col if x is not None} for col in zip(*want)]
    if kinds != wkinds:
        return False, f"types {kinds} {wkinds}"
    return True, f"{len(got)} rows"


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession
    sf_dir = argv[0]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv[1:] or any(n.startswith(a) for a in argv[1:])]
    bad = 0
    for name in names:
        t = time.time()
        try:
            ok, msg = compare(spark, con, sf_dir, queries[name], oracles.get(name))
        except Exception as e:  # report and go on
            ok, msg = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - t:.1f}s {msg[:900]}", flush=True)
    print(f"{len(names)} queries, {bad} bad, {sum(n not in oracles for n in names)} without SQL")


if __name__ == "__main__":
    main(sys.argv[1:])
