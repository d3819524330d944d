"""Cooldown in batch and stream against one walk, with missing, zero and negative gaps; both must end."""

import datetime
import random

import pytest

from palisade.operators import alerts as A
from palisade.streaming import streams as STR

START, EPOCH = datetime.datetime(2024, 3, 28), datetime.datetime(1970, 1, 1)
SCHEMA = "config_id string, source_id string, cooldown_minutes int, sent_at timestamp_ntz"


def second(time):
    return int((time - EPOCH).total_seconds())


def walk(rows):
    """Sorted (config, source, second) of the alerts that are sent."""
    per, sent, last = {}, [], {}
    for config, source, minutes, time in rows:
        gap = 60 * (30 if minutes is None else minutes)
        at = (config, source, second(time))
        if gap <= 0:
            sent.append(at)
        else:
            per[at] = min(per.get(at, gap), gap)
    for at, gap in sorted(per.items(), key=lambda x: x[0][2]):
        if at[2] - gap >= last.get(at[:2], -10**12):
            sent.append(at)
            last[at[:2]] = at[2]
    return sorted(sent, key=repr)


def made(n, seed=1, gaps=(None, 0, -3, 1, 5, 30, 240), days=3):
    rnd = random.Random(seed)
    return [(rnd.choice("ab"), rnd.choice(["x", "y", None]), rnd.choice(gaps), START + datetime.timedelta(seconds=rnd.randrange(86400 * days // 4) * 4))
            for _ in range(n)]


def batch(spark, rows, **settings):
    got = A.apply_cooldown(spark.createDataFrame(rows, SCHEMA), **settings).collect()
    return sorted(((r["config_id"], r["source_id"], second(r["sent_at"])) for r in got), key=repr)


def stream(spark, folder, batches, **settings):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in/k={k:03d}")
        source = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in/k=*")
        # Each run takes up the state of the last one; a run has its own micro-batch.
        out = STR.cooldown_stream(source, **settings)
        STR.run_available(out, f"{folder}/out", f"{folder}/state", rocksdb=True)
    got = spark.read.schema("config_id string, source_id string, second long").parquet(f"{folder}/out").collect()
    return sorted((tuple(r) for r in got), key=repr)


@pytest.mark.parametrize("settings", [{}, {"whole": 50, "chunk_seconds": 3600, "block": 3}, {"whole": 0}])
def test_batch_with_any_gap(spark, settings):
    rows = made(2500)
    assert batch(spark, rows, **settings) == walk(rows)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("gaps", [(None,), (0,), (-1,), (None, 0)])
def test_gaps_of_one_kind_end(spark, tmp_path, gaps):
    rows = made(60, gaps=gaps)
    assert batch(spark, rows) == batch(spark, rows, whole=0) == walk(rows)
    assert stream(spark, str(tmp_path), [rows]) == walk(rows)


def test_stream_over_batches_equals_the_batch(spark, tmp_path):
    rows = sorted(made(400), key=lambda r: r[3])
    parts = [rows[i:i + 80] for i in range(0, 400, 80)]
    got = stream(spark, str(tmp_path), parts, longest_minutes=240, delay="10 minutes")
    assert got == batch(spark, rows) == walk(rows)


def test_shortest_gap_of_a_second_counts_whichever_comes_first(spark, tmp_path):
    at = [START + datetime.timedelta(seconds=s) for s in (0, 400, 400, 400)]
    rows = [("a", "x", g, t) for g, t in zip((5, 30, 5, 60), at)]
    assert stream(spark, str(tmp_path), [rows[:1], rows[1:]]) == walk(rows) == [("a", "x", second(at[0])), ("a", "x", second(at[1]))]


def test_a_longer_gap_of_a_later_alert_holds(spark, tmp_path):
    rows = [("a", "x", g, START + datetime.timedelta(seconds=s)) for s, g in ((0, 5), (1200, 30), (1900, 30), (1800, 30))]
    got = stream(spark, str(tmp_path), [[r] for r in rows[:3]], delay="1 second", longest_minutes=30)
    assert got == walk(rows[:3]) == [("a", "x", second(START)), ("a", "x", second(START) + 1900)]


def test_state_of_a_silent_rule_goes_and_changes_nothing(spark, tmp_path):
    rows = [("a", "x", 5, START), ("b", "y", 5, START + datetime.timedelta(hours=3)), ("b", "y", 5, START + datetime.timedelta(hours=4)),
            ("a", "x", 30, START + datetime.timedelta(hours=5))]
    assert stream(spark, str(tmp_path), [[r] for r in rows], delay="1 minute", longest_minutes=30) == walk(rows)


def test_a_gap_beyond_the_stated_longest_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="longer than the longest"):
        stream(spark, str(tmp_path), [[("a", "x", 90, START)]], longest_minutes=60)
