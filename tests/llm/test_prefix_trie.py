"""Tries against all prefixes of all conversations."""

import base64
import hashlib
import random
import zlib

import pytest

from palisade.llm import prefix_trie as T, queries
from tests.llm.conftest import EXTRA

SF = "/root/testdata/sf0.001"
KEYS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def tid(role, text):
    role, text = role.encode(), text.encode()
    joined = b"%d:%b%d:%b" % (len(role), role, len(text), text)
    return base64.b64encode(hashlib.sha256(joined).digest())[:20]


def sequences(rows):
    """{conv: [(role, text)]} in the order of turns."""
    out = {}
    for c, t, r, x in rows:
        if c is not None:
            out.setdefault(c, []).append((t, r or "", x or ""))
    return {c: [turn[1:] for turn in sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, tid(*r[1:])))] for c, own in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = tuple(convs.get(c - c % 100, [])[:h] + own[h:])
    return out


def plain(convs):
    members, out = {}, {}
    for c, own in convs.items():
        for d in range(len(own) + 1):
            members.setdefault(own[:d], []).append(c)
    for path in sorted(members, key=len, reverse=True):
        own = sorted(members[path])
        below = [p for p in {convs[c][:len(path) + 1] for c in own} if len(p) > len(path)]
        saved = (len(own) - 1) * (len(path[-1][1]) if path else 0) + sum(out[p][6] for p in below)
        ends = ",".join(str(c) for c in own if convs[c] == path)
        out[path] = (own[0], len(path), min(members[path[:-1]]) if path else None, len(own), len(below),
                     sum(out[p][5] for p in below) or 1, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values())


def rows_of(df):
    return sorted(tuple(r[k] for k in KEYS) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for c in range(140):                                         # many branches, many equal conversations
        n = rng.choice([0, 1, 2, 3, 7, 8])
        out += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "é🙂"])) for t in range(n)]
    out += [(c, t, "user", "hot") for c in range(300, 340) for t in range(4)]                   # one large group of copies
    out += [(c, t, "user", "same way" if t < 9 else f"{c % 5} {t}") for c in range(400, 425) for t in range(12)]
    out += [(c, t, "user", "deep") for c in (500, 500 + 7) for t in range(30)] + [(507, 30, "user", "deeper")]
    out += [(600, None, None, None), (600, None, "user", "x"), (600, 3, "user", None), (600, 3, "user", "tie"), (601, -5, "", "y" * 100_000)]
    out += [(None, 1, "user", "no conversation"), (-250, 1, "user", "below"), (-201, 1, "user", "below")]
    out += out[3:6] + [(700, 1, "user", "Twice."), (700, 1, "user", "Twice.")]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    columns = "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in (*EXTRA, "conv", "tid", "j", "chars"))
    return spark.createDataFrame([(*r, *["x"] * (len(EXTRA) + 4)) for r in rows], columns).repartition(4)


def test_places_of_turns(table, rows):
    got = {}
    for r in T.turns(table).collect():
        got.setdefault(r["conv"], {})[r["pos"]] = (r["tid"].encode(), r["chars"])
    want = {c: {i: (tid(*turn), len(turn[1])) for i, turn in enumerate(own)} for c, own in sequences(rows).items()}
    assert got == want


@pytest.mark.parametrize("settings", [{}, {"piece": 4, "limit": 6}, {"piece": 100, "limit": 2}])
def test_nodes(table, rows, settings):
    """Neither bursts, nor pieces, nor the size of containers change a node."""
    assert rows_of(T.nodes(table, **settings)) == plain({c: tuple(own) for c, own in sequences(rows).items()})


def test_query(spark, tmp_path, table, rows):
    table.select("conv_id", "turn", "role", "text").where("conv_id >= 0 OR conv_id IS NULL").write.parquet(f"{tmp_path}/conversations.parquet")
    for sf in (SF, str(tmp_path)):
        source = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert rows_of(queries.QUERIES["op11_prefix_trie"](spark, sf)) == plain(rebuilt(sequences(source)))


def test_ids_of_a_class_in_several_packs(table, rows, monkeypatch):
    monkeypatch.setattr(T, "PACK", 20)
    assert rows_of(T.nodes(table)) == plain({c: tuple(own) for c, own in sequences(rows).items()})


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert T.nodes(none).collect() == T.rebuilt_nodes(none).collect() == []
    assert T.nodes(spark.createDataFrame([(None, 1, "user", "x")], none.schema)).collect() == []
