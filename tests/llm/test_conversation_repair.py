"""Repairs against an exhaustive search and a plain restatement."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from palisade.llm import conversation_repair as C, queries
from tests.llm.conftest import EXTRA

SF = "/root/testdata/sf0.001"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        own = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not own else "duplicate" if (role, text) in seen else "truncated" if own[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def exhaustive(rows):
    """(cost, letters, repaired) over all edits with up to two insertions in a gap."""
    what, options = faults(rows), []
    for (role, text), f in zip(rows, what):
        own = [("D", 3, None)]
        if f in ("", "truncated"):
            extra = f == "truncated"
            own += [("K", extra, (role, text))] + [("R", 2 + extra, (r, text)) for r in ("user", "assistant")]
        options.append(own)
    gap = [()] + [tuple(("I", 2, (r, "")) for r in roles) for n in (1, 2) for roles in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    for choice in itertools.product(*([gap] + [x for o in options for x in (o, gap)])):
        flat = [e for k, c in enumerate(choice) for e in (c if k % 2 == 0 else (c,))]
        kept = [e[2] for e in flat if e[2]]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in kept)):
            found = (sum(e[1] for e in flat), "".join(e[0] for e in flat), kept)
            best = found if best is None or found[:2] < best[:2] else best
    return best


def search(rows):
    """The same for longer conversations: the least (cost, letters) to the end, from every row and state."""
    what = faults(rows)
    best = {(len(rows), s): (c, letters) for s, c, letters in ((0, 0, ""), (1, 4, "II"), (2, 2, "I"), (3, 0, ""))}
    for i in reversed(range(len(rows))):
        extra = what[i] == "truncated"
        for _ in range(4):
            for s in range(4):
                c, letters = best[i + 1, s]
                own = [(c + 3, "D" + letters)]
                if what[i] in ("", "truncated"):
                    c, letters = best[i + 1, C.CHOSEN[s]]
                    own.append((c + 2 + extra, "R" + letters))
                    if (rows[i][0][:1], s) in C.KEPT:
                        c, letters = best[i + 1, C.KEPT[rows[i][0][:1], s]]
                        own.append((c + extra, "K" + letters))
                if (i, C.CHOSEN[s]) in best:
                    c, letters = best[i, C.CHOSEN[s]]
                    own.append((c + 2, "I" + letters))
                best[i, s] = min(own)
    return best[0, 0]


def apply(rows, letters):
    out, i, s = [], 0, 0
    for x in letters:
        role, text = ("", "") if x == "I" else rows[i]
        i += x != "I"
        if x == "K":
            s = C.KEPT[role[:1], s]
            out.append((role, text))
        elif x in "RI":
            s = C.CHOSEN[s]
            out.append((C.NAMES[s], text))
    return out


def plain(rows):
    """Rows of one conversation: (turn, role, text) -> the summary without its id."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns, own = [t for t, _, _ in rows if t is not None], [r[1:] for r in rows]
    what, (cost, letters) = faults(own), search(own)
    text = "\n".join(f"{r}:{x}" for r, x in apply(own, letters))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, what.count("blank"), what.count("duplicate"),
            what.count("truncated"), illegal, cost, letters, hashlib.sha256(text.encode()).hexdigest())


def damage(rows):
    out = []
    for c, t, r, x in rows:
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if how:
            out += [(c, t, "user" if how == 4 else r, "" if how == 1 else re.sub("[.!?]", "", x) if how == 2 else x)] * (1 + (how == 3))
    return out


def by_conversation(rows):
    groups = {}
    for c, *rest in rows:
        groups.setdefault(c, []).append(rest)
    return groups


KEYS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def random_rows(rng, n, roles=("user", "assistant", "system", "tool", "")):
    return [(rng.choice([None, *range(n)]), rng.choice(roles), rng.choice(["Yes.", "No!", "well", " \t", "", "Go on. \n", "é?"])) for _ in range(n)]


def test_search_equals_all_edits():
    rng = random.Random(1)
    for n in (0, 1, 2, 3):
        for _ in range(60 if n < 3 else 25):
            own = [r[1:] for r in random_rows(rng, n)]
            cost, letters, kept = exhaustive(own)
            assert (cost, letters) == search(own) and kept == apply(own, letters)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(c, *r) for c in range(120) for r in random_rows(rng, rng.randrange(1, 14))]
    out += [(None, *r) for r in random_rows(rng, 9)] + [(500, None, None, None), (501, 3, None, "Hi."), (502, 2**60, "user", "a." * 60_000), (502, 2**60 + 1, "assistant", "b.")]
    out += [(600, i, "user" if i % 2 == 0 else "assistant", f"turn {i}.") for i in range(25_000)]  # over several Arrow batches
    out += out[5:9] + [(601, 1, "user", "One."), (601, 1, "user", "One."), (601, 1, "assistant", "One.")]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    columns = "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in (*EXTRA, "conv", "fault", "edit", "nth"))
    return spark.createDataFrame([(*r, *["x"] * (len(EXTRA) + 4)) for r in rows], columns).repartition(5)


def test_summary(table, rows):
    got = {r["conv_id"]: tuple(r[k] for k in KEYS) for r in C.summary(table).collect()}
    assert got == {c: plain(own) for c, own in by_conversation(rows).items()}


def test_small_batches_carry_the_state(spark, rows):
    own = [r for r in rows if r[0] in range(40)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {r["conv_id"]: tuple(r[k] for k in KEYS) for r in C.summary(spark.createDataFrame(own, "conv_id long, turn long, role string, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {c: plain(r) for c, r in by_conversation(own).items()}


def test_repaired_turns(table, rows):
    got = by_conversation(tuple(r) for r in C.repaired(table).collect())
    for conv, own in by_conversation(rows).items():
        kept = [(r, x) for _, r, x in sorted(got.get(conv, []))]
        assert [t for t, _, _ in sorted(got.get(conv, []))] == list(range(len(kept)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in kept))
        assert hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest() == plain(own)[-1]


def test_ids_of_text_and_an_empty_one(spark):
    table = spark.createDataFrame([("", 0, "user", "A."), (None, 0, "assistant", "B.")], "conv_id string, turn int, role string, text string")
    assert {r["conv_id"]: r["audit"] for r in C.summary(table).collect()} == {"": plain([(0, "user", "A.")])[6], None: plain([(0, "assistant", "B.")])[6]}


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.summary(none).collect() == C.edits(none).collect() == C.repaired(none).collect() == []


def test_query(spark, tmp_path, table, rows):
    table.select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    for sf in (SF, str(tmp_path)):
        source = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in source}
        want |= {c: plain(own) for c, own in by_conversation(damage(source)).items()}
        assert {r["conv_id"]: tuple(r[k] for k in KEYS) for r in queries.QUERIES["op12_conversation_repair"](spark, sf).collect()} == want
