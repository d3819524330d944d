"""No pair or row may get lost by chance or order."""

import random

from palisade.llm import decontaminate, simhash, substring_dedup, url_filter
from tests.llm.conftest import sentence


def test_every_pair_at_the_similarity_shares_a_root(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        own = sentence(rng, 9, 10**9)
        rows += [(2 * i, own), (2 * i + 1, own.rsplit(" ", 1)[0])]  # four shingles in five
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["root"] for r in simhash.similar(docs).collect()}
    assert [i for i in range(3000) if got[2 * i] != got[2 * i + 1]] == []
    assert len(set(got.values())) == 3000


def test_a_hot_url_does_not_fill_the_sample(spark):
    hot = [(i, "https://a.example.org/es/1") for i in range(300)]
    rest = [(1000 + i, f"https://w{i}.org/{i}") for i in range(60)] + [(2000 + i, f"https://b.com/de/{i}?x={i}") for i in range(60)]
    asked = [(3000, "https://w1.net/5"), (3001, "https://b.com/xx/5?x=5")]
    for hot_url in (hot, [(i, "https://b.org/1") for i in range(300)]):
        pages = spark.createDataFrame(hot_url + rest + asked, "page_id long, url string")
        rows = {r["page_id"]: r["verdict"] for r in url_filter.judged(pages, sample=40, trees=3).collect()}
        assert (rows[3000], rows[3001]) == ("allow", "block")


def test_a_null_id_comes_last_inside_a_task_too(spark):
    passage = sentence(random.Random(2), 30, 10**6)
    docs = spark.createDataFrame([(None, f"{passage} x"), (7, f"y {passage}")], "doc_id long, text string").coalesce(1)
    rows = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()}
    assert rows == {7: 0, None: 30}


def test_repeated_items_do_not_fill_a_block(spark):
    items = spark.createDataFrame([(1, "one two three four five")] * 500 + [(i, f"item {i}") for i in range(20)], "item_id long, text string")
    blocks = [own for _, own in decontaminate._blocks_of(items, 100)]
    assert sum(map(len, blocks)) == 21 and max(len(t) for own in blocks for t in [" ".join(x for _, x in own)]) < 200


def test_blocks_of_a_benchmark_are_sent_one_at_a_time(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, sentence(rng, 12, 10**6)) for i in range(9)]
    texts = [(i, f"{sentence(rng, 8, 10**6)} {items[i % 9][1] if i % 2 else ''} end") for i in range(40)] + [(None, None), (7, "")]
    docs = spark.createDataFrame([(*t, "a", "b") for t in texts], "doc_id long, text string, _a string, key string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    live, most, plain_broadcast = set(), [], spark.sparkContext.broadcast

    def broadcast(value):
        shared = plain_broadcast(value)
        if isinstance(value, decontaminate.TestIndex):
            live.add(id(shared))
            most.append(len(live))
            destroy = shared.destroy
            shared.destroy = lambda *a: (live.discard(id(shared)), destroy(*a))
        return shared
    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    for call in (decontaminate.clean, decontaminate.matches):
        live.clear(), most.clear()
        out = call(docs, benchmark, block_bytes=70)
        assert len(most) > 5 and max(most) == 1
        if call is decontaminate.clean:
            assert out.columns == docs.columns
            assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out.collect()) == sorted([(False, i) for i in range(0, 40, 2)] + [(True, None), (False, 7)])
        else:
            assert sorted({r["doc_id"] for r in out.collect()}) == list(range(1, 40, 2))
