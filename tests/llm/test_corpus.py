"""Quality model, near-dedup, decontamination, mixing, sharding, substring dedup and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palisade.llm import base, decontaminate, graph, mixing, quality_lm, sharding, simhash, substring_dedup
from tests.llm import plain
from tests.llm.conftest import sentence


def key(x):
    return -1 if x is None else x


# --- language model

def kneser_ney(texts):
    """Minus log probability of every gram, by dictionaries."""
    table, order, size = quality_lm.classes(), quality_lm.ORDER, quality_lm.SYMBOLS
    grams = Counter()
    for text in texts:
        own = [0] * (order - 1) + [int(table[b]) for b in text.encode()]
        grams.update(tuple(own[i:i + order]) for i in range(len(own) - order + 1))
    counts = {order: grams}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cuts = {}
    for n, seen in counts.items():
        c = [sum(v == k for v in seen.values()) for k in range(1, 5)]
        y = c[0] / (c[0] + 2 * c[1]) if c[0] else 0.5
        cuts[n] = [min(max(k - (k + 1) * y * c[k] / c[k - 1] if c[k - 1] else k * 0.5, 0.1), k) for k in (1, 2, 3)]

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / size
        followers = {g: v for g, v in counts[n].items() if g[:-1] == gram[:-1]}
        if not followers:
            return p(gram[1:])
        total, cut = sum(followers.values()), cuts[n]
        left = sum(cut[min(v, 3) - 1] for v in followers.values())
        own = followers.get(gram, 0)
        return (max(own - cut[min(own, 3) - 1], 0) if own else 0) / total + left / total * p(gram[1:])
    return p


def test_language_model_against_dictionaries(spark):
    rng = random.Random(2)
    texts = [sentence(rng, 30, 12) + rng.choice([".", "!", " É"]) for _ in range(8)]
    docs = spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts)], "text string, fold int").repartition(3)
    cost = quality_lm.dense(quality_lm.train(quality_lm.counted(docs)).toArrow())
    p, size = kneser_ney(texts), quality_lm.SYMBOLS
    for _ in range(300):
        gram = tuple(rng.choice([0, 23, 27, 28, 29, 31, 40]) if rng.random() < 0.7 else rng.randrange(size) for _ in range(4))
        code = sum(c * size**(3 - i) for i, c in enumerate(gram))
        assert cost[code] == pytest.approx(-math.log(p(gram)), rel=1e-4)
    assert np.exp(-cost.astype(float)).reshape(-1, size).sum(axis=1) == pytest.approx(1.0, abs=1e-5)


def word_kneser_ney(texts, spell):
    """Minus log probability of a text's words, by dictionaries; spell gives that of an unknown word's bytes."""
    marked = [[None, *plain.words(t), None] for t in texts]
    pairs = Counter(pair for own in marked for pair in zip(own, own[1:]))
    after = Counter(w for _, w in pairs)

    def cuts(seen):
        c = [sum(v == k for v in seen.values()) for k in range(1, 5)]
        y = c[0] / (c[0] + 2 * c[1]) if c[0] else 0.5
        return [min(max(k - (k + 1) * y * c[k] / c[k - 1] if c[k - 1] else k * 0.5, 0.1), k) for k in (1, 2, 3)]
    two, one = cuts(pairs), cuts(after)
    rest = sum(one[min(n, 3) - 1] for n in after.values()) / len(pairs)

    def cost(text):
        own, total = [None, *plain.words(text), None], 0.0
        for v, w in zip(own, own[1:]):
            p = rest * math.exp(-spell(w)) + (after[w] - one[min(after[w], 3) - 1] if after[w] else 0) / len(pairs)
            seen = [n for (a, _), n in pairs.items() if a == v]
            if seen:
                n = pairs[v, w]
                p = (n - two[min(n, 3) - 1] if n else 0) / sum(seen) + sum(two[min(k, 3) - 1] for k in seen) / sum(seen) * p
            total -= math.log(p)
        return total
    return cost


def test_word_model_against_dictionaries(spark):
    rng = random.Random(3)
    texts = [sentence(rng, 40, 12) for _ in range(12)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(100 + i, sentence(rng, 20, 25), "en") for i in range(20)]
    rows += [(200, rows[0][1] + " zzz zzz", "en"), (201, rows[0][1] + " zzz zzz", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = quality_lm.Classifier(docs, docs.where("doc_id < 12").select("doc_id"))
    table, costs = quality_lm.classes(), model.cost.value[0]

    def spell(word):
        if word is None:
            return 0.0
        data = np.frombuffer(f" {word} ".encode(), np.uint8)
        return float(costs[quality_lm.block_codes(data, np.array([0, len(data)]), table)][1:].sum())
    cost = word_kneser_ney(texts, spell)
    scored = model._scored(docs.withColumn("model", F.lit(0)), model.cost).collect()
    assert len(scored) == len(rows)
    assert {r["doc_id"]: r["cost"] for r in scored} == pytest.approx({i: cost(t) for i, t, _ in rows}, rel=1e-5)


def test_pairs_are_dealt_in_few_bytes():
    rng = random.Random(31)
    texts = [sentence(rng, rng.randrange(1, 900), 3000) for _ in range(300)] + ["", " ", "a", "a a a a", None]
    batch = pa.RecordBatch.from_arrays([
        pa.array([1000 + i for i in range(len(texts))]), pa.array([i % 3 for i in range(len(texts))], pa.int32()),
        pa.array([quality_lm.BOTH if i % 3 else quality_lm.SCORE for i in range(len(texts))], pa.int32()), pa.array(texts)],
        ["tag", "model", "kind", "text"])
    hasher = quality_lm.W.Hasher(31)
    (block,) = quality_lm.W.blocks(pa.array(texts), quality_lm.W.SPACES)
    words = iter((hasher.words(block) >> np.uint64(8)).tolist())
    want = Counter()
    for i, text in enumerate(texts):
        own = [quality_lm.MARK, *[next(words) for _ in plain.words(text or "")], quality_lm.MARK]
        want.update((1000 + i, i % 3, v, w) for v, w in zip(own, own[1:]) if len(own) > 2)
    got, size = Counter(), 0
    for out in quality_lm._deal(5)([batch]):
        for shard, kind, *dealt in zip(*[c.to_pylist() for c in out.columns]):
            p = quality_lm._Pairs(*dealt)
            assert all(w % 5 == shard for w in p.followers.tolist()) and (kind == quality_lm.BOTH) == bool(p.models.any())
            for r, x, y, n in zip(p.row, p.x, p.y, p.n):
                got[int(p.tags[r]), int(p.models[r]), int(p.contexts[y]), int(p.followers[x])] += int(n)
            size += sum(len(d) for d in dealt)
    assert got == want
    assert size < 5 * sum(want.values())  # a row of key, text and count took 20


def test_classifier_sees_words_and_rejects_the_too_predictable(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30)]
    follows = {w: rng.sample(words, 6) for w in words}

    def text():
        own = [rng.choice(words)]
        while len(own) < 80:
            own += rng.choices(follows[own[-1]], (6, 3, 2, 2, 1, 1))
        return " ".join(own)
    rows = [(i, text(), "en") for i in range(300)]
    rows += [(1000 + i, " ".join(rng.choice(words) for _ in range(80)), "en") for i in range(10)]     # known words in no order
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = quality_lm.Classifier(docs, docs.where("doc_id < 200").select("doc_id"))
    got = {r["doc_id"]: r for r in model.judged(docs).collect()}
    assert sum(got[i]["kept"] for i in range(200, 300)) >= 97 and not any(got[i]["kept"] for i in range(1000, 1010))
    assert all(r["kept"] == (r["low_threshold"] <= r["perplexity"] <= r["threshold"]) for r in got.values())
    pairs = Counter(p for r in rows[:200] for p in zip(r[1].split(), r[1].split()[1:]))
    chain = [max(pairs, key=pairs.get)[0]]
    while len(chain) < 400:  # always the most frequent follower: a short loop
        chain.append(max(follows[chain[-1]], key=lambda w: pairs[chain[-1], w]))
    loop = spark.createDataFrame([(1, " ".join(chain), "en")], "doc_id long, text string, lang string")
    row = model.judged(loop).first()
    assert row["perplexity"] < row["low_threshold"] and not row["kept"] and model.keep(loop).count() == 0


def test_classifier_on_odd_rows(spark, odd, odd_rows, empty):
    trusted = spark.createDataFrame([(i,) for i in (*range(20), 5, 999, None)], "doc_id long")
    model = quality_lm.Classifier(odd, trusted)
    rows = model.judged(odd).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert (r["perplexity"] is None) == (r["n_symbols"] == 0) and not (r["perplexity"] is None and r["kept"])
        if r["perplexity"] is not None and r["doc_id"] not in (401, 402):
            assert r["kept"] == (r["perplexity"] <= r["threshold"] * (1 + 1e-12))
    kept = model.keep(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in rows)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in rows if r["kept"])
    none = quality_lm.Classifier(odd, trusted.where("false"))
    assert none.keep(odd).count() == sum(bool(r[1]) for r in odd_rows)
    assert quality_lm.Classifier(empty, trusted).judged(empty).count() == 0


def test_classifier_separates_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_lm.Classifier(docs, labels.where("quality = 1 and doc_id % 2 = 0").select("doc_id"))
    rows = model.judged(docs).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1]) > 0.98
    assert np.mean([r["kept"] for r in rows if r["quality"] == 0]) < 0.15


# --- near-dedup

def test_fingerprints_and_components(spark, odd, odd_rows, empty):
    prints = [(r[0], plain.fingerprint(r[1])) for r in odd_rows]
    want = sorted((key(k), p, key(c)) for (k, p), c in zip(prints, plain.components(prints)))
    rows = simhash.grouped(odd).collect()
    assert sorted((key(r["doc_id"]), r["fp"] % 2**64, key(r["component_id"])) for r in rows) == want
    assert simhash.grouped(empty).count() == 0


def near_prints(rng):
    """Chains and clusters of fingerprints at distances round the radius."""
    out = set()
    for _ in range(25):
        now = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            out.add(now)
            for bit in rng.sample(range(64), rng.randrange(1, 7)):
                now ^= 1 << bit
    return sorted(out)


@pytest.mark.parametrize("shard", [2000, 7])
def test_links_span_all_components(spark, shard):
    values = near_prints(random.Random(shard))
    base_print = values[0]
    values = sorted({*values, *(base_print ^ (1 << b) for b in range(40))})  # a bucket of several shards
    nodes = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    links = simhash.links(nodes, shard=shard)
    pairs = [(a % 2**64, b % 2**64) for a, b in links.collect()]
    assert all(0 < (a ^ b).bit_count() <= 4 for a, b in pairs)
    root = {v % 2**64: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = plain.components([(v, v) for v in values])
    assert [find(v) for v in values] == want


def test_bk_tree_follows_edges_within_the_radius():
    rng = random.Random(9)
    values = near_prints(rng)
    links = simhash.shard_links([(v, v) for v in values[::2]], [(v, v) for v in values[1::2]], 4)
    queries = set(values[1::2])
    assert all((a ^ b).bit_count() <= 4 and len(queries & {a, b}) == 1 for a, b in links)


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000 - i, 999 - i) for i in range(40)] + [(500, 2000 + i) for i in range(300)] + [(7, 7)]
    rows = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r["node"]: r["root"] for r in rows}
    assert len(rows) == len(roots) and {roots[i] for i in range(1, 61)} == {0}
    assert {roots[i] for i in range(961, 1001)} == {960} and {roots[2000 + i] for i in range(300)} == {500}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_rows(rng):
    """Texts with near copies round the similarity, in one large group and in small ones."""
    rows = []
    for group in range(40):
        own = sentence(rng, rng.randrange(30, 200), 50_000).split()
        for _ in range(60 if group == 0 else rng.randrange(1, 5)):
            copy = list(own)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.1 else " ".join(copy)))
    return rows + [(5000, ""), (5001, None), (5002, " \n"), (5003, "one two"), (5004, "One TWO"), (5005, "one two three four five"), (None, "lonely text")]


def groups_of(rows, similarity=0.8):
    return plain.near_groups([plain.words(r[1], lower=True) for r in rows], 5, similarity)


@pytest.mark.parametrize("shard", [2000, 9])
def test_similar_texts_share_a_root(spark, shard):
    rows = near_rows(random.Random(shard))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["root"] for r in simhash.similar(docs, shard=shard).collect()}
    want = groups_of(rows)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if want[i] == want[j]]
    found = sum(got[rows[i][0]] == got[rows[j][0]] for i, j in pairs)
    assert found >= 0.98 * len(pairs) > 100  # bands are chance
    wrong = [(i, j) for i in range(len(rows)) for j in range(i) if want[i] != want[j] and got[rows[i][0]] == got[rows[j][0]]]
    assert not wrong


def test_keep_one(spark, odd, odd_rows, empty):
    root = groups_of(odd_rows)
    best = {}
    for (key_, text, *_), r in zip(odd_rows, root):
        best[r] = min(best.get(r, (True, 0)), (key_ is None, key_ or 0))
    ids = [r["doc_id"] for r in simhash.keep_one(odd).collect()]
    assert sorted(map(key, ids)) == sorted(-1 if missing else k for missing, k in best.values())
    assert simhash.keep_one(odd).columns == odd.columns and simhash.keep_one(empty).count() == 0


# --- decontamination

ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short item"), (3, ""), (4, None), (5, "solo"),
         (6, "one two three four five six seven eight nine ten"), (7, "a a a a a a a a a a a a"), (None, "two words here"), (10, "Short-item!")]
TEXTS = ["x one two three four five six seven eight nine ten eleven y", "ONE, two three four five six seven eight nine", "short short item item",
         "a " * 30, "a " * 9, "", None, "solo SOLO so lo", "two words; here two\nwords here", "one two three four five six seven eight nine ten " * 3,
         "three four five six seven eight nine ten eleven twelve thirteen", "nothing"]


@pytest.mark.parametrize("block_bytes", [16_000_000, 40])
def test_decontamination_against_brute_force(spark, block_bytes):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.judged(docs, items, block_bytes=block_bytes).collect()}
    for i, want in enumerate(plain.decontaminated(TEXTS, ITEMS)):
        got = rows[i]
        assert (got["n_words"], sum(s["b"] - s["a"] for s in got["spans"]), len(got["items"]), plain.sha(",".join(got["items"]))) == want
    clean = decontaminate.clean(docs, items, block_bytes=block_bytes)
    assert sorted(r["doc_id"] for r in clean.collect()) == [i for i, w in enumerate(plain.decontaminated(TEXTS, ITEMS)) if not w[1]]


def test_longest_matches_and_places(spark):
    docs = spark.createDataFrame([(1, "x y " + ITEMS[0][1] + " z"), (2, TEXTS[10])], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    rows = sorted(tuple(r) for r in decontaminate.matches(docs, items).collect())
    assert rows == [(1, "1", 2, 0, 12), (2, "1", 0, 2, 10)]


def test_suffix_array():
    rng = random.Random(4)
    text = [rng.randint(0, 3) for _ in range(200)] + [0] * 10
    places = decontaminate.suffix_array(np.array(text), 10).tolist()
    assert sorted(places) == list(range(200))
    assert all(text[a:a + 10] <= text[b:b + 10] for a, b in zip(places, places[1:]))


def test_decontamination_of_odd_rows(spark, odd, odd_rows, empty):
    items = [(i, " ".join(plain.words(odd_rows[k][1])[:n])) for i, (k, n) in enumerate([(0, 12), (3, 30), (41, 40), (50, 3)])]
    benchmark = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, spans string")
    want = plain.decontaminated([r[1] for r in odd_rows], items)
    rows = decontaminate.judged(odd, benchmark).collect()
    assert sorted((key(r["doc_id"]), r["n_words"], len(r["items"])) for r in rows) == sorted(
        (key(r[0]), w[0], w[2]) for r, w in zip(odd_rows, want))
    assert decontaminate.clean(odd, benchmark).columns == odd.columns
    assert decontaminate.judged(empty, benchmark).count() == 0
    assert decontaminate.clean(odd, benchmark.where("false")).count() == len(odd_rows)


# --- mixing

def shares(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        level = (total - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in order}
        full |= set(over)


def test_mixing_of_odd_rows(spark, odd, odd_rows, empty):
    sizes = Counter()
    for r in odd_rows:
        sizes[r[3]] += len(plain.words(r[1]))
    want = shares(sizes)
    out, (size, source_size, target, copies) = mixing.mixed(odd)
    rows = out.collect()
    assert len(rows) == len(odd_rows) and sorted(out.columns[:len(odd.columns)]) == sorted(odd.columns)
    taken = Counter()
    for r in rows:
        assert r[size] == len(plain.words(r["text"])) and r[source_size] == sizes[r["source"]]
        assert r[target] == pytest.approx(want[r["source"]]) and 0 <= r[copies] <= 3
        taken[r["source"]] += r[size] * r[copies]
    for source, goal in want.items():
        largest = max((len(plain.words(r[1])) for r in odd_rows if r[3] == source), default=0)
        assert abs(taken[source] - goal) <= largest
    again = mixing.mixed(odd)[0].collect()
    assert Counter((r["doc_id"], r[copies]) for r in again) == Counter((r["doc_id"], r[copies]) for r in rows)
    assert mixing.take(odd).count() == sum(r[copies] for r in rows if r[size])
    assert mixing.take(odd).columns == odd.columns and mixing.mixed(empty)[0].count() == 0


def test_targets_of_full_sources(spark):
    sizes = {f"s{i}": n for i, n in enumerate([1, 1000, 10, 7, 90_000, 4, 0])}
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r["source"]: r["target"] for r in rows} == pytest.approx(shares(sizes))


def test_budgets_are_fitted_exactly_where_they_can_be():
    rng = random.Random(8)
    for _ in range(200):
        counts = sorted(Counter(rng.randrange(0, 40) for _ in range(rng.randrange(1, 30))).items())
        total = sum(s * n for s, n in counts)
        budget = rng.randrange(0, total + 2)
        take = mixing.fit_budget(counts, budget, total, fit_words=1000)
        assert all(0 <= take.get(s, 0) <= n for s, n in counts)
        got = sum(s * n for s, n in take.items())
        given = {s: n * budget // total for s, n in counts if s} if total else {}
        reach = {sum(s * n for s, n in given.items())}
        for s, n in counts:
            for _ in range(n - given.get(s, 0) if s else 0):
                reach |= {r + s for r in reach}
        assert got == max(r for r in reach if r <= budget) or budget >= total


# --- sharding

def test_hilbert_curve_visits_neighbours(spark):
    cube = spark.range(512).selectExpr("id % 8 AS a", "id div 8 % 8 AS b", "id div 64 AS c")
    rows = sorted(sharding.hilbert_index(cube, ["a", "b", "c"], 3, "at").collect(), key=lambda r: r["at"])
    assert [r["at"] for r in rows] == list(range(512))
    assert all(sum(abs(x[k] - y[k]) for k in "abc") == 1 for x, y in zip(rows, rows[1:]))


@pytest.mark.parametrize("shards", [40, 7, 500])
def test_sharding_of_odd_rows(spark, odd, odd_rows, empty, shards):
    out, (size, curve, shard, slot) = sharding.sharded(odd, shards=shards)
    rows = out.collect()
    assert sorted(key(r["doc_id"]) for r in rows) == sorted(key(r[0]) for r in odd_rows)
    assert all(r[size] == len((r["text"] or "").encode()) + 16 for r in rows)
    counts = Counter(r[shard] for r in rows)
    assert max(counts.values()) - min(counts[s] for s in range(shards)) <= 1 and set(counts) <= set(range(shards))
    for s, n in counts.items():
        assert sorted(r[slot] for r in rows if r[shard] == s) == list(range(n))
    ends = sorted((r[shard], r[slot], r[curve]) for r in rows)
    assert all(a[2] <= b[2] for a, b in zip(ends, ends[1:]))
    assert sharding.sharded(empty)[0].count() == 0


def test_sharding_query(spark):
    from palisade.llm.queries import QUERIES
    rows = QUERIES["op6_sharding"](spark, "/root/testdata/sf0.001").collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) and r["law"] == "rows" for r in rows)


# --- substring dedup

def dedup_rows(spark, rows, length=20, **settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return sorted((key(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"])
                  for r in substring_dedup.remove_repeats(docs, length, **settings).collect())


def test_substring_dedup_of_odd_rows(spark, odd, odd_rows, empty):
    rows = [(r[0], r[1]) for r in odd_rows]
    # Of rows with null ids, the order is by text hash; here no two of them share a window.
    want = plain.deduplicated(sorted(set(rows), key=str))
    got = sorted((key(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(odd).collect())
    assert got == sorted((key(r[0]), *want[r]) for r in rows)
    assert substring_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("map_bits", [28, 16])
def test_substring_dedup_against_brute_force(spark, map_bits, monkeypatch):
    rng = random.Random(6)
    rows = [(i, sentence(rng, rng.randrange(1, 60), 3)) for i in range(150)] + [(200, "a " * 100), (201, "a " * 50 + "b " + "a " * 19)]
    want = plain.deduplicated(rows, 12)
    assert dedup_rows(spark, rows, 12, seed=5, map_bits=map_bits) == sorted((r[0], *want[r]) for r in rows)


def test_maximal_repeats(spark):
    rng = random.Random(7)
    passage = sentence(rng, 50, 10_000)
    rows = [(1, passage), (2, f"x y {passage} z"), (3, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [tuple(r) for r in substring_dedup.maximal_repeats(docs).collect()] == [(2, 2, 50)]


# --- pipeline

def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = base.table(spark, sf, "documents")
    items = [(r["item_id"], r["text"]) for r in base.table(spark, sf, "benchmark").collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = base.written(stage(spark, docs, sf), name)
        ids = Counter(r["doc_id"] for r in out.collect())
        if name == "simhash_near_dedup":
            root = groups_of([(r["doc_id"], r["text"]) for r in before])
            best = {}
            for r, own in zip(before, root):
                best[own] = min(best.get(own, r["doc_id"]), r["doc_id"])
            assert ids == Counter(best.values()) and len(ids) < len(before)
        elif name == "benchmark_decontamination":
            hit = plain.decontaminated([r["text"] for r in before], items)
            assert ids == Counter(r["doc_id"] for r, h in zip(before, hit) if not h[1]) and sum(h[1] > 0 for h in hit)
        elif name == "source_mixing":
            assert max(ids.values()) <= 3 and set(ids) <= {r["doc_id"] for r in before}
        elif name == "sharding":
            assert ids == Counter(r["doc_id"] for r in before)
        else:
            assert 0 < len(ids) < len(before)
        assert out.columns[:5] == docs.columns[:5] and (name == "sharding" or out.columns == docs.columns)
        docs = out


def test_stages_on_empty_and_odd_tables(spark, odd, empty):
    sf = "/root/testdata/sf0.001"
    for docs in (empty, odd.select("doc_id", "text", "lang", "source", F.lit(1).cast("long").alias("n_chars"), "size", "_hash")):
        for _, stage in corpus_pipeline.STAGES:
            docs = base.written(stage(spark, docs, sf), "stage")
        assert "shard" in docs.columns
