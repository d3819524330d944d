"""License scan, URL filter, token counts and quality rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import base, licenses, quality_rules, token_counts, url_filter, words as W
from tests.llm import plain


def test_automaton_against_all_runs():
    rng = random.Random(3)
    for _ in range(60):
        sequences = [[rng.randint(1, 3) for _ in range(rng.randint(1, 7))] for _ in range(rng.randint(1, 4))]
        auto, text = licenses.Automaton(sequences), [rng.randint(1, 4) for _ in range(25)]
        runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        for i, (state, length) in enumerate(auto.statistics(text)):
            assert length == max(k for k in range(i + 2) if not k or tuple(text[i + 1 - k:i + 1]) in runs)
            if length:
                assert auto.ends[state] == sorted((n, e) for n, s in enumerate(sequences) for e in range(length - 1, len(s))
                                                  if s[e + 1 - length:e + 1] == text[i + 1 - length:i + 1])


def licensed(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in licenses.scanned(docs).collect()}


def test_licenses_against_brute_force(spark):
    notices = ["MIT License", "the GNU General Public License, GNU general-public LICENSE", "gnu general public", "CC BY CC BY-NC 4.0",
               "apache license\nApache License", "", None, "mit\nlicense mitlicense mit license"]
    texts = notices + [" x ".join(map(str, notices)), "the of " * 5000 + "mit license"]
    rows = licensed(spark, texts)
    for i, text in enumerate(texts):
        got = rows[i]
        labels = ",".join(sorted({b["label"] for b in got["bases"]}))
        starts = [b["start"] for b in got["bases"]]
        assert (got["n_words"], len(starts), min(starts, default=None), max(starts, default=None), labels) == plain.phrases(
            text, licenses.PHRASES)


def test_licenses_on_odd_rows(odd, odd_rows, empty):
    """Columns of clashing names, nulls, repeated rows, very long texts, an empty table."""
    def row(key, text):
        n, _, first, last, labels = plain.phrases(text, licenses.PHRASES)
        return repr((key, n, first, last, labels))
    got = [repr((r["doc_id"], r["n_words"], min((b["start"] for b in r["bases"]), default=None), max((b["start"] for b in r["bases"]), default=None),
                 ",".join(sorted({b["label"] for b in r["bases"]})))) for r in licenses.scanned(odd).collect()]
    assert sorted(got) == sorted(row(key, text) for key, text, _, _ in odd_rows)
    assert licenses.scanned(empty).collect() == []


def test_template_spans(spark):
    template = next(t for t, label in licenses.TEMPLATES if label == "mit-text")
    own = template.split()
    broken = own[:20] + ["really"] + own[20:]
    rows = licensed(spark, ["foo bar " + template + " baz", "foo " + " ".join(broken), " ".join(own[:12]), "plain words of the software"])
    spans = [{s["label"]: s for s in rows[i]["spans"]} for i in range(4)]
    assert spans[0]["mit-text"]["start"] == 2 and spans[0]["mit-text"]["share"] == 1.0
    assert spans[1]["mit-text"]["share"] > 0.9 and spans[1]["mit-text"]["n_words"] == len(own) + 1
    assert "mit-text" not in spans[2] and not spans[3]


def test_url_parts_and_rules(spark):
    urls = ["https://WWW.Example.org/es/1?x=1", "http://example.org", "https://a.example.org/en/12#t", "x://h.com/de/?q", "com/de/", None, "",
            "https://notcom/fr/1", "https://com/fr/1", "HTTP://A.COM/fr/?a&b#c?d/e", "://x.org/", "a://b://c.org/", "https://example.org/en/2",
            "http://ÄB.com/de/\n/x", "https://evilexample.org/es/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rows = {r["page_id"]: r for r in url_filter.judged(pages, trees=2).collect()}
    for i, url in enumerate(urls):
        host, path = plain.url_parts(url)
        rule, says = plain.fitting(host, path, url_filter.RULES)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule)
        assert rows[i]["verdict"] in (("allow", "block") if says is None else (says,))


def test_url_filter_without_labels(spark):
    schema = "page_id long, url string"
    assert url_filter.judged(spark.createDataFrame([], schema)).count() == 0
    rows = url_filter.judged(spark.createDataFrame([(1, "http://x.net/a"), (1, "http://x.net/a"), (None, None)], schema)).collect()
    assert [r["verdict"] for r in rows] == ["allow"] * 3


def test_url_trees_learn_the_labels(spark):
    rules = (("block", "bad.net/"), ("allow", "good.net/"))
    urls = [f"http://h{i}.bad.net/p?a={i}&b={i}&c=7{i}" if i % 2 else f"http://h{i}.good.net/page" for i in range(200)]
    more = ["http://z.other.net/q?a=1&b=2&c=345", "http://z.other.net/page"]
    pages = spark.createDataFrame(list(enumerate(urls + more)), "page_id long, url string")
    rows = {r["page_id"]: r["verdict"] for r in url_filter.judged(pages, rules, trees=3).collect()}
    assert (rows[200], rows[201]) == ("block", "allow")


def test_url_entropy(spark):
    row = spark.createDataFrame([("aabb",), ("",), ("aaaa",)], "u string").select(url_filter.entropy(F.col("u"))).collect()
    assert [r[0] for r in row] == pytest.approx([1.0, 0.0, 0.0])


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = str(public.path("byte_bpe_50k.json"))
    return path, Tokenizer.from_file(path)


def test_token_counts(spark, odd, odd_rows, empty, tokenizer, monkeypatch):
    path, library = tokenizer
    rows = odd_rows + [(600, "<|endoftext|> in a text", "en", "a")]
    docs = odd.unionByName(spark.createDataFrame(rows[-1:], "doc_id long, text string, lang string, source string"), True)
    cache = base.scratch(spark, "cache")
    want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False)))
                  for r in rows)
    for _ in range(2):  # filled, then answered from the cache
        got = token_counts.counted(docs, path, cache).collect()
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
        stored = spark.read.parquet(cache)
        assert stored.count() == len({r[1] or "" for r in rows})
    assert token_counts.counted(empty, path, base.scratch(spark, "cache")).count() == 0


def test_cache_is_per_version(spark, tokenizer):
    cache = base.scratch(spark, "cache")
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    token_counts.append_misses(docs, cache, tokenizer[0])
    assert token_counts.read_cache(spark, cache, token_counts.tokenizer_version(tokenizer[0])).count() == 1
    assert token_counts.read_cache(spark, cache, "another").count() == 0


def test_quality_counts(spark, odd, odd_rows):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (999, 1)], "doc_id long, label int")
    got = quality_rules.judged(odd, labels).collect()
    have = sorted((r["doc_id"] if r["doc_id"] is not None else -1, *[r[c] for c in quality_rules.COUNTS]) for r in got)
    assert have == sorted((r[0] if r[0] is not None else -1, *plain.rule_counts(r[1])) for r in odd_rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_quality_counts_of_lines_and_symbols(spark, empty):
    text = "a b\na b\n\n \n a b\na b\r\n#|x<>\n#|x<>"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, label int")
    (row,) = quality_rules.judged(docs, labels).collect()
    assert tuple(row[c] for c in quality_rules.COUNTS) == plain.rule_counts(text) and row["n_dup_lines"] == 2
    assert quality_rules.judged(empty, labels).count() == 0


def test_quality_model_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.select("doc_id", F.col("quality").alias("label"))
    seen, unseen = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    rows = quality_rules.judged(docs, seen).join(unseen, "doc_id").where("not base_failed").collect()
    good = [r["kept"] == bool(r["label"]) for r in rows]
    assert len(good) > 100 and np.mean(good) > 0.97
    off = np.mean([r["p_good"] for r in rows]) - np.mean([r["label"] for r in rows])
    assert abs(off) < 0.05  # calibrated


def test_words_of_blocks():
    import pyarrow as pa
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB9 \t\n.é中") for _ in range(rng.randrange(30))) for _ in range(200)] + ["", None]
    for separators, pattern, lower in ((W.SPACES, plain.SPACE_WORDS, False), (W.NON_WORD, plain.LETTER_WORDS, True)):
        found = []
        for block in W.blocks(pa.array(texts), separators, lower, block_bytes=100):
            for i in range(len(block)):
                found.append([block.word(k).decode() for k in range(block.first[i], block.first[i + 1])])
        assert found == [plain.words(t, pattern, lower) for t in texts]
