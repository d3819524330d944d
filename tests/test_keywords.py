"""Keyword tables against a plain search, with the whole automaton and with leads alone."""

import random

import pytest

from palisade.operators import keywords as K


def plain(texts, words):
    out = []
    for key, text in texts:
        low = (text or "").lower()
        for word in {w for w in words if w and w.strip()}:
            at = [i for i in range(len(low)) if low.startswith(word.lower(), i)]
            if at:
                out.append((key, word, at[0], len(at)))
    return sorted(out)


def found(spark, texts, words, **settings):
    pages = spark.createDataFrame([(k, 1, t, "x") for k, t in texts], "doc_id long, page_num int, text string, keyword string")
    hits = K.find_keywords(pages, spark.createDataFrame([(w,) for w in words], "keyword string"), **settings)
    assert "NestedLoop" not in hits._jdf.queryExecution().toString() and "CartesianProduct" not in hits._jdf.queryExecution().toString()
    return sorted((r["doc_id"], r["keyword"], r["start"], r["n"]) for r in hits.collect())


@pytest.mark.parametrize("max_chars", [2_000_000, 40, 1])
def test_against_a_plain_search(spark, max_chars):
    texts = [(1, "Alphabet and beta gamxma"), (2, "GAM.MA alpha ALPHA aaaa"), (3, None), (4, ""), (5, "Ünder 中文 🙂 straße, alpha beta"),
             (6, "alpha beta " * 300 + "x" * 5000)]
    words = ["alpha", "BETA", " ", "", None, "alpha", "gam.ma", "a", "aa", "Alpha Beta", "alphabet", "ALPHA", "中文 🙂", "straße", "nowhere", "z" * 60]
    assert found(spark, texts, words, max_chars=max_chars) == plain(texts, words)


def test_random_words(spark):
    rnd = random.Random(1)
    texts = [(i, "".join(rnd.choice("abcAB ") for _ in range(rnd.randrange(300)))) for i in range(40)]
    words = ["".join(rnd.choice("abc ") for _ in range(rnd.randrange(1, 9))) for _ in range(300)]
    want = plain(texts, words)
    assert found(spark, texts, words) == found(spark, texts, words, max_chars=100) == want


def test_no_keywords_and_no_pages(spark):
    assert found(spark, [(1, "a")], [None, " "]) == [] and found(spark, [], ["a"]) == []


def test_a_hundred_thousand_keywords(spark):
    """Numbers written out: exactly those that a text holds are found."""
    words = [f"code {i:06d};" for i in range(100_000)]
    rnd = random.Random(2)
    held = {k: sorted(rnd.sample(range(100_000), 30)) for k in range(20)}
    texts = [(k, " ".join(f"Code {i:06d};" for i in own)) for k, own in held.items()]
    got = found(spark, texts, words)
    assert [(d, w) for d, w, _, _ in got] == sorted((k, f"code {i:06d};") for k, own in held.items() for i in own)
    assert found(spark, texts, words, max_chars=5000) == got


def test_many_keywords_under_one_lead_in_little_memory(spark, monkeypatch):
    """Neither a lead that many keywords share nor a text full of it makes rows of pairs; pieces of texts meet."""
    texts = [(k, "the same beginning of all " * 40 + f"the same beginning of all keywords {k:04d} " * 3) for k in range(20)]
    words = [f"the same beginning of all keywords {k:04d}" for k in range(300)] + ["the same beginning of all", "beginning of all keywords 0003 the same b"]
    monkeypatch.setattr(K, "PIECE", 100)
    monkeypatch.setattr(K, "ROWS", 7)
    plain_finder = K._finder

    def watched(search):
        def counted(text):
            rows = list(search(text))
            assert len(rows) <= 3, len(rows)
            return rows
        return plain_finder(counted)
    monkeypatch.setattr(K, "_finder", watched)
    assert found(spark, texts, words, max_chars=500) == plain(texts, words)


def test_more_keywords_than_one_map_holds(spark, monkeypatch):
    """Keywords go to several maps, and few places that hold none pass."""
    rnd = random.Random(5)

    def letters(n):
        return "".join(rnd.choice("abcdefgh ") for _ in range(n))
    words = [letters(rnd.choice((16, 16, 16, 20))) for _ in range(20_000)]
    held = {k: sorted(rnd.sample(range(20_000), 9)) for k in range(30)}
    texts = [(k, letters(900).join(["", *(words[i] for i in own), ""])) for k, own in held.items()]
    monkeypatch.setattr(K, "MAP_BITS", (15, 15))
    plain_finder = K._finder

    def watched(search):
        def counted(text):
            rows = list(search(text))
            assert len(rows) <= 0.05 * len(text), (len(rows), len(text))
            return rows
        return plain_finder(counted)
    monkeypatch.setattr(K, "_finder", watched)
    got = found(spark, texts, words, max_chars=1000)
    assert {(d, w) for d, w, _, _ in got} >= {(k, words[i]) for k, own in held.items() for i in own}
    monkeypatch.undo()
    assert got == found(spark, texts, words, max_chars=2_000_000)
