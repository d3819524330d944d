"""Token counts by pieces against the library on whole texts."""

import json
import random

import pytest

from palisade.llm import token_counts as T

public = pytest.importorskip("public_tokenizers")
PATH = str(public.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def counter():
    return T.Counter(PATH)


def test_plain_texts_are_cut_as_the_library_cuts_them(counter):
    plain = [c for c in map(chr, range(0x250)) if not counter.other.search(c)]
    assert len(plain) > 500
    for c in plain:
        text = f"a{c}b {c}{c}1{c} 's{c}  {c} \n{c}.{c}\n  x{c} _{c}'{c}ll 2{c}{c} \t {c}"
        assert [m.span() for m in T.PIECES.finditer(text)] == [x[1] for x in counter.tokenizer.pre_tokenizer.pre_tokenize_str(text)], repr(c)


def test_counts_are_the_library_s(counter, monkeypatch):
    rnd = random.Random(7)
    bits = ["the", " été", "  ", "\n", " \n\n", "ß", "x1²", "½", "'s", "'ll", "_", "...", " 中文", "🙂", "<|endoftext|>", "\x00", "\x1c", "\x85", "\u2028", "\xa0", " ", "é"]
    texts = ["", "a" * 3000] + ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 40))) for _ in range(400)]
    want = [len(counter.tokenizer.encode(t, add_special_tokens=False)) for t in texts]
    assert counter.counts(texts) == want == counter.counts(texts)
    monkeypatch.setattr(T, "REMEMBERED", 3)
    monkeypatch.setattr(T, "LONGEST", 50)
    monkeypatch.setattr(T, "AT_ONCE", 2)
    fresh = T.Counter(PATH)
    assert fresh.counts(texts) == want and len(fresh.pieces) <= 3


def test_a_piece_is_encoded_once(monkeypatch):
    counter, asked = T.Counter(PATH), []
    plain = counter.encoded
    monkeypatch.setattr(counter, "encoded", lambda texts: asked.extend(texts) or plain(texts))
    for _ in range(3):
        counter.counts(["one two one two", " two three"] * 5)
    assert sorted(asked) == [" one", " three", " two", "one"]


def test_other_tokenizers_see_whole_texts(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = str(tmp_path / "t.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    counter = T.Counter(path)
    texts = ["one two", " one", ""]
    assert counter.counts(texts) == [len(counter.tokenizer.encode(t, add_special_tokens=False)) for t in texts] and not counter.pieces
