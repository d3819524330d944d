"""Encoding against the tokenizer's own library, decoding as an exact round trip."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from palisade.llm import byte_bpe, queries
from tests.llm.plain import sha

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(None, PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec(spark):
    return byte_bpe.Codec(spark, PATH, PATTERN)


def test_the_hash_is_perfect_and_minimal(ranks):
    v = byte_bpe.Vocabulary(ranks)
    slots = v.perfect.slots(v._hashes(v.tokens))
    assert sorted(slots.tolist()) == list(range(len(ranks)))
    import pyarrow as pa
    tokens = list(ranks)[::97] + [b"no such token", b"\xff\xfe\xfd", b""]
    assert v.whole(pa.array(tokens)).tolist() == [ranks.get(t, -1) for t in tokens]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000])
def test_hashes_of_few_keys(n):
    hashes = np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64)
    assert sorted(byte_bpe.PerfectHash(hashes).slots(hashes).tolist()) == list(range(n))


def test_merges_follow_rank_then_place(ranks, library):
    rng = random.Random(3)
    for letters in ("ab", "aaa", "étüñ", "中文字🙂x", "the ion"):
        for n in (1, 2, 3, 8, 40, 900):
            piece = "".join(rng.choice(letters) for _ in range(n)).encode()
            assert byte_bpe.merge(piece, ranks) == library._core_bpe.encode_single_piece(piece)


@pytest.mark.parametrize("memory", [3, 20, 1000])
def test_what_is_remembered_changes_nothing(memory, ranks, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMORY", memory)
    v = byte_bpe.Vocabulary(ranks)
    for most in (1, 11, 40, 40, 3):  # pieces known and new, side by side
        pieces = [f"zqx{i * i % most}vj" for i in range(60)] + [" the"]
        ids, n = v.encode(pieces)
        assert ids.tolist() == [i for p in pieces for i in library._core_bpe.encode_single_piece(p.encode())] and n.sum() == len(ids)


def test_odd_rows(odd, odd_rows, codec, library):
    got = sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in codec.round_trip(odd).collect()), key=repr)
    want = sorted(((d, library.encode_ordinary(t or ""), (t or "").encode()) for d, t, _, _ in odd_rows), key=repr)
    assert got == want


def test_pieces_of_a_long_text_in_runs(spark, codec, library, monkeypatch):
    text = " ".join(f"wörd{i}" for i in range(2000)) + " " * 50 + "\n\n end" + "q" * 3000
    vocabulary = codec.shared.value
    monkeypatch.setattr(byte_bpe, "PIECES", 7)
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])
    (out,) = byte_bpe._encode(type("B", (), {"value": vocabulary}), PATTERN)([batch])
    assert out.column(1).to_pylist() == [library.encode_ordinary(text)]


def test_special_strings_are_ordinary_text_and_ids_may_be_text(spark, codec, library):
    docs = spark.createDataFrame([("a", "<|endoftext|> x"), (None, "'s 're don't  \n 12３")], "doc_id string, text string")
    rows = {r["doc_id"]: r["ids"] for r in codec.encoded(docs).collect()}
    assert rows == {"a": library.encode_ordinary("<|endoftext|> x"), None: library.encode_ordinary("'s 're don't  \n 12３")}


def test_empty_table_and_null_ids(spark, empty, codec):
    assert codec.decoded(codec.encoded(empty)).collect() == []
    (row,) = codec.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()
    assert bytes(row["decoded"]) == b""


def test_query(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op13_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r["doc_id"]]))
