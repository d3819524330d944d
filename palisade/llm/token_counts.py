"""Token counts behind a digest cache.

The key is the SHA-256 of the normalised content together with the digest of the tokenizer file, so counts of one
tokenizer version never answer for another.  Normalising maps null to the empty text and nothing else: every other
change could change the count.

Digests of all documents are matched with the cache (a join of digests and counts); what it doesn't hold is encoded
once per different text, and appended.  A task passes on only the first copy it meets of a text, so a text with very many
copies reaches its shuffle partition once per task.  Where the tokenizer encodes the pieces that it cuts a text into each for itself,
a worker has the library encode a piece once and remembers its count.  A run that fails before its append leaves the cache as it was.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.llm import base

BATCH = 64
#: Characters of texts that are cut here, and how many they may have; all other texts are left to the library whole.
PLAIN, LONGEST = "\t\n\r\x20-\x7e\xa0-\u024f", 100_000
#: Pieces that a worker remembers (some 150 MB), and that it has encoded at once.
REMEMBERED, AT_ONCE = 1_000_000, 4096
#: The library's byte-level cut on these characters; the digits that ``\w`` has and ``\d`` has not are spelled out.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_²³¹¼½¾]+| ?[\d²³¹¼½¾]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
CACHE = "digest binary, version string, n_tokens long"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _first_copies(batches):
    """Drops texts that this task has passed on already; holds 16 bytes for each of its texts."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for d in batch.column(0).to_pylist():
            keep.append(d[:16] not in seen)
            seen.add(d[:16])
        yield batch.filter(pa.array(keep, pa.bool_()))


class _Pieces(dict):
    """Token counts by piece; pieces that it does not hold count 0 and are listed."""

    def __missing__(self, piece):
        self.missing.append(piece)
        return 0


class Counter:
    """Token counts of texts by the library, each different piece of plain texts encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.by_pieces = (spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space")
                          and cut.get("use_regex", True) and model.get("type") == "BPE" and not model.get("dropout"))
        added = [re.escape(t["content"]) for t in spec.get("added_tokens") or ()]
        self.other = re.compile("|".join([f"[^{PLAIN}]", *added]))
        self.pieces = _Pieces()

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        out, whole, late = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            if not self.by_pieces or len(text) > LONGEST or self.other.search(text):
                whole.append(i)
                continue
            self.pieces.missing = []
            out[i] = sum(map(self.pieces.__getitem__, PIECES.findall(text)))
            if self.pieces.missing:
                late.append((i, self.pieces.missing))
        new, found = list({piece for _, missing in late for piece in missing}), {}
        for at in range(0, len(new), AT_ONCE):
            part = new[at:at + AT_ONCE]
            found.update(zip(part, self.encoded(part)))
        for i, missing in late:
            out[i] += sum(map(found.__getitem__, missing))
        if len(self.pieces) + len(found) <= REMEMBERED:
            self.pieces.update(found)
        for i, n in zip(whole, self.encoded([texts[i] for i in whole])):
            out[i] = n
        return out


def _encode(path: str, shared):
    def encode(batches):
        held = shared.value  # a worker's own, kept from task to task
        if "counter" not in held:
            held["counter"] = Counter(path)
        last = None
        for batch in batches:
            digests, texts = batch.column(0).to_pylist(), batch.column(1)
            new = [i for i, d in enumerate(digests) if d != (digests[i - 1] if i else last)]  # sorted by digest
            last = digests[-1] if digests else last
            counts = []
            for at in range(0, len(new), BATCH):
                counts += held["counter"].counts(texts.take(pa.array(new[at:at + BATCH])).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([digests[i] for i in new], pa.binary()), pa.array(counts, pa.int64())], ["digest", "n_tokens"])
    return encode


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; empty where nothing was stored yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    return spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version).groupBy("digest").agg(
        F.max("n_tokens").alias("n_tokens"))


def append_misses(docs: DataFrame, cache: str, tokenizer: str) -> None:
    """Encode each text of which the cache has no count, once, and store the counts."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(digest(text).alias("digest"), text.alias("text")).mapInArrow(
        _first_copies, "digest binary, text string")
    misses = rows.join(read_cache(spark, cache, version).select("digest"), "digest", "left_anti")
    encoded = misses.repartition("digest").sortWithinPartitions("digest").mapInArrow(
        _encode(tokenizer, spark.sparkContext.broadcast({})), "digest binary, n_tokens long")
    encoded.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)


def counted(docs: DataFrame, tokenizer: str, cache: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    Only ``doc_id`` and ``text`` are read.  A null text counts as the empty one (0 bytes, 0 tokens).  Equal texts get
    one count; special strings in a text are handled as the library does by default; nothing is truncated or padded.  An empty table gives an empty one.
    The tokenizer's path must be readable on every executor.
    """
    own = base.only(docs, "doc_id", "text")
    append_misses(own, cache, tokenizer)
    # Written, so that no aggregate stands between its shuffle and the join: Spark can then split a digest of many rows.
    stored = base.written(read_cache(docs.sparkSession, cache, tokenizer_version(tokenizer)), "stored")
    keyed = own.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                       digest(F.col("text")).alias("digest"))
    return keyed.join(stored, "digest", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7(spark, sf_dir):
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    return counted(base.table(spark, sf_dir, "documents"), path, base.scratch(spark, "token-cache"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
