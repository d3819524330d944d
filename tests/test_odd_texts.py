"""Registered queries beside their SQL on documents that the given tables do not have: empty and missing texts."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import TABLES, compare, connect

SF = "/root/testdata/sf0.001"
TEXTS = ("", None, "plain words", "café über España", " \n ")
LANGS = ("en", "fr", "de", "es", None)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, TEXTS[i % 5], LANGS[i // 5 % 5], "web", 0) for i in range(25 * 11)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").toPandas().to_parquet(f"{where}/documents.parquet")
    for name in TABLES:
        if name != "documents":
            os.symlink(f"{SF}/{name}.parquet", f"{where}/{name}.parquet")
    return where


@pytest.mark.parametrize("name", ["src_encoding_profile", "agg_corpus", "enc_low_confidence", "enc_non_utf8"])
def test_empty_and_missing_texts(spark, odd, name):
    ok, message = compare(spark, connect(odd), odd, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message
