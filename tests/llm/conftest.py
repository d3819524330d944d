import random

import pytest

#: Columns that operators might add themselves.
EXTRA = ["size", "tag", "text_", "key", "root", "copies", "n", "spans", "items", "label", "curve", "shard", "slot", "source_size",
         "target", "passes", "extra", "value", "kept", "rate", "cost", "_size", "_hash", "_span", "row", "digest", "h", "pos"]


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source): repeated and near rows, shared passages, nulls, empty and very long texts."""
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.randrange(1, 120)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]))
            for i in range(40)]
    passage, common = sentence(rng, 60), sentence(rng, 25)
    rows += [(100 + i, f"{sentence(rng, 15)} {passage}\n{common} {sentence(rng, 10)}", "en", "hot") for i in range(30)]
    rows += [(200 + i, rows[3][1], "en", "hot") for i in range(25)]                        # exact copies
    rows += [(300 + i, f"{passage} {passage} {i}", "fr", "hot") for i in range(5)]          # repeats inside a text
    rows += [rows[5], rows[5], rows[41], rows[41]]                                         # repeated rows
    rows += [(400, "", "en", "a"), (401, None, "en", "a"), (402, " \n\t ", None, None), (None, rows[3][1], "en", "a"),
             (None, "only here " * 12, None, "b"), (None, None, None, None), (403, "a", "en", ""), (404, "É ß 中文 🙂 é", "xx", "b")]
    rows += [(500, sentence(rng, 60_000, 5000), "en", "hot"), (501, "x" * 400_000, "en", "a"), (502, "y " * 30_000, "de", "b")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The same with columns whose names clash with those that operators add."""
    columns = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame([(*r, *[c.upper() for c in EXTRA]) for r in odd_rows], columns).repartition(7)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
