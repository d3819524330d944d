"""Names of byte encodings for texts whose encoding is known."""

import pytest

from palisade.sources.pages import byte_encoding

CASES = [
    ("", "ascii", "unknown"), ("plain words", "ascii", "ascii"), ("naïve café, straße", "utf-8", "utf-8"),
    ("naïve café, déjà vu, straße über Öl", "latin-1", "iso-8859-1"), ("„naïve“ – café… 5 €", "cp1252", "windows-1252"),
    ("Съешь ещё этих мягких французских булок, да выпей чаю", "cp1251", "windows-1251"),
    ("Привет", "cp1251", "windows-1251"), ("año", "latin-1", "iso-8859-1"),
]


def test_known_encodings(spark):
    rows = spark.createDataFrame([(i, bytearray(t.encode(e))) for i, (t, e, _) in enumerate(CASES)], "i int, content binary")
    got = {r["i"]: r["p"] for r in rows.select("i", byte_encoding(rows["content"]).alias("p")).collect()}
    assert [got[i]["detected_encoding"] for i in range(len(CASES))] == [name for _, _, name in CASES]
    assert got[0]["encoding_confidence"] == 0 and got[5]["encoding_confidence"] > 0.9 > got[7]["encoding_confidence"] == pytest.approx(0.5)


LATIN = [
    ("Le chat dort bien. " + "\u00e9\u00e9tion " * 40, "latin-1", "iso-8859-1"), ("onon sur le pain avec du lait, on \u00e8\u00ea", "latin-1", "iso-8859-1"),
    ("\u201c Wir haben heute zu viel Zeit. " + "\u00e4\u00df " * 60 + "\u201d", "cp1252", "windows-1252"),
    ("version two of Spark: \u041f\u0440\u0438\u0432\u0435\u0442, \u043c\u0438\u0440, \u043c\u0438\u0440, \u043c\u0438\u0440", "cp1251", "windows-1251"),
]


def test_accents_side_by_side_are_no_cyrillic(spark):
    """Repeated Latin words with two high bytes together, or only one such word among many plain ones."""
    rows = spark.createDataFrame([(i, bytearray(t.encode(e))) for i, (t, e, _) in enumerate(LATIN)], "i int, content binary")
    got = {r["i"]: r["p"] for r in rows.select("i", byte_encoding(rows["content"]).alias("p")).collect()}
    assert [got[i]["detected_encoding"] for i in range(len(LATIN))] == [name for _, _, name in LATIN]
    assert all(p["encoding_confidence"] > 0.3 for p in got.values())


CAPITALS = [
    ("SCHEN\u00c4\u00dc!! \u00dc\u00d6!! BE\u00c4\u00d6!! ENSCH\u00dc!! \u00c4\u00dcCH!! und der f\u00fcr mit zu in", "latin-1", "iso-8859-1"),
    ("\u201c SCHEN\u00c4\u00dc!! \u00dc\u00d6!! BE\u00c4\u00d6!! \u00c4\u00dcCH!! und der f\u00fcr mit zu in \u201d", "cp1252", "windows-1252"),
    ("les les les les " + "\u00e8\u00ea " * 40 + "et puis", "latin-1", "iso-8859-1"),
    ("\u042d\u0442\u043e \u041d\u0418\u0418, NASA, \u0434\u043e\u043c \u0438 \u043b\u0435\u0441", "cp1251", "windows-1251"),
]


def test_accented_capitals_among_ascii_capitals_are_no_cyrillic(spark):
    rows = spark.createDataFrame([(i, bytearray(t.encode(e))) for i, (t, e, _) in enumerate(CAPITALS)], "i int, content binary")
    got = {r["i"]: r["p"] for r in rows.select("i", byte_encoding(rows["content"]).alias("p")).collect()}
    assert [got[i]["detected_encoding"] for i in range(len(CAPITALS))] == [name for _, _, name in CAPITALS]
