"""Pages of text from tables and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.functions.text import let, strip


def image_marker(text: Column, page_num: Column, images: Column) -> Column:
    """Replace the empty text of a page with images by a marker."""
    note = F.concat(
        F.lit("[PAGE "), page_num.cast("string"), F.lit(": Image-only page detected. Contains "),
        images.cast("string"), F.lit(" image(s). OCR required for full compliance scan.]"))
    return F.when((strip(text) == "") & (images > 0), note).otherwise(text)


def encoding_profile(content: Column, is_text: Column | None = None) -> Column:
    """Encoding name and confidence of raw bytes, by rule.

    Empty bytes are unknown, but for rows of which ``is_text`` says that they hold a known text: an empty one is ASCII.
    All-ASCII, valid UTF-8 and everything else are told apart exactly.
    """
    text = content.cast("string")
    known = F.lit(False) if is_text is None else is_text
    name = F.when((F.octet_length(content) == 0) & ~known, "unknown") \
        .when(~F.is_valid_utf8(text), "iso-8859-1") \
        .when(F.octet_length(content) == F.length(text), "ascii").otherwise("utf-8")
    score = F.when(name == "unknown", 0.0).when(name == "ascii", 1.0).when(name == "utf-8", 0.99).otherwise(0.73)
    return F.struct(name.alias("detected_encoding"), score.alias("encoding_confidence"))


def byte_encoding(content: Column) -> Column:
    """Encoding name and confidence of raw bytes, single-byte encodings told apart by how their high bytes stand together.

    Bytes that are ASCII or valid UTF-8 are that.  Else the share of high bytes that stand next to another one comes first: letters
    of Cyrillic words do (windows-1251), most accents among Latin letters do not.  Latin words with two accents side by side, told
    often enough, reach that share too, so the different words must agree, each counted once: more of them have two high bytes
    together and nothing Latin (a small ASCII letter, or two capital ones together) than have high bytes and that, and at least half
    as many as have small ASCII letters alone, or one of them is five high bytes long.  Latin text with bytes 0x80 to 0x9F, which are
    printed signs in windows-1252 and controls in iso-8859-1, is the former unless it has one of the five that it lacks.  The
    confidence is that share, or what it leaves, drawn to 0 where there are few high bytes to go by.
    """
    text = content.cast("string")
    chars = F.decode(content, "ISO-8859-1")
    high = F.regexp_count(chars, F.lit(r"[\x80-\xFF]"))
    alone = F.regexp_count(chars, F.lit(r"(?<![\x80-\xFF])[\x80-\xFF](?![\x80-\xFF])"))
    together = F.try_divide(high - alone, high)
    words = F.array_distinct(F.regexp_extract_all(chars, F.lit(r"[A-Za-z\x80-\xFF]+"), F.lit(0)))

    def agree(found):
        def n(test):
            return F.size(F.filter(found, test))
        mixed = n(lambda w: w.rlike(r"[\x80-\xFF]") & w.rlike("[a-z]|[A-Z]{2}"))
        plain = n(lambda w: ~w.rlike(r"[\x80-\xFF]") & w.rlike("[a-z]"))
        return let(n(lambda w: w.rlike(r"[\x80-\xFF]{2}") & ~w.rlike("[a-z]|[A-Z]{2}")), lambda cyrillic: (cyrillic > mixed) & (
            (2 * cyrillic >= plain) | F.exists(found, lambda w: w.rlike(r"^[\x80-\xFF]{5,}$"))))

    latin = F.when(chars.rlike(r"[\x80-\x9F]") & ~chars.rlike(r"[\x81\x8D\x8F\x90\x9D]"), "windows-1252").otherwise("iso-8859-1")
    name = F.when(F.octet_length(content) == 0, "unknown").when(high == 0, "ascii").when(F.is_valid_utf8(text), "utf-8").when(
        (together >= 0.6) & let(words, agree), "windows-1251").otherwise(latin)
    score = F.when(name == "unknown", 0.0).when(name == "ascii", 1.0).when(name == "utf-8", 0.99).otherwise(
        F.greatest(together, 1 - together) * high / (high + 1))
    return F.struct(name.alias("detected_encoding"), score.alias("encoding_confidence"))


def as_pages(df: DataFrame, doc_id: str, text: str, page_num: Column | None = None,
             images: Column | None = None) -> DataFrame:
    """The canonical page table from any table with a text column."""
    page = page_num if page_num is not None else F.lit(1)
    image_count = images if images is not None else F.lit(0)
    base = df.select(
        *[c for c in df.columns if c not in (doc_id, text)],
        F.col(doc_id).alias("doc_id"), page.cast("int").alias("page_num"), F.col(text).alias("_raw"),
        image_count.cast("int").alias("image_count"))
    base = base.withColumn("text", image_marker(F.col("_raw"), F.col("page_num"), F.col("image_count")))
    profile = F.when(strip(F.col("text")) == "", F.struct(F.lit("unknown").alias("detected_encoding"),
                                                           F.lit(0.0).alias("encoding_confidence"))) \
        .otherwise(encoding_profile(F.col("text").cast("binary")))
    return base.withColumn("_p", profile).withColumns({
        "char_count": F.length("text"), "detected_encoding": F.col("_p.detected_encoding"),
        "encoding_confidence": F.col("_p.encoding_confidence")}).drop("_raw", "_p")


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document per text file, one page per form-feed-separated part."""
    files = spark.read.option("wholetext", True).text(path).select(
        F.xxhash64(F.input_file_name()).alias("doc_id"), F.input_file_name().alias("file"), "value")
    parts = files.select("doc_id", "file", F.posexplode(F.split("value", "\f")).alias("n", "body"))
    return as_pages(parts, "doc_id", "body", page_num=F.col("n") + 1).drop("n")
