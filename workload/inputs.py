"""Input tables derived from the given ones, all rows kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.functions.shared import shared_dir  # noqa: F401  (for the queries that write)
from workload.samples import SNIPPETS
from workload.sql import MARK


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """The table as its files split it, or in as many partitions as the session's ``palisade.input.partitions`` asks for."""
    n = df.sparkSession.conf.get("palisade.input.partitions", None)
    return df.repartition(int(n)) if n else df


def pick(values, key: Column) -> Column:
    """Element of a literal list by key modulo its length."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(key, F.lit(len(values))).cast("int"))


def _encoded(df: DataFrame, key: Column) -> DataFrame:
    return df.withColumns({
        "detected_encoding": F.when(key % 11 == 0, "ISO-8859-1").when(key % 11 == 1, "unknown").otherwise("utf-8"),
        "encoding_confidence": F.when(key % 10 == 0, 0.5).when(key % 10 == 1, 0.7).otherwise(0.99)})


def document_pages(spark, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """Every document as one page, its whole text plus one snippet."""
    d = documents if documents is not None else dealt(table(spark, sf_dir, "documents"))
    pages = d.select("doc_id", F.lit(1).alias("page_num"),
                     F.concat("text", pick(SNIPPETS, F.col("doc_id"))).alias("text"), "lang", "source")
    return _encoded(pages, F.col("doc_id")).withColumn("char_count", F.length("text"))


def conversation_pages(spark, sf_dir: str) -> DataFrame:
    """Every conversation as a document with one page per turn."""
    c = dealt(table(spark, sf_dir, "conversations"))
    key = F.col("conv_id") * 8 + F.col("turn")
    pages = c.select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_num"),
        F.concat(F.when(key % 29 == 0, MARK).otherwise(""), F.col("text"), pick(SNIPPETS, key)).alias("text"),
        "role", key.alias("_k"))
    return _encoded(pages, F.col("_k")).drop("_k").withColumn("char_count", F.length("text"))
