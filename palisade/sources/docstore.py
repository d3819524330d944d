"""Schema inference over JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def type_label(value: Column) -> Column:
    """Descriptive label of a variant's type."""
    kind = F.schema_of_variant(value)
    return F.when(value.isNull() | F.is_variant_null(value), "null") \
        .when(kind == "BOOLEAN", "boolean").when(kind == "BIGINT", "integer") \
        .when(kind.rlike("^(DOUBLE|FLOAT|DECIMAL)"), "double").when(kind == "STRING", "string") \
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object") \
        .when(kind.rlike("^(DATE|TIMESTAMP)"), "date").otherwise(F.lower(kind))


def infer_fields(documents: DataFrame, collection: str, body: str) -> DataFrame:
    """One row per (collection, field): dominant non-null type, and whether an explicit null was seen.

    All documents count.  Only (collection, field, type) totals are shuffled,
    and those are combined before the shuffle.  Type ties go to the label that
    sorts first.  ``_id`` is always listed as the key.
    """
    parsed = documents.select(F.col(collection).alias("collection"), F.try_parse_json(body).alias("v"))
    tvf = documents.sparkSession.tvf
    fields = parsed.lateralJoin(tvf.variant_explode(F.col("v").outer())).select(
        "collection", F.col("key").alias("field"), "value")
    counts = (fields.where(F.col("field") != "_id").withColumn("type", type_label(F.col("value")))
              .groupBy("collection", "field", "type").agg(F.count(F.lit(1)).alias("n")))
    typed = F.col("type") != "null"
    columns = counts.groupBy("collection", "field").agg(
        F.coalesce(F.min_by(F.when(typed, F.col("type")), F.when(typed, F.struct(-F.col("n"), F.col("type")))),
                   F.lit("string")).alias("data_type"),
        F.max(F.col("type") == "null").alias("is_nullable")).withColumn("is_primary_key", F.lit(False))
    ids = parsed.select("collection").distinct().select(
        "collection", F.lit("_id").alias("field"), F.lit("ObjectId").alias("data_type"),
        F.lit(False).alias("is_nullable"), F.lit(True).alias("is_primary_key"))
    return columns.unionByName(ids)


def sample_field(documents: DataFrame, body: str, field: str, n: int = 100) -> DataFrame:
    """n values of a field that exists and is not null, as text."""
    value = F.try_variant_get(F.try_parse_json(body), f"$.{field}", "string")
    return documents.select(value.alias("value")).where(F.col("value").isNotNull()) \
        .orderBy(F.md5("value"), "value").limit(n)
