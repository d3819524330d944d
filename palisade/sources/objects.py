"""Object stores: inventory by prefix and short text samples."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.sources.heads import ObjectHeads

# --- fixed values: sampled file types ----------------------------------------
SAMPLED = "*.{json,csv,txt,log,ndjson}"


def _qualified(spark: SparkSession, root: str) -> str:
    """The root as the file system names it, so that it starts the path of every object below it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def list_objects(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """Path, length, modification time and path below ``root`` of every object; contents are not read.

    Both sides of the cut are qualified by the same file system, so roots with and without a scheme give the same
    prefixes.  Spark lists a single root from the driver; many roots (``root/*``) are listed by tasks.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    bare = lambda c: F.regexp_replace(c, "^([A-Za-z][A-Za-z0-9+.-]*):/*", "$1:/")
    base = bare(F.lit(_qualified(spark, root)))
    return reader.load(root).select("path", "length", "modificationTime").withColumn(
        "relative", F.ltrim(F.substring(bare(F.col("path")), F.length(base) + 1, F.length("path")), F.lit("/")))


def inventory(objects: DataFrame) -> DataFrame:
    """Objects, bytes and last change per top-level prefix; objects at the root count under ``root``."""
    prefix = F.when(F.contains("relative", F.lit("/")), F.substring_index("relative", "/", 1)).otherwise("root")
    return objects.groupBy(prefix.alias("prefix")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("length").alias("size_bytes"),
        F.max("modificationTime").alias("last_modified"))


def sample_objects(spark: SparkSession, root: str, n: int = 100, head: int = 2048, keep: int = 500) -> DataFrame:
    """Leading text of up to n objects of a text type, by path; bad bytes become replacement characters.

    The n paths come from the listing (n is the size of the sample, so they fit the driver).  Of each object only the first
    ``head`` bytes are read, by a ranged read in a partition of its own; an object may be one long line.  The stores are those that
    pyarrow knows by their scheme (local, HDFS, S3, GCS).  A final line end is no part of the text.
    An object without a byte is not listed by Spark and has no row.
    """
    chosen = [r["path"] for r in list_objects(spark, root, SAMPLED).select("path").orderBy("path").limit(n).collect()]
    if not chosen:
        return spark.createDataFrame([], "path string, sample string")
    spark.dataSource.register(ObjectHeads)
    heads = spark.read.format("object_heads").option("paths", json.dumps(chosen)).option("bytes", head).load()
    whole = F.when((F.col("size") <= head) & F.endswith("head", F.lit(b"\n")), F.substring("head", 1, F.length("head") - 1)).otherwise(F.col("head"))
    return heads.select("path", F.substring(F.make_valid_utf8(whole.cast("string")), 1, keep).alias("sample"))
