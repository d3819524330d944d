"""Tables that are updated in place: parts in versioned folders, and a manifest per version that says which folder holds each part.

    root/data/v=000012-5f0c…/_part=017/…   the rows of part 017 as version 12 left them
    root/manifest/v=000012                 one row per part: the version and the folder that hold it now

A change writes the parts it touches into a new folder and then the new manifest, which is one file and so appears whole or not at
all.  Until then readers see the last version; what a crash leaves behind belongs to no manifest.
Two writers of one version cannot both write its manifest: the second one fails, and its folder is nobody's.  Parts are few (hash buckets, days), so a manifest is
small; rows are never collected.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from palisade.functions.shared import written
from palisade.operators import store

MANIFEST = "part string, version bigint, folder string"


class VersionedTable:
    """A table of the given columns under ``root``; null parts are a part of their own."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str):
        self.spark, self.root = spark, root
        self.schema = spark.createDataFrame([], schema).schema

    def _manifests(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"{MANIFEST}, v bigint").parquet(f"{self.root}/manifest")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def version(self) -> int:
        """The number of the last committed version, 0 before the first."""
        every = self._manifests()
        return int(every.agg(F.max("v")).first()[0] or 0) if every is not None else 0

    def _parts(self, version: int | None = None) -> dict[str, tuple[int, str]]:
        version = self.version() if version is None else version
        if not version:
            return {}
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v={version:06d}")
        return {r["part"]: (r["version"], r["folder"]) for r in rows.where("part <> ''").collect()}

    def parts(self, version: int | None = None) -> dict[str, int]:
        """The version that each part was last written in."""
        return {part: v for part, (v, _) in self._parts(version).items()}

    def read(self, parts: Iterable[str] | None = None, version: int | None = None) -> DataFrame:
        """The rows of the table, or of some of its parts, as a version (else the last one) has them."""
        have = self._parts(version)
        wanted = sorted(have) if parts is None else sorted(set(parts) & set(have))
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/data/{have[p][1]}/_part={p}" for p in wanted])

    def replace(self, rows: DataFrame, part: Column, parts: Iterable[str], version: int | None = None) -> int:
        """Commit a version in which ``rows`` are all there is of ``parts``; ``part`` gives the part of a row.  Returns its number.

        Skewed parts are split over tasks by Spark's rebalancing.  A part without a row leaves the table.
        """
        last = self.version()
        have, new = self._parts(last), last + 1 if version is None else version
        if new <= last:
            raise ValueError(f"version {new} is not behind version {last}")
        folder, parts = f"v={new:06d}-{uuid.uuid4().hex}", set(parts)
        rows.select(*self.schema.names).withColumn("_part", part).hint("rebalance", "_part").write.partitionBy("_part").parquet(
            f"{self.root}/data/{folder}")
        left = self._written(f"{self.root}/data/{folder}", parts)
        have = {p: v for p, v in have.items() if p not in parts} | {p: (new, folder) for p in left}
        # An empty table has a manifest too.
        manifest = self.spark.createDataFrame([(p, *v) for p, v in sorted(have.items())] or [("", 0, "")], MANIFEST)
        manifest.coalesce(1).write.mode("error").parquet(f"{self.root}/manifest/v={new:06d}")
        return new

    def _written(self, folder: str, parts: set[str]) -> set[str]:
        try:
            rows = self.spark.read.schema("_part string").parquet(folder)
        except AnalysisException:
            return set()
        found = {r[0] for r in rows.select("_part").distinct().collect()}
        if not found <= parts:
            raise ValueError(f"rows of parts that are not replaced: {sorted(found - parts)[:5]}")
        return found


def bucket(keys: list[str], buckets: int) -> Column:
    return F.lpad(F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string"), len(str(buckets - 1)), "0")


class KeyedTable(VersionedTable):
    """A table with one row per key, in buckets by a hash of the key."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str, keys: list[str], buckets: int = 64):
        super().__init__(spark, root, schema)
        self.keys, self.buckets = keys, buckets

    def upsert(self, incoming: DataFrame, order: Column | None = None) -> int | None:
        """Incoming rows replace those of their keys; of several the last by ``order`` stands.  Only buckets of incoming keys are read
        and written.  Null keys are keys.  Without incoming rows nothing is committed."""
        fresh = store.last_per_key(incoming, *self.keys, order=order).select(*self.schema.names)
        fresh = written(fresh.withColumn("_part", bucket(self.keys, self.buckets)), "fresh")
        touched = [r[0] for r in fresh.select("_part").distinct().collect()]
        if not touched:
            return None
        current, fresh = self.read(touched), fresh.drop("_part")
        new = fresh.select(*[F.col(k).alias(f"_key{n}") for n, k in enumerate(self.keys)])
        same = [F.col(k).eqNullSafe(F.col(f"_key{n}")) for n, k in enumerate(self.keys)]
        kept = current.join(new, same, "left_anti")
        return self.replace(kept.unionByName(fresh), bucket(self.keys, self.buckets), touched)
