"""Metadata snapshots: relational catalogs over JDBC, Spark's own catalog, lake folders.

Every reader yields the same two tables, ``columns`` and ``tables``.  A
relational source is read with two set-oriented catalog queries, not one query
per table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.sources.columns import normalize_type


class Dialect(NamedTuple):
    """Catalog queries of one kind of source; ``{schema}`` is filled in."""
    default_schema: str
    tables: str
    columns: str
    keys: str | None = None


_COLUMNS = ("SELECT table_name, column_name, ordinal_position, data_type, is_nullable, character_maximum_length{extra} "
            "FROM {catalog}information_schema.columns WHERE table_schema = '{schema}' AND table_name IN (SELECT table_name "
            "FROM {catalog}information_schema.tables WHERE table_schema = '{schema}' AND table_type = 'BASE TABLE')")
_KEYS = ("SELECT ku.table_name, ku.column_name FROM information_schema.table_constraints tc "
         "JOIN information_schema.key_column_usage ku ON tc.constraint_name = ku.constraint_name "
         "AND tc.table_schema = ku.table_schema AND tc.table_name = ku.table_name "
         "WHERE tc.constraint_type = 'PRIMARY KEY' AND tc.table_schema = '{schema}'")

DIALECTS = {
    "postgres": Dialect(
        "public",
        "SELECT c.relname AS table_name, GREATEST(c.reltuples, 0) AS row_count, "
        "pg_total_relation_size(c.oid) AS size_bytes FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace "
        "WHERE n.nspname = '{schema}' AND c.relkind IN ('r', 'p')",
        _COLUMNS, _KEYS),
    "mysql": Dialect(
        "",
        "SELECT table_name, table_rows AS row_count, data_length + index_length AS size_bytes "
        "FROM information_schema.tables WHERE table_schema = '{schema}' AND table_type = 'BASE TABLE'",
        _COLUMNS.replace("{extra}", ", column_key{extra}")),
    "sqlserver": Dialect(
        "dbo",
        "SELECT t.table_name, SUM(p.rows) AS row_count, CAST(NULL AS BIGINT) AS size_bytes "
        "FROM information_schema.tables t LEFT JOIN sys.partitions p "
        "ON p.object_id = OBJECT_ID(t.table_schema + '.' + t.table_name) AND p.index_id IN (0, 1) "
        "WHERE t.table_schema = '{schema}' AND t.table_type = 'BASE TABLE' GROUP BY t.table_name",
        _COLUMNS, _KEYS),
    "snowflake": Dialect(
        "PUBLIC",
        "SELECT table_name, row_count, bytes AS size_bytes FROM {catalog}information_schema.tables "
        "WHERE table_schema = '{schema}' AND table_type = 'BASE TABLE'",
        _COLUMNS),
    "bigquery": Dialect(
        "",
        "SELECT table_id AS table_name, row_count, size_bytes, TIMESTAMP_MILLIS(last_modified_time) AS last_modified "
        "FROM `{schema}.__TABLES__` WHERE type = 1",
        "SELECT table_name, column_name, ordinal_position, data_type, is_nullable FROM "
        "`{schema}.INFORMATION_SCHEMA.COLUMNS`"),
}


def catalog_queries(dialect: str, schema: str | None = None, catalog: str = "") -> dict:
    """The catalog SQL for one source."""
    d = DIALECTS[dialect]
    name = (schema or d.default_schema).replace("'", "''")
    fill = {"schema": name, "extra": "", "catalog": f"{catalog}." if catalog else ""}
    return {k: q.format(**fill) for k, q in (("tables", d.tables), ("columns", d.columns), ("keys", d.keys)) if q}


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def normalize_catalog(source_id: str | Column, tables: DataFrame, columns: DataFrame, keys: DataFrame | None = None,
                      map_types: bool = False) -> tuple:
    """Catalog rows as snapshot tables: flags as booleans, counts never null or negative.

    ``tables`` lists base tables; columns of anything else, such as views, are dropped.  Also applies to catalog extracts that were stored as tables.
    """
    tables = tables.toDF(*[c.lower() for c in tables.columns])
    columns = columns.toDF(*[c.lower() for c in columns.columns])
    sid = F.lit(source_id) if isinstance(source_id, str) else source_id
    if keys is not None:
        keys = keys.toDF(*[c.lower() for c in keys.columns])
        on = [c for c in ("source_id", "table_name", "column_name") if c in keys.columns and c in columns.columns]
        columns = columns.join(keys.select(*on, F.lit(True).alias("_pk")), on, "left")
    primary = F.coalesce("_pk", F.lit(False)) if _has(columns, "_pk") else (
        (F.col("column_key") == "PRI") if _has(columns, "column_key") else F.lit(False))
    listed = [c for c in ("source_id", "table_name") if c in tables.columns and c in columns.columns]
    columns = columns.join(tables.select(*listed).distinct(), listed, "left_semi")
    data_type = normalize_type(F.col("data_type")) if map_types else F.col("data_type")
    length = F.col("character_maximum_length").cast("int") if _has(columns, "character_maximum_length") \
        else F.lit(None).cast("int")
    cols = columns.select(
        sid.alias("source_id"), "table_name", "column_name",
        (F.col("ordinal_position").cast("int") if _has(columns, "ordinal_position") else F.lit(0)).alias("ordinal"),
        data_type.alias("data_type"), (F.upper("is_nullable") == "YES").alias("is_nullable"),
        primary.alias("is_primary_key"), length.alias("max_length"))
    tabs = tables.select(
        sid.alias("source_id"), "table_name",
        F.greatest(F.coalesce(F.col("row_count").cast("bigint"), F.lit(0)), F.lit(0)).alias("row_count"),
        (F.coalesce(F.col("size_bytes").cast("bigint"), F.lit(0)) if _has(tables, "size_bytes")
         else F.lit(0).cast("bigint")).alias("size_bytes"))
    return cols, tabs


def snapshot_jdbc(spark: SparkSession, source_id: str, dialect: str, url: str, schema: str | None = None,
                  catalog: str = "", **options) -> tuple:
    """Metadata of a relational source or warehouse; reads catalog views only."""
    queries = catalog_queries(dialect, schema, catalog)

    def read(query):
        return spark.read.format("jdbc").options(url=url, query=query, **options).load()

    return normalize_catalog(source_id, read(queries["tables"]), read(queries["columns"]),
                             read(queries["keys"]) if "keys" in queries else None, map_types=dialect == "bigquery")


_COLUMN_ROW = ("source_id string, table_name string, column_name string, ordinal int, data_type string, "
               "is_nullable boolean, is_primary_key boolean, max_length int")


def _schema_rows(source_id, name, schema):
    return [(source_id, name, f.name, i, f.dataType.simpleString(), True, False, None)
            for i, f in enumerate(schema.fields, 1)]


def snapshot_catalog(spark: SparkSession, source_id: str, database: str) -> DataFrame:
    """Columns of every table Spark's catalog lists in a database; nothing is read but metadata."""
    rows = []
    for table in spark.catalog.listTables(database):
        rows += _schema_rows(source_id, table.name, spark.table(f"{database}.{table.name}").schema)
    return spark.createDataFrame(rows, _COLUMN_ROW)


def snapshot_lake(spark: SparkSession, source_id: str, paths: dict) -> DataFrame:
    """Columns of parquet tables (name → path) from their footers."""
    rows = []
    for name, path in paths.items():
        rows += _schema_rows(source_id, name, spark.read.parquet(path).schema)
    return spark.createDataFrame(rows, _COLUMN_ROW)
