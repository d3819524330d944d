"""Table-shaped store operations: upsert, insert-ignore, delete, latest, newest n.

Each returns the new state of the table as a DataFrame; the caller writes it
to a fresh path or partition (never over what the same job reads).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def last_per_key(rows: DataFrame, *keys: str, order: Column | None = None) -> DataFrame:
    """One row per key: the last by ``order``; among equals, or without an order, the largest by its other columns."""
    fields = [f for f in rows.schema if f.name not in keys]
    rank = [F.col(f.name) for f in fields if "map<" not in f.dataType.simpleString()]
    rank = ([order.alias("_order")] if order is not None else []) + (rank or [F.lit(0)])
    best = F.max_by(F.struct(*[f.name for f in fields]), F.struct(*rank)) if fields else F.count("*")
    return rows.groupBy(*keys).agg(best.alias("_r")).select(*keys, *(["_r.*"] if fields else [])).select(*rows.columns)


def upsert(current: DataFrame, incoming: DataFrame, *keys: str, order: Column | None = None) -> DataFrame:
    """Incoming rows replace current rows with the same key; of several incoming ones the last by ``order`` stands."""
    fresh = last_per_key(incoming, *keys, order=order)
    return current.join(fresh.select(*keys), list(keys), "left_anti").select(*current.columns).unionByName(fresh.select(*current.columns))


def insert_ignore(current: DataFrame, incoming: DataFrame, *keys: str, order: Column | None = None) -> DataFrame:
    """Incoming rows whose key is new are appended; of several the first stands."""
    cols = [c for c in incoming.columns if c not in keys]
    entry = F.struct(*cols)
    first = incoming.groupBy(*keys).agg(
        (F.min_by(entry, order) if order is not None else F.min(entry)).alias("_r")).select(*keys, "_r.*")
    return current.unionByName(first.join(current.select(*keys), list(keys), "left_anti").select(*current.columns))


def delete(current: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return current.join(gone.select(*keys).distinct(), list(keys), "left_anti").select(*current.columns)


def update(current: DataFrame, changes: DataFrame, *keys: str, order: Column | None = None) -> DataFrame:
    """Overwrite the columns that ``changes`` carries, for the keys it carries; of several changes the last stands."""
    changes = last_per_key(changes, *keys, order=order)
    fields = [c for c in changes.columns if c not in keys and c in current.columns]
    marked = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fields], F.lit(True).alias("_hit"))
    joined = current.join(marked, list(keys), "left")
    return joined.select(*[
        F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
        for c in current.columns])


def latest_per(df: DataFrame, keys, *order: str) -> DataFrame:
    """Newest row of each key.  ``max`` of a struct combines before the shuffle, so a hot key is cheap."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def newest(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def newest_per(df: DataFrame, n: int, keys, *order: str) -> DataFrame:
    """Newest n rows of each key; the rank limit is applied on the map side first."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
