"""Findings as retrievable documents, exact cosine search, context strings."""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.functions.shared import written
from palisade.operators import store

META = ("source_id", "source_name", "scan_id", "entity_name", "check_type", "risk_level", "flag_category")


def finding_document() -> Column:
    # The line labels.
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Data source: "), "source_name"),
        F.concat(F.lit("Entity: "), F.coalesce("entity_name", F.lit("unknown"))),
        F.concat(F.lit("Risk type: "), F.coalesce("check_type", F.lit("unknown")), F.lit(" — "),
                 F.coalesce("flag_category", F.lit(""))),
        F.concat(F.lit("Risk level: "), F.coalesce("risk_level", F.lit("low"))),
        F.concat(F.lit("Evidence: "), F.coalesce("evidence", F.lit(""))),
        F.concat(F.lit("Recommendation: "), F.coalesce("recommendation", F.lit(""))))


def finding_metadata() -> Column:
    pairs = [x for k in META for x in (F.lit(k), F.coalesce(F.col(k), F.lit("")))]
    return F.create_map(*pairs)


def finding_documents(results: DataFrame) -> DataFrame:
    """Id, text and metadata of every finding.

    The id carries the finding's place within its scan (see ``position_within``
    for the order, which has no meaning beyond being repeatable).
    """
    placed = position_within(results, ["scan_id"], ["entity_name", "flag_category"], "_i")
    return placed.select(
        F.concat(F.coalesce("scan_id", F.lit("")), F.lit("_"), F.col("_i").cast("string"), F.lit("_"),
                 F.substring(F.coalesce("entity_name", F.lit("unknown")), 1, 20)).alias("id"),
        finding_document().alias("text"), finding_metadata().alias("metadata"))


def position_within(df: DataFrame, keys, spread_by, name: str) -> DataFrame:
    """Zero-based position of each row within its key, without one task per key.

    Rows are ordered by a hash of ``spread_by`` and cut into 4096 buckets per
    key by its leading digits.  A row's place is its place in the bucket plus
    the sizes of the buckets before it, of which there is one small count each.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws("|", *spread_by))).withColumn("_b", F.substring("_h", 1, 3))
    within = Window.partitionBy(*keys, "_b").orderBy("_h", *spread_by)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    held = [f"_k{n}" for n in range(len(keys))]
    offsets = hashed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).select(
        *[F.col(k).alias(h) for k, h in zip(keys, held)], F.col("_b").alias("_c"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_b") == F.col("_c")
    for k, h in zip(keys, held):
        same = same & F.col(k).eqNullSafe(F.col(h))  # a null key is a key
    return (hashed.withColumn("_local", F.row_number().over(within)).join(offsets, same)
            .withColumn(name, F.col("_local") + F.col("_before") - 1).drop("_h", "_b", "_c", "_local", "_before", *held))


def upsert_documents(index: DataFrame, fresh: DataFrame, key: str = "id", order: Column | None = None) -> DataFrame:
    return store.upsert(index, fresh, key, order=order)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two array columns over their whole length.

    Null for a null vector, vectors of different lengths, a null component and a vector of zeros.
    """
    return F.when(F.size(a) == F.size(b), F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))))


def _shown(rows: DataFrame) -> DataFrame:
    """The distance as it is shown: six digits, no negative zero."""
    return rows.withColumn("distance", F.round("distance", 6) + F.lit(0.0))


def top_k(index: DataFrame, query: DataFrame, k: int = 5, where: Column | None = None,
          vector: str = "embedding", id_col: str = "id") -> DataFrame:
    """Nearest k rows to one query vector (``query``: one row, one array column).

    The filter runs first; each task keeps its own best k.  Rows are ranked by the exact distance, which is rounded
    in the output alone; rows without a distance never count.  A smaller index gives fewer rows.
    """
    rows = index.where(where) if where is not None else index
    scored = rows.withColumn("_query", query.scalar()).withColumn("distance", 1 - cosine(F.col(vector), F.col("_query"))).drop("_query")
    near = scored.where(F.col("distance").isNotNull()).orderBy("distance", id_col).limit(k)
    return _shown(near)


def _best(pairs: DataFrame, k: int, id_col: str, *keys: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("distance", id_col))
    return pairs.withColumn("place", place).where(F.col("place") <= k)


def _ranked(pairs: DataFrame, k: int, id_col: str, salt: str) -> DataFrame:
    """The nearest k of each query: first in each salt, then of what is left."""
    near = pairs.where(F.col("distance").isNotNull())
    return _shown(_best(_best(near, k, id_col, "query_id", salt).drop("place"), k, id_col, "query_id").drop(salt))


def top_k_by(index: DataFrame, queries: DataFrame, on: str, k: int = 5, vector: str = "embedding",
             id_col: str = "id", salts: int = 64) -> DataFrame:
    """Many queries at once, each searching the rows that share its metadata value ``on``.

    ``queries``: ``query_id, query_vector`` and ``on``.  An equality join pairs a row only with the queries that filter
    for it.  A value may hold a third of the index: rows are dealt over ``salts`` and queries copied for each, so a
    value is split over as many tasks, and the best k are taken per query and salt before those of the query.
    """
    salted = index.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(salts)))
    copies = queries.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    pairs = salted.join(copies, [on, "_salt"]).withColumn("distance", 1 - cosine(F.col(vector), F.col("query_vector")))
    return _ranked(pairs.drop(vector, "query_vector"), k, id_col, "_salt")


def top_k_all(index: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding", id_col: str = "id",
              max_bytes: int = 32_000_000) -> DataFrame:
    """Many queries at once against every row of the index.

    ``queries``: ``query_id, query_vector``.  Queries go in blocks of at most ``max_bytes`` by a count of theirs; each block is sent
    to the tasks, which stream their part of the index past it, batch by batch, by matrix products.  A task holds the best k
    rows per query and nothing else of the index.  Of several blocks one is there at a time, and what it found is written.
    """
    spark, asked = index.sparkSession, queries.where("query_vector IS NOT NULL").select("query_id", "query_vector")
    numbers = asked.agg(F.sum(F.size("query_vector") * 8 + 64)).first()[0] or 0
    parts = max(1, -(-int(numbers) * 5 // (max_bytes * 4)) if numbers > max_bytes else 1)  # a quarter's room for uneven hashes
    rows = index.where(F.col(vector).isNotNull()).select(id_col, vector)
    ids, keys = (d.schema[c].dataType.simpleString() for d, c in ((index, id_col), (queries, "query_id")))
    found = []
    for part in range(parts):
        own = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        block = spark.sparkContext.broadcast(_Block(own.toArrow()))
        near = rows.mapInArrow(_stream(block, k), f"query_id {keys}, {id_col} {ids}, distance double")
        if parts > 1:
            near = written(near, "near")
            block.destroy()
        found.append(near)
    return _shown(_best(reduce(DataFrame.unionByName, found), k, id_col, "query_id"))


def unit_vectors(column) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Places of the vectors of each length, and those vectors at length 1; without null vectors or components and zeros."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    places, units = {}, {}
    for size in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == size)
        values = column.take(pa.array(at)).flatten()
        values = pc.fill_null(values.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(len(at), size)
        norms = np.sqrt((values * values).sum(1))
        good = np.isfinite(norms) & (norms > 0)
        if good.any():
            places[size], units[size] = at[good], values[good] / norms[good, None]
    return places, units


class _Block:
    """Queries of one block: ids, and the unit vectors of each length."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        self.ids = rows.column("query_id").combine_chunks()
        self.places, self.units = unit_vectors(rows.column("query_vector").combine_chunks())


def _stream(block, k: int, slab: int = 512):
    """The best k rows of this task for each query of the block."""
    def search(batches):
        queries, best, names, id_type = block.value, pd.DataFrame({"q": [], "d": [], "id": []}), None, None
        kth = np.full(len(queries.ids), np.inf)
        for batch in batches:
            names, id_type = batch.schema.names, batch.schema.field(0).type
            ids = np.array(batch.column(0).to_pylist(), dtype=object)
            places, units = unit_vectors(batch.column(1))
            new = []
            for size in set(places) & set(queries.places):
                for at in range(0, len(queries.places[size]), slab):
                    own = queries.places[size][at:at + slab]
                    far = 1 - queries.units[size][at:at + slab] @ units[size].T
                    most = np.partition(far, k - 1, axis=1)[:, k - 1] if far.shape[1] > k else np.full(len(own), np.inf)
                    q, row = np.nonzero(far <= np.minimum(most, kth[own])[:, None])
                    new.append(pd.DataFrame({"q": own[q], "d": far[q, row], "id": ids[places[size][row]]}))
            if new:
                best = pd.concat([best, *new]) if len(best) else pd.concat(new)
                best = best.sort_values(["q", "d", "id"]).groupby("q").head(k)
                full = best.groupby("q")["d"].agg(["size", "max"])
                full = full[full["size"] == k]
                kth[full.index.to_numpy().astype(int)] = full["max"].to_numpy()
        if len(best):
            yield pa.RecordBatch.from_arrays(
                [queries.ids.take(pa.array(best["q"].to_numpy().astype(np.int64))), pa.array(best["id"].tolist(), id_type),
                 pa.array(best["d"].to_numpy(), pa.float64())], ["query_id", names[0], "distance"])
    return search


def _search(k: int, vector: str, id_col: str):
    def search(index: pd.DataFrame, copies: pd.DataFrame) -> pd.DataFrame:
        out = []
        part = copies["_part"].iloc[0] if len(copies) else 0
        lengths = index[vector].map(len) if len(index) else []
        for queries in copies["_queries"]:
            queries = pd.DataFrame(list(queries))
            for size, mine in queries.groupby(queries["query_vector"].map(lambda v: -1 if v is None else len(v))):
                rows = index[lengths == size] if len(index) else index
                if size <= 0 or not len(rows):
                    continue
                a, b = (np.array([list(v) for v in x], dtype=float) for x in (mine["query_vector"], rows[vector]))
                norms = np.outer(np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1)))
                with np.errstate(divide="ignore", invalid="ignore"):
                    far = np.where(norms > 0, 1 - (a @ b.T) / norms, np.nan)
                ids = rows[id_col].to_numpy()
                for key, distances in zip(mine["query_id"], far):
                    best = [i for i in np.lexsort((ids, distances))[:k] if not np.isnan(distances[i])]
                    out += [(key, ids[i], distances[i], part) for i in best]
        return pd.DataFrame(out, columns=["query_id", id_col, "distance", "_part"])
    return search


def index_stats(index: DataFrame, name: str = "compliance_knowledge") -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("total_documents")).withColumn("collection_name", F.lit(name))


def _joined(df: DataFrame, order, text: Column, sep: str, name: str) -> DataFrame:
    """Ordered string aggregate of a short, already limited table."""
    rows = df.select(F.struct(*order, text.alias("t")).alias("r"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["t"]), sep).alias(name))


def retrieval_context(hits: DataFrame) -> DataFrame:
    """``[Finding n]`` blocks of at most k hits (``place``, ``text``)."""
    return _joined(hits, ["place"], F.concat(F.lit("[Finding "), F.col("place").cast("string"), F.lit("]\n"), F.col("text")),
                   "\n\n", "context")


def state_context(runs: DataFrame, trend: DataFrame, changes: DataFrame) -> DataFrame:
    """State summary strings for one source: its three newest scans and changes, its latest trend row."""
    newest_runs = store.newest(runs, 3, "started_at", "scan_id")
    scans = _joined(
        newest_runs.withColumn("_o", -F.unix_micros(F.col("started_at").cast("timestamp"))), ["_o", "scan_id"],
        F.concat(F.lit("Scan "), F.substring("scan_id", 1, 8), F.lit(" on "),
                 F.date_format("started_at", "yyyy-MM-dd"), F.lit(": "), F.col("total_flags").cast("string"),
                 F.lit(" flags, risk="), F.col("highest_risk")), "; ", "scans")
    last = store.newest(trend, 1, "trend_date").select(F.format_string(
        "Latest Risk Trend: score=%.1f, compliance=%.1f%%, violations=%d",
        "risk_score", "compliance_pct", "total_violations").alias("trend"))
    newest_changes = store.newest(changes, 3, "detected_at", "change_id")
    moves = _joined(
        newest_changes.withColumn("_o", -F.unix_micros(F.col("detected_at").cast("timestamp"))), ["_o", "change_id"],
        F.concat(F.col("change_type"), F.lit(" on "), F.col("entity_name"), F.lit(" ("), F.col("severity"), F.lit(")")),
        "; ", "changes")
    one = scans.select(F.when(F.col("scans") != "", F.concat(F.lit("Recent Scans: "), "scans")).alias("a"), F.lit(1).alias("k"))
    two = last.select(F.col("trend").alias("b"), F.lit(1).alias("k"))
    three = moves.select(F.when(F.col("changes") != "", F.concat(F.lit("Recent Schema Changes: "), "changes")).alias("c"),
                         F.lit(1).alias("k"))
    return one.join(two, "k", "left").join(three, "k", "left").select(F.concat_ws("\n", "a", "b", "c").alias("context"))


# The search runs in Python workers, which need not have this package on their path: send it by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
