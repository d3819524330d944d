"""Approximate nearest neighbours by a coarse quantiser of two halves, with multi-probe.

Unit vectors are cut in two halves, each with a codebook of ``codes`` centroids; a pair of centroids is a cell, so two small
codebooks give ``codes`` squared cells (an inverted multi-index).  Codebooks are fitted on a bounded sample; every vector of
the index is put into its cell, and a query looks into the ``probes`` cells whose centroids are nearest to it.  Rows and
queries meet by an equality on the cell and are compared exactly there.

Equal vectors are found together: of the copies of a vector only the k rows of smallest id can be among a query's k nearest, and equal
queries share one search.  A cell of more rows than ``most`` is dealt over several groups, so no group grows with the index.
Vectors of another length than the codebooks' meet in a cell of their own and are compared with all of that cell.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from palisade.functions.shared import written
from palisade.operators.retrieval import _best, _search, _shown, top_k_all, unit_vectors


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centroids."""
    return (points**2).sum(1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(1)[None, :]


def _fit(points: np.ndarray, codes: int, rounds: int) -> np.ndarray:
    """k-means, begun far apart: each centroid is the point farthest from those before it."""
    chosen, far = [0], _nearest(points, points[:1])[:, 0]
    while len(chosen) < min(codes, len(points)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _nearest(points, points[chosen[-1:]])[:, 0])
    centroids = points[chosen]
    for _ in range(rounds):
        own = _nearest(points, centroids).argmin(1)
        n = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


class Quantiser:
    """The two codebooks; at most ``sample`` vectors of the index are looked at to fit them."""

    def __init__(self, index: DataFrame, vector: str = "embedding", id_col: str = "id", codes: int | None = None, cell: int = 64,
                 sample: int = 20_000, rounds: int = 8):
        good = index.where(F.col(vector).isNotNull())
        sizes = good.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
        self.size, n = (sizes[0]["size"], sizes[0]["count"]) if sizes else (0, 0)
        self.codes = codes or int(np.clip(np.sqrt(n / cell), 1, 256))
        rows = good.where(F.size(vector) == self.size).select(vector, F.xxhash64(id_col).alias("h"), id_col).orderBy("h", id_col).limit(sample)
        _, units = unit_vectors(rows.select(vector).toArrow().combine_chunks().column(0).combine_chunks())
        half = self.size // 2
        points = units.get(self.size, np.zeros((0, self.size)))
        self.books = [_fit(p, self.codes, rounds) if len(p) else p for p in (points[:, :half], points[:, half:])]

    def cells(self, units: np.ndarray, probes: int) -> np.ndarray:
        """The nearest cells of each vector, nearest first."""
        half = self.size // 2
        a, b = (_nearest(p, book) for p, book in zip((units[:, :half], units[:, half:]), self.books))
        both = (a[:, :, None] + b[:, None, :]).reshape(len(units), -1)
        probes = min(probes, both.shape[1])
        near = np.argpartition(both, probes - 1, axis=1)[:, :probes]
        return np.take_along_axis(near, np.argsort(np.take_along_axis(both, near, 1), axis=1), 1)


def _celled(quantiser: Quantiser, probes: int, rows: int = 256):
    """Adds the cells of the last column's vectors; -1 holds vectors of another length, vectors without direction have none."""
    def run(batches):
        for whole in batches:
            for batch in (whole.slice(at, rows) for at in range(0, whole.num_rows, rows)):
                places, units = unit_vectors(batch.column(batch.num_columns - 1))
                cells = [[] for _ in range(batch.num_rows)]
                for size, at in places.items():
                    own = quantiser.cells(units[size], probes).tolist() if size == quantiser.size and len(quantiser.books[0]) else [[-1]] * len(at)
                    for i, near in zip(at, own):
                        cells[i] = near
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64()))], [*batch.schema.names, "cells"])
    return run


def _with_cells(rows: DataFrame, quantiser: Quantiser, probes: int) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    found = rows.mapInArrow(_celled(quantiser, probes), f"{schema}, cells array<bigint>")
    return found.withColumn("_cell", F.explode("cells")).drop("cells")


def _first_copies(rows: DataFrame, vector: str, id_col: str, k: int) -> DataFrame:
    """The k rows of smallest id of each vector, first per salt, so that no vector is one task's work."""
    rows = rows.withColumns({"_h": F.xxhash64(vector), "_salt": F.pmod(F.xxhash64(id_col), F.lit(32))})
    for keys in (("_h", "_salt"), ("_h",)):
        place = F.row_number().over(Window.partitionBy(*keys, vector).orderBy(id_col))
        rows = rows.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")
    return rows.drop("_h", "_salt")


def top_k_near(index: DataFrame, queries: DataFrame, k: int = 5, quantiser: Quantiser | None = None, probes: int = 16,
               vector: str = "embedding", id_col: str = "id", most: int = 4096, block: int = 256) -> DataFrame:
    """About the k nearest rows of each query: query_id, id, distance, place, in the shape of ``top_k_all``.

    ``queries``: ``query_id, query_vector``.  Distances are exact, rows may be missed; ``recall`` measures how many.  A null vector,
    one with a null component or of zeros is never found and finds nothing; an index of fewer than k rows gives fewer.
    """
    quantiser = quantiser or Quantiser(index, vector, id_col)
    rows = _first_copies(index.where(F.col(vector).isNotNull()).select(id_col, vector), vector, id_col, k)
    rows = written(_with_cells(rows, quantiser, 1), "cells")
    groups = rows.groupBy("_cell").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / most)).cast("int").alias("_groups"))
    named = written(queries.where("query_vector IS NOT NULL").withColumn("_key", F.sha2(F.to_json(F.array("query_vector")), 256)), "queries")
    different = named.groupBy("_key").agg(F.first("query_vector").alias("query_vector")).select("_key", "query_vector")
    asked = _with_cells(different, quantiser, probes).join(groups, "_cell")
    dealt = F.pmod(F.xxhash64(id_col), F.col("_groups")).cast("long")
    part = lambda salt: F.concat_ws(":", "_cell", salt).alias("_part")
    rows = rows.join(groups, "_cell").select(id_col, vector, part(dealt))
    # Queries of a cell come in blocks, by a hash of their key and their number.
    blocks = asked.groupBy("_cell").agg(F.max("_groups").alias("_groups"), F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    asked = asked.drop("_groups").join(blocks, "_cell").groupBy("_cell", "_groups", F.pmod(F.xxhash64("_key"), F.col("_blocks")).alias("_block")).agg(
        F.collect_list(F.struct(F.col("_key").alias("query_id"), "query_vector")).alias("_queries"))
    asked = asked.select("_queries", F.col("_cell"), F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)).alias("_salt")).select(
        "_queries", part("_salt"))
    ids = index.schema[id_col].dataType.simpleString()
    near = rows.groupBy("_part").cogroup(asked.groupBy("_part")).applyInPandas(
        _search(k, vector, id_col), f"query_id string, {id_col} {ids}, distance double, _part string")
    best = _best(near.drop("_part"), k, id_col, "query_id").withColumnRenamed("query_id", "_key")
    return _shown(best.join(named.select("_key", "query_id"), "_key").select("query_id", id_col, "distance", "place"))


def recall(index: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding", id_col: str = "id", **settings) -> float:
    """The share of the exact k nearest distances that the approximate search reaches (of equally far rows any counts)."""
    exact = top_k_all(index, queries, k, vector, id_col).groupBy("query_id").agg(F.max("distance").alias("far"), F.count("*").alias("n"))
    near = top_k_near(index, queries, k, vector=vector, id_col=id_col, **settings).select("query_id", F.col("distance").alias("d"))
    hits = exact.join(near, "query_id", "left").agg(F.sum((F.col("d") <= F.col("far")).cast("int")).alias("hits")).first()["hits"] or 0
    return hits / max(1, exact.agg(F.sum("n")).first()[0] or 0)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
