"""Sharding along a Hilbert curve, by DataFrame functions alone.

Language, source and size are each quantised into 2**``bits`` levels that hold about equal numbers of rows.  A row's
three levels are its cell; cells are put in the order of their Hilbert index, and the rows in that order are cut into
runs whose counts differ by one at most (law ``rows``).  Neighbours on the curve are neighbours in all dimensions, so each
run covers a small range of each and a reader can skip most runs by any of them.

No task sorts everything: cells (at most 8**bits, 32,768) are counted and ordered by themselves, and inside a cell, which
may hold a third of all rows, rows are ranked in 1,024 ranges of a hash of their id.  A row's place is the sum of
what stands before its cell, before its range, and before it in its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.llm import base

BEFORE = (Window.unboundedPreceding, -1)


def hilbert_index(df: DataFrame, axes: list[str], bits: int, name: str) -> DataFrame:
    """Adds the index of a point along the Hilbert curve through the cube of 2**bits points a side.

    Skilling's transform: undo the turns of every level, from the largest, then Gray-encode, then interleave bits.
    """
    x = [f"_x{i}" for i in range(len(axes))]
    now = df.withColumns({a: F.col(b).cast("long") for a, b in zip(x, axes)})
    for level in range(bits - 1, 0, -1):
        bit, below = F.lit(1 << level), F.lit((1 << level) - 1)
        for a in x:
            turned = F.col(a).bitwiseAND(bit) != 0
            swap = F.col(x[0]).bitwiseXOR(F.col(a)).bitwiseAND(below)
            now = now.withColumns({"_turned": turned, "_swap": swap})
            if a == x[0]:
                now = now.withColumn(a, F.when(F.col("_turned"), F.col(a).bitwiseXOR(below)).otherwise(F.col(a)))
            else:
                now = now.withColumns({
                    x[0]: F.col(x[0]).bitwiseXOR(F.when(F.col("_turned"), below).otherwise(F.col("_swap"))),
                    a: F.when(F.col("_turned"), F.col(a)).otherwise(F.col(a).bitwiseXOR(F.col("_swap")))})
    for a, b in zip(x[1:], x):
        now = now.withColumn(a, F.col(a).bitwiseXOR(F.col(b)))
    flips = F.lit(0).cast("long")
    for level in range(bits - 1, 0, -1):
        flips = flips.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(F.lit(1 << level)) != 0, (1 << level) - 1).otherwise(0))
    now = now.withColumn("_turned", flips)
    now = now.withColumns({a: F.col(a).bitwiseXOR(F.col("_turned")) for a in x})
    index = F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        for a in x:
            index = index * 2 + F.shiftright(F.col(a), level).bitwiseAND(F.lit(1))
    return now.withColumn(name, index).drop("_turned", "_swap", *x)


def _levels(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """(value, level) of one dimension: values in order, null last, cut into 2**bits parts of about equal row counts.

    One row per different value; dimensions are metadata of few values.
    """
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    order = Window.orderBy(F.col("value").asc_nulls_last())
    before = F.coalesce(F.sum("n").over(order.rowsBetween(*BEFORE)), F.lit(0))
    level = F.floor(before * 2**bits / F.sum("n").over(Window.partitionBy())).cast("long")
    return base.written(counts.select("value", level.alias("level")), f"levels_{bits}")


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def sharded(docs: DataFrame, shards: int = 40, bits: int = 5):
    """The documents with four more columns, and the names these got: size, curve, shard, slot.

    Only ``doc_id``, ``text``, ``lang`` and ``source`` are read.  A null text has no bytes; null metadata is a value of
    its own, behind all others.  Equal rows get slots of their own.  With fewer rows than shards some shards are empty.
    A long text counts with all its bytes; an empty table gives an empty one.
    """
    size, curve, shard, slot, octave, span, hashed, place = base.unused(
        docs, "size", "curve", "shard", "slot", "_octave", "_span", "_hash", "_place")
    # Sizes to an eighth of an octave: at most a few hundred values.
    rows = docs.withColumns({size: text_size(docs["text"]), hashed: F.xxhash64("doc_id")}).withColumns(
        {octave: F.floor(F.log2(F.col(size)) * 8), span: F.shiftrightunsigned(hashed, 54)})
    axes = base.unused(rows, "_lang", "_source", "_size")
    for axis, column in zip(axes, ("lang", "source", octave)):
        (value,) = base.unused(rows, "_value")
        level = _levels(rows, column, bits).toDF(value, axis)
        rows = rows.join(level, F.col(f"`{column}`").eqNullSafe(F.col(value)), "left").drop(value)
    ranges = base.written(rows.groupBy(*[F.col(a).alias(f"a{i}") for i, a in enumerate(axes)], F.col(span).alias("span"))
                          .agg(F.count("*").alias("n")), "ranges")
    cells = hilbert_index(ranges.groupBy("a0", "a1", "a2").agg(F.sum("n").alias("n")), ["a0", "a1", "a2"], bits, "curve")
    cells = base.written(cells.select(
        "a0", "a1", "a2", "curve", F.sum("n").over(Window.partitionBy()).alias("total"),
        F.coalesce(F.sum("n").over(Window.orderBy("curve").rowsBetween(*BEFORE)), F.lit(0)).alias("before_cell")), "cells")
    inside = Window.partitionBy("a0", "a1", "a2").orderBy("span").rowsBetween(*BEFORE)
    starts = ranges.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(cells, ["a0", "a1", "a2"])
    held = base.unused(rows, "_a0", "_a1", "_a2", "_range", "_curve", "_total", "_start")
    starts = starts.select("a0", "a1", "a2", "span", "curve", "total", F.col("before") + F.col("before_cell")).toDF(*held)
    rank = F.row_number().over(Window.partitionBy(*axes, span).orderBy(hashed, "doc_id")) - 1
    keys = zip((*axes, span), held)
    same = None
    for a, b in keys:
        same = F.col(a) == F.col(b) if same is None else same & (F.col(a) == F.col(b))
    own = rows.withColumn(place, rank).join(starts, same)
    own = own.withColumn(place, F.col(place) + F.col(held[6]))
    own = own.withColumn(shard, F.expr(f"`{place}` * {shards}L div `{held[5]}`"))
    start = F.expr(f"(`{shard}` * `{held[5]}` + {shards - 1}L) div {shards}L")
    return own.select(*[F.col(f"`{c}`") for c in docs.columns], size, F.col(held[4]).alias(curve),
                      F.col(shard).cast("int").alias(shard), (F.col(place) - start).alias(slot)), (size, curve, shard, slot)


def op6(spark, sf_dir):
    docs = base.only(base.table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source").withColumn(
        "text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    out, (size, _, shard, slot) = sharded(docs)
    return out.select("doc_id", size, "text_crc32", F.lit("rows").alias("law"), shard, slot,
                      F.lit(None).cast("int").alias("grown_shard"))
