"""Samples and statistics of table columns, and type labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.functions.text import sql_string
from palisade.rules import WAREHOUSE_TYPES


def normalize_type(vendor_type: Column) -> Column:
    """Common label of a vendor type; an unknown one is only lowered."""
    table = F.create_map(*[x for k, v in WAREHOUSE_TYPES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, vendor_type), F.lower(vendor_type))


def sample_column(df: DataFrame, column: str, n: int = 100, fraction: float | None = None,
                  seed: int = 7) -> DataFrame:
    """n non-null values as text: a Bernoulli sample, or, repeatably, the n least by hash."""
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value"))
    if fraction is not None:
        return rows.sample(fraction, seed).limit(n)
    return rows.orderBy(F.md5("value"), "value").limit(n)


def column_stats(df: DataFrame, columns, position: str, exact: bool = False) -> DataFrame:
    """Null fraction, distinct values and correlation with ``position`` for each column.

    One pass; distinct counts are sketches unless ``exact``.
    """
    n = F.count(F.lit(1))
    aggs = []
    for c in columns:
        numeric = dict(df.dtypes)[c] in ("int", "bigint", "double", "float", "smallint", "tinyint")
        distinct = F.count_distinct(c) if exact else F.approx_count_distinct(c)
        corr = F.corr(F.col(c).cast("double"), F.col(position).cast("double")) if numeric else F.lit(None).cast("double")
        aggs.append(F.struct(
            F.lit(c).alias("column_name"), (1 - F.count(c) / n).alias("null_frac"), distinct.alias("n_distinct"),
            F.round(corr, 4).alias("correlation")).alias(c))
    return df.agg(*aggs).select(F.explode(F.array(*columns)).alias("s")).select("s.*")


def median_between(value: Column, low: Column, high: Column) -> Column:
    """Aggregate: does the exact median lie from ``low`` to ``high``, each one value for all rows?  Null without a value.

    The counts on either side of each bound tell, and the values next to it where the two middle values lie apart; no value is gathered.
    """
    n, below, upto = F.count(value), F.count_if(value < low), F.count_if(value <= high)
    first, last = F.floor((n - 1) / 2), F.floor(n / 2)  # places of the middle values, from 0

    def mean(test):
        """Of the largest value that passes and the smallest that does not."""
        return (F.max(F.when(test, value)) + F.min(F.when(~test, value))) / 2

    not_below = F.when(below <= first, True).when(below > last, False).otherwise(mean(value < low) >= F.max(low))
    not_above = F.when(upto > last, True).when(upto <= first, False).otherwise(mean(value <= high) <= F.max(high))
    return F.when(n > 0, not_below & not_above)


def exact_distinct(df: DataFrame, columns) -> DataFrame:
    """(column_name, exact): different non-null values.  Each column is read alone, so a shuffled row holds one value."""
    return reduce(DataFrame.unionByName, [
        df.select(F.col(f"`{c}`").alias("value")).distinct().agg(F.lit(c).alias("column_name"), F.count("value").alias("exact")) for c in columns])


def sample_columns(df: DataFrame, n: int = 100, columns=None) -> DataFrame:
    """(column_name, value): of every column the n non-null values, as text, that are least by hash, in one scan.

    The rank limit is applied on the map side, so a task passes on n values of a column at most; what is sampled depends on the
    values alone, so it is repeatable, and the sample of a column is that of ``sample_column``.
    """
    names = list(columns or df.columns)
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(f"_{i}") for i, c in enumerate(names)])
    pairs = ", ".join(f"{sql_string(c)}, `_{i}`" for i, c in enumerate(names))
    long = texts.selectExpr(f"stack({len(names)}, {pairs}) AS (column_name, value)").where("value IS NOT NULL").withColumn("_h", F.md5("value"))
    place = F.row_number().over(Window.partitionBy("column_name").orderBy("_h", "value"))
    return long.withColumn("_place", place).where(F.col("_place") <= n).select("column_name", "value")


#: Digits of the counter of distinct values (2**12 registers: about 1.6 %).
REGISTERS = 12


def column_sketches(df: DataFrame, columns=None) -> DataFrame:
    """Mergeable statistics of all columns of a snapshot, one row each, in one pass: column_name, n, nulls, distinct values and,
    of a numeric or time column, quantiles as sketches.  What is stored of a day is a few kilobytes a column."""
    kinds = dict(df.dtypes)
    names = list(columns or df.columns)
    aggs = []
    for c in names:
        col = F.col(f"`{c}`")
        ordered = kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz") or kinds[c].startswith("decimal")
        number = col.cast("timestamp").cast("double") if kinds[c] in ("date", "timestamp", "timestamp_ntz") else col.cast("double")
        aggs.append(F.struct(
            F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n"), F.count_if(col.isNull()).alias("nulls"),
            F.hll_sketch_agg(col.cast("string"), REGISTERS).alias("distinct"),
            (F.kll_sketch_agg_double(number) if ordered else F.lit(None).cast("binary")).alias("quantiles")))
    return df.agg(F.array(*aggs).alias("s")).select(F.inline("s"))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """The statistics of several snapshots together; no row of them is read again."""
    return sketches.groupBy("column_name").agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"))


def sketched_stats(sketches: DataFrame, ranks=(0.25, 0.5, 0.75)) -> DataFrame:
    """column_name, n, null_frac, n_distinct and quantiles (array of double, null for text) from sketches.

    ``n_distinct`` is within about 1.6 % (one standard error), a quantile's rank within about 1.3 %.  A column without a
    value has no quantiles; an empty snapshot has a null ``null_frac``.
    """
    q = F.array(*[F.kll_sketch_get_quantile_double("quantiles", F.lit(r)) for r in ranks])
    held = F.coalesce(F.kll_sketch_get_n_double("quantiles"), F.lit(0)) > 0
    return sketches.select(
        "column_name", "n", F.try_divide("nulls", "n").alias("null_frac"), F.hll_sketch_estimate("distinct").alias("n_distinct"),
        F.when(held, q).alias("quantiles"))
