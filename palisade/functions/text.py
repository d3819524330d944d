"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from palisade.functions.patterns import SPACE_CHARS


def strip(col: Column) -> Column:
    """Remove white space of any kind from both ends; only the ends are looked at."""
    return F.btrim(col, F.lit(SPACE_CHARS))


def sql_string(text: str) -> str:
    """``text`` as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression and use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _grown(values: Column, join) -> Column:
    """0 and every prefix fold, by growing an array: for short arrays."""
    return F.aggregate(values, F.array(F.lit(0)),
                       lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x))))


def _running(values: Column, join) -> Column:
    """Inclusive prefix folds of an array of integers, none below 0.

    Folded in blocks of about sqrt(n), which makes n·sqrt(n) work of a page's n hits.
    """
    width = F.ceil(F.sqrt(F.size(values))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / width).cast("int")),
                         lambda k: _grown(F.slice(values, k * width + 1, width), join))
    return let(blocks, lambda parts: let(
        _grown(F.transform(parts, lambda p: F.element_at(p, -1)), join),
        lambda offsets: F.flatten(F.transform(parts, lambda p, k: F.transform(
            F.slice(p, 2, F.size(p) - 1), lambda x: join(F.get(offsets, k), x))))))


def running_sum(values: Column) -> Column:
    return _running(values, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    return _running(values, lambda a, b: F.greatest(a, b))


def first_per_key(items: Column) -> Column:
    """Keep, from an array of structs that begin with ``key``, the least struct of each key.

    Sorting groups equal keys, so no pairwise comparison of the page's findings is made.
    """
    return let(F.array_sort(items), lambda s: F.filter(
        s, lambda x, i: (i == 0) | (F.get(s, i - F.lit(1))["key"] != x["key"])))


def percent(col: Column) -> Column:
    """``NN%``, rounding half to even."""
    return F.concat(F.bround(col * 100, 0).cast("int").cast("string"), F.lit("%"))
