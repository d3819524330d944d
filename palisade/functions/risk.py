"""The ordered risk labels as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from palisade.rules import RISK_LEVELS, RISK_RANK


def rank(label: Column) -> Column:
    """0..3; anything unknown or missing counts as low."""
    expr = F.lit(0)
    for name, value in RISK_RANK.items():
        if value:
            expr = F.when(label == name, F.lit(value)).otherwise(expr)
    return expr


def label(rank_col: Column) -> Column:
    expr = F.lit(RISK_LEVELS[0])
    for value, name in enumerate(RISK_LEVELS):
        if value:
            expr = F.when(rank_col == value, F.lit(name)).otherwise(expr)
    return expr


def normalize(risk: Column) -> Column:
    return F.when(risk.isin(*RISK_LEVELS), risk).otherwise(F.lit("low"))


def count_rank(flags: Column) -> Column:
    """Risk rank implied by the number of flags alone."""
    return F.when(flags >= 10, 3).when(flags >= 5, 2).when(flags >= 2, 1).otherwise(0)


def array_rank(findings: Column) -> Column:
    """Highest rank in an array of findings; none means low."""
    return F.coalesce(F.array_max(F.transform(findings, lambda f: rank(f["risk_level"]))), F.lit(0))
