"""Joins whose keys may be missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteratio.functions.sqltext import ident, idents


def null_safe_join(
    a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner", broadcast: bool = False
) -> DataFrame:
    """Equi-join where missing keys match each other; the keys of ``a`` are kept."""
    right = b.selectExpr(
        *[f"{ident(k)} AS {ident('_r_' + k)}" for k in keys],
        *idents(c for c in b.columns if c not in keys),
    )
    if broadcast:
        right = F.broadcast(right)
    same = F.expr(" AND ".join(f"{ident(k)} <=> {ident('_r_' + k)}" for k in keys))
    return a.join(right, same, how).drop(*[f"_r_{k}" for k in keys])


def natural_join(a: DataFrame, b: DataFrame, null_safe: bool = True) -> DataFrame:
    """Inner join on all shared column names; missing keys match each other.

    The shared columns come first. Sorting is left to the sink.
    """
    shared = [c for c in a.columns if c in b.columns]
    if not shared:
        raise ValueError("the tables share no column")
    joined = null_safe_join(a, b, shared) if null_safe else a.join(b, shared, "inner")
    rest = [c for c in [*a.columns, *b.columns] if c not in shared]
    return joined.selectExpr(*idents([*shared, *rest]))
