"""Exact medians per group by counting, one way for every group size.

Values fall into buckets that keep their order: first by sign and size (so many buckets for each
halving), later by their place between the least and the largest value of a bucket. A bucket is a
count, a minimum and a maximum, so buckets combine map-side and a group that holds a third of all
rows reaches the next task as a few hundred of them. Running counts find the bucket with the
middle ranks; if it has one distinct value, or the rank is its first or last, the value is known.
Only groups whose middle is still open are read again, and only their rows between the two
bounds; every pass separates at least those bounds, so it ends. A group of a few rows is nearly
always settled by the first pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from siteratio.functions.sqltext import exprs, ident, idents, over, present
from siteratio.operators.joins import null_safe_join
from siteratio.runtime import freeze

#: Buckets of the first pass for each halving of a value, and of a later pass between two bounds.
PER_HALVING = 1024
SPLITS = 1 << 20

#: Beyond any logarithm of a double times the buckets of a halving.
_FAR = 1 << 40


def _by_size(x: str, per_halving: int) -> str:
    """Bucket number of a value, rising with it; NULL if it is missing."""
    size = f"least(floor(log2(abs({x})) * {per_halving}), {_FAR - 1}L)"
    return f"CASE WHEN {x} = 0 THEN 0L WHEN {x} > 0 THEN {_FAR}L + {size} WHEN {x} < 0 THEN -{_FAR}L - {size} END"


def _middle(buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group: its sizes, the two middle values as far as known, and the bounds of the open bucket.

    ``buckets`` has keys, _d, _c, _lo, _hi, _skip (values below the first bucket) and, for the whole group, _n rows
    and _present values. The window sees a group's buckets, not its rows.
    """
    last = f"_skip + sum(_c) {over(keys, 'ORDER BY _d ROWS UNBOUNDED PRECEDING')}"
    ranked = buckets.selectExpr("*", f"{last} AS _last").selectExpr(
        "*", "_last - _c AS _first", "(_present + 1) div 2 AS _from", "_present div 2 + 1 AS _to"
    )

    def known(rank: str) -> str:
        here = f"_first < {rank} AND {rank} <= _last"
        return f"CASE WHEN {here} AND (_lo = _hi OR {rank} = _first + 1) THEN _lo WHEN {here} AND {rank} = _last THEN _hi END"

    def open_(rank: str) -> str:
        return f"(_first + 1 < {rank} AND {rank} < _last AND _lo < _hi)"

    still = f"({open_('_from')} OR {open_('_to')})"
    return ranked.groupBy(*keys).agg(
        *exprs(
            "max(_n) AS _n",
            "max(_present) AS _present",
            f"max({known('_from')}) AS _a",
            f"max({known('_to')}) AS _b",
            f"max(CASE WHEN {still} THEN _lo END) AS _low",
            f"max(CASE WHEN {still} THEN _hi END) AS _high",
            f"max(CASE WHEN {still} THEN _first END) AS _below",
        )
    )


def group_median(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str = "median",
    strict: bool = True,
    per_halving: int = PER_HALVING,
    splits: int = SPLITS,
) -> DataFrame:
    """Exact median per group, NULL if ``strict`` and a value is missing (NaN counts as missing).

    A group without values keeps its row; missing keys are a group of their own.
    """
    rows = df.selectExpr(*idents(keys), f"{present(ident(value))} AS _x")
    counts = "count(_x) AS _c", "min(_x) AS _lo", "max(_x) AS _hi"
    sized = (
        rows.selectExpr("*", f"{_by_size('_x', per_halving)} AS _d")
        .groupBy(*keys, "_d")
        .agg(*exprs("count(1) AS _rows", *counts))
        .selectExpr("*", "0L AS _skip", f"sum(_rows) {over(keys)} AS _n", f"sum(_c) {over(keys)} AS _present")
    )
    found = freeze(_middle(sized, keys))
    known = found.drop("_low", "_high", "_below")
    while True:
        open_ = found.filter("_low IS NOT NULL").select(*keys, "_n", "_present", "_low", "_high", "_below")
        if open_.isEmpty():
            break
        place = f"cast(floor((_x - _low) / (_high - _low) * {splits}) AS bigint) AS _d"
        inside = null_safe_join(rows.filter("_x IS NOT NULL"), open_, keys).filter("_x BETWEEN _low AND _high")
        cut = (
            inside.selectExpr("*", place)
            .groupBy(*keys, "_d")
            .agg(*exprs(*counts, "max(_below) AS _skip", "max(_n) AS _n", "max(_present) AS _present"))
        )
        found = freeze(_middle(cut, keys))
        both = known.unionByName(found.select(*known.columns))
        known = both.groupBy(*keys).agg(*exprs(*[f"max({c}) AS {c}" for c in ("_n", "_present", "_a", "_b")]))
    whole = "_present = _n" if strict else "true"
    middle = "CASE WHEN _a = _b THEN _a ELSE _a * 0.5D + _b * 0.5D END + 0D"
    return known.selectExpr(*idents(keys), f"CASE WHEN {whole} THEN {middle} END AS {ident(out)}")
