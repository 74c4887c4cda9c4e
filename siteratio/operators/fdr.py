"""Benjamini-Hochberg adjustment over a whole table or within families."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteratio.functions.scalars import signif_stars
from siteratio.functions.sqltext import ident, idents, over, present
from siteratio.operators.joins import null_safe_join
from siteratio.runtime import freeze
from siteratio.schema import BH_MODES, check_choice

#: Ranges in each halving of p: more of them make smaller window tasks.
RANGES_PER_HALVING = 1024
#: Tests a piece may hold; a range with more of them is cut again.
PIECE_ROWS = 1_000_000

_PLACE = ["_range", "_sub"]


def _pieces(tests: DataFrame, family: Sequence[str]) -> DataFrame:
    """One row per family and piece of it: its tests _c, their least and largest p, the tests in earlier
    pieces (_before) and in the whole family (_m)."""
    cut = tests.filter("_p IS NOT NULL").groupBy(*family, *_PLACE)
    counted = cut.agg(F.expr("count(1) AS _c"), F.expr("min(_p) AS _lo"), F.expr("max(_p) AS _hi"))
    earlier = over(family, "ORDER BY _range, _sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    return freeze(
        counted.selectExpr("*", f"coalesce(sum(_c) {earlier}, 0L) AS _before", f"sum(_c) {over(family)} AS _m")
    )


def _cut(tests: DataFrame, family: Sequence[str], per_halving: int, piece_rows: int) -> tuple[DataFrame, DataFrame]:
    """Tests with the piece they belong to, and the pieces.

    Pieces follow each other in the order of p. The first cut is fixed by the logarithm of p. A piece that holds too
    many tests is cut again: by value, or, where all its p are equal, by the number of the row, because the order of equal
    p does not matter to the step-up rule.
    """
    place = f"CASE WHEN _p > 0 THEN cast(floor(log2(_p) * {per_halving}) AS bigint) ELSE {-(1 << 40)}L END AS _range"
    tests = freeze(tests.selectExpr("*", place, "0L AS _sub", "monotonically_increasing_id() AS _id"))
    pieces = _pieces(tests, family)
    for _ in range(6):  # ten bits of _sub each
        large = pieces.filter(f"_c > {2 * piece_rows}").selectExpr(
            *idents(family), *_PLACE, "_lo", "_hi", f"least(1023L, _c div {piece_rows} + 1) AS _parts"
        )
        if large.isEmpty():
            break
        within = "least(_parts - 1, cast(floor((_p - _lo) / (_hi - _lo) * _parts) AS bigint))"
        part = f"CASE WHEN _lo < _hi THEN {within} WHEN _lo = _hi THEN pmod(xxhash64(_id), _parts) ELSE 0L END"
        kept = [c for c in tests.columns if c != "_sub"]
        tests = freeze(
            null_safe_join(tests, large, [*family, *_PLACE], "left").selectExpr(
                *idents(kept), f"_sub * 1024 + {part} AS _sub"
            )
        )
        pieces = _pieces(tests, family)
    return tests, pieces


def _step_up(tests: DataFrame, pieces: DataFrame, family: Sequence[str], out: str) -> DataFrame:
    """The adjusted p of every test.

    One shuffle brings the tests to their pieces and one sort, from the largest p down, gives their ranks and the
    running minimum. What is seen across a family is one row per piece. The order of equal p is left open: the first of
    them to be met has the least quotient and hands it to the others.
    """
    inside = [*family, *_PLACE]
    down = over(inside, "ORDER BY _p DESC ROWS UNBOUNDED PRECEDING")
    ranked = (
        null_safe_join(tests.filter("_p IS NOT NULL"), pieces.drop("_lo", "_hi"), inside)
        .selectExpr("*", f"_p * _m / (_before + _c + 1 - row_number() {over(inside, 'ORDER BY _p DESC')}) AS _q")
        .selectExpr("*", f"min(_q) {down} AS _low")
    )
    later = over(family, "ORDER BY _range DESC, _sub DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    least = (
        ranked.groupBy(*inside).agg(F.expr("min(_q) AS _least")).selectExpr(*idents(inside), f"min(_least) {later} AS _later")
    )
    found = null_safe_join(ranked, least, inside).withColumn(out, F.expr("least(1D, _low, _later)"))
    columns = [*[c for c in tests.columns if c not in ("_range", "_sub", "_id")], out]
    # tests without p take no part
    return found.select(*columns).unionByName(
        tests.filter("_p IS NULL").selectExpr("*", f"cast(NULL AS double) AS {ident(out)}").select(*columns)
    )


def bh_adjust(
    df: DataFrame,
    p: str = "p",
    family: Sequence[str] = (),
    mode: str = "auto",
    p_digits: int | None = None,
    out: str = "p_adj",
    per_halving: int = RANGES_PER_HALVING,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Add the adjusted p-value; tests without a p-value stay outside the family.

    All modes give the same values in the same way, in pieces that are small whatever the size of
    a family and however often a p repeats. ``p_digits`` first rounds p to significant digits.
    """
    check_choice("mode", mode, BH_MODES)
    value = present(ident(p))
    if p_digits is not None:
        # Through the decimal text, so that equal digits give equal numbers.
        rounded = f"cast(format_string('%.{p_digits - 1}e', {value}) AS double)"
        value = f"CASE WHEN {value} IS NOT NULL THEN {rounded} END"
    tests = df.selectExpr("*", f"{value} AS _p")
    # The finished tests are computed once, here.
    adjusted = _step_up(*_cut(tests, list(family), per_halving, piece_rows), list(family), out)
    if p_digits is not None:
        adjusted = adjusted.withColumn(p, F.col("_p"))
    return adjusted.selectExpr(*idents([*df.columns, out]))


def add_stars(df: DataFrame, p_adj: str = "p_adj", out: str = "p_adj_signif") -> DataFrame:
    return df.withColumn(out, signif_stars(p_adj))
