"""Filters by group size, ordered ranges, change from baseline."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteratio.functions.sqltext import exprs, ident, idents, number, over
from siteratio.operators.joins import null_safe_join
from siteratio.operators.ratio import reference_value
from siteratio.runtime import freeze

#: Most bytes of a pattern made of labels.
PATTERN_BYTES = 1 << 20
#: Rows one ordered range should hold.
RANGE_ROWS = 500_000


def filter_regex(df: DataFrame, col: str, pattern: str, keep: bool = False) -> DataFrame:
    """Keep or drop rows whose text matches; a missing text never matches."""
    hit = F.coalesce(F.col(col).rlike(pattern), F.lit(False))
    return df.filter(hit if keep else ~hit)


def filter_group_size(df: DataFrame, keys: Sequence[str], min_rows: int) -> DataFrame:
    """Keep groups of at least ``min_rows`` rows, rows with missing values counted.

    Counting combines map-side; the semi join that follows can be split by adaptive
    skew handling where one group is huge.
    """
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows)
    return null_safe_join(df, big, keys, "left_semi")


def collapse_alternatives(
    df: DataFrame, keys: Sequence[str], col: str, out: str = "pattern", max_bytes: int = PATTERN_BYTES
) -> DataFrame:
    """Per group, the distinct texts of ``col`` as one anchored alternation, in text order.

    Texts are made distinct before they are brought together, so a group of any size leaves its tasks as its labels. A
    pattern of more than ``max_bytes`` is an error, raised before the texts beyond it are collected: match
    against so many by an anti join. A group without texts gets the empty pattern.
    """
    c = ident(col)
    texts = df.selectExpr(*idents(keys), f"{c} AS _text").distinct()
    size = f"sum(coalesce(octet_length(_text) + 3, 0)) {over(keys, 'ORDER BY _text ROWS UNBOUNDED PRECEDING')}"
    told = f"'a pattern of more than {max_bytes} bytes: use an anti join'"
    within = f"CASE WHEN {size} > {max_bytes + 1} THEN cast(raise_error({told}) AS string) ELSE _text END"
    anchored = texts.selectExpr(*idents(keys), f"{within} AS _text").selectExpr(
        *idents(keys), "concat('^', _text, '$') AS _text"
    )
    return anchored.groupBy(*keys).agg(F.expr(f"array_join(array_sort(collect_list(_text)), '|') AS {ident(out)}"))


def ranged(df: DataFrame, order: Sequence[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Cut distinct rows into ordered ranges of bounded size, frozen with a ``_range`` number.

    The rows are frozen before they are counted and again once numbered, so every later
    use sees the same ranges. Rows must be distinct in ``order``: then no single value
    can overfill a range.
    """
    rows = freeze(df)
    parts = max(1, -(-rows.count() // range_rows))
    return freeze(
        rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    )


def before_range(
    ranges: DataFrame, keys: Sequence[str], weight: str, out: str = "_before"
) -> DataFrame:
    """Per (keys, range): total weight of the same keys in earlier ranges.

    The input to the window is one row per key and range, not the data.
    """
    sums = ranges.groupBy(*keys, "_range").agg(F.expr(f"sum({weight}) AS _w"))
    earlier = over(keys, "ORDER BY _range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    return sums.selectExpr("*", f"coalesce(sum(_w) {earlier}, 0L) AS {out}")


def baseline_delta(
    df: DataFrame,
    keys: Sequence[str],
    time_col: str,
    value_cols: Mapping[str, str],
    baseline: float = 0,
    on_multi_ref: str = "error",
) -> DataFrame:
    """|value - value at baseline| per group; the baseline rows themselves are dropped.

    ``value_cols`` maps a value column to the name of its change column.
    """
    at_base = f"{ident(time_col)} = {number(baseline)}"
    base = (
        df.filter(at_base)
        .groupBy(*keys)
        .agg(
            *exprs(
                *[
                    f"{reference_value(at_base, ident(v), on_multi_ref)} AS {ident('_b_' + v)}"
                    for v in value_cols
                ]
            )
        )
    )
    return (
        null_safe_join(df.filter(f"NOT ({at_base})"), base, keys, "left")
        .selectExpr(
            *idents(df.columns),
            *[f"abs({ident(v)} - {ident('_b_' + v)}) AS {ident(o)}" for v, o in value_cols.items()],
        )
    )


def sort_by_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Global order by keys, for the sink.

    The other columns break ties, so the order is reproducible and a key that holds
    many rows still spreads over several output ranges.
    """
    return df.orderBy(*keys, *[c for c in df.columns if c not in keys])


def with_columns_from(df: DataFrame, cols: Mapping[str, Column]) -> DataFrame:
    """Attach derived columns to the same rows."""
    return df.withColumns(dict(cols))
