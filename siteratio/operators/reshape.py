"""Wide to long, long to wide, and completing the analyte x sample grid."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteratio.functions.scalars import NUMERIC_SHAPE, name_parts_text, to_double_text
from siteratio.functions.sqltext import ident, idents, number, over, present, text
from siteratio.operators.joins import null_safe_join
from siteratio.operators.summarise import RANGE_ROWS, before_range, ranged
from siteratio.runtime import freeze
from siteratio.schema import ANALYTE, ON_DUPLICATE, SAMPLE, SITE, TIME, VALUE, check_choice


#: Numbers of columns that a row of a grid gets at once.
GRID_BLOCK = 1000


def drop_cols_like(df: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """Drop columns whose name matches; the scan never reads them."""
    rx = re.compile(pattern, re.IGNORECASE if ignore_case else 0)
    return df.selectExpr(*[ident(c) for c in df.columns if not rx.search(c)])


def lower_names(df: DataFrame) -> DataFrame:
    """Lower-case every column name; refuses names that would collide."""
    lowered = [c.lower() for c in df.columns]
    if len(set(lowered)) < len(lowered):
        raise ValueError("column names collide when lower-cased")
    return df.toDF(*lowered)


def measures(df: DataFrame, ids: Sequence[str]) -> dict[str, str]:
    """Measure columns as double expressions: numeric ones are cast, text ones parsed."""
    return {
        f.name: f"cast({ident(f.name)} AS double)"
        if isinstance(f.dataType, T.NumericType)
        else to_double_text(f"cast({ident(f.name)} AS string)")
        for f in df.schema
        if f.name not in ids
    }


def to_long(
    df: DataFrame,
    ids: Sequence[str] | None = None,
    sample_col: str = SAMPLE,
    value_col: str = VALUE,
) -> DataFrame:
    """Wide to long, empty cells kept as rows.

    Without ``ids`` the non-numeric columns identify the row and the numeric ones
    are measured.
    """
    if ids is None:
        ids = [f.name for f in df.schema if not isinstance(f.dataType, T.NumericType)]
    cells = measures(df, ids)
    return unstack(df, ids, list(cells.values()), [sample_col], [[text(n)] for n in cells], value_col)


def to_keyed(
    df: DataFrame,
    ids: Sequence[str],
    parts: Sequence[str],
    sample_col: str = SAMPLE,
    value_col: str = VALUE,
) -> DataFrame:
    """Wide to long with the key columns read off the sample names.

    The names are column names, so they are split once on the driver and enter the
    plan as one constant array; rows pay an index lookup instead of a regex per key.
    """
    cells = measures(df, ids)
    fields = [sample_col, *parts]
    keys = [[text(v) for v in (n, *name_parts_text(n, len(parts)))] for n in cells]
    return unstack(df, ids, list(cells.values()), fields, keys, value_col)


def unstack(
    df: DataFrame,
    ids: Sequence[str],
    cells: Sequence[str],
    fields: Sequence[str],
    keys: Sequence[Sequence[str]],
    value_col: str,
) -> DataFrame:
    """One row per cell expression, tagged with that cell's key fields (SQL literals).

    The cells become one array and the keys one constant array, so the plan stays small
    for thousands of columns (an unpivot expands into one projection per column).
    """
    structs = [
        "named_struct("
        + ", ".join(f"{text(f)}, {v}" for f, v in zip(fields, values))
        + ")"
        for values in keys
    ]
    long = df.selectExpr(
        *idents(ids), f"posexplode(array({', '.join(cells)})) AS (_i, {ident(value_col)})"
    ).selectExpr(
        *idents(ids),
        f"element_at(array({', '.join(structs)}), _i + 1) AS _k",
        ident(value_col),
    )
    return long.selectExpr(
        *idents(ids), *[f"_k.{ident(f)} AS {ident(f)}" for f in fields], ident(value_col)
    )


def observed_values(df: DataFrame, col: str) -> list[str]:
    """Distinct values of a bounded label column, sorted.

    This is the column list of a wide table, so it must fit a schema: more values
    than ``spark.sql.pivotMaxValues`` is an error, not a truncation.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    found = df.select(col).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} values in {col}: keep the table in long form")
    if any(r[0] is None for r in found):
        raise ValueError(f"{col} has missing labels: name them before they become columns")
    return sorted(r[0] for r in found)


def _one_value(value: str) -> str:
    """The only row's value of a group; a second row is an error inside the plan."""
    several = "cast(raise_error('more than one row for a cell') AS double)"
    return f"CASE WHEN count(1) > 1 THEN {several} ELSE first({ident(value)}) END"


def assert_unique(
    df: DataFrame, keys: Sequence[str], value_col: str = VALUE, on_duplicate: str = "error"
) -> DataFrame:
    """One row per key.

    ``error`` stops at a repeated key. ``count`` follows the rule of a cast without
    an aggregate: as soon as one key repeats, every cell becomes its row count.
    """
    check_choice("on_duplicate", on_duplicate, ON_DUPLICATE)
    if on_duplicate == "error":
        return df.groupBy(*keys).agg(F.expr(f"{_one_value(value_col)} AS {ident(value_col)}"))
    cells, repeated = _counted(df, keys, value_col)
    cell = F.when(repeated, F.col("_count").cast("double")).otherwise(F.col("_value"))
    return cells.select(*keys, cell.alias(value_col))


def _counted(df: DataFrame, keys: Sequence[str], value_col: str) -> tuple[DataFrame, Column]:
    """Per key its rows and one of its values, and whether any key repeats: a subquery over the same aggregate,
    which runs when the result does."""
    cells = df.groupBy(*keys).agg(F.expr("count(1) AS _count"), F.expr(f"first({ident(value_col)}) AS _value"))
    return cells, cells.agg(F.expr("coalesce(max(_count), 0L) > 1")).scalar()


def to_wide(
    df: DataFrame,
    row: str,
    col: str,
    value_col: str,
    cols: Sequence[str] | None = None,
    on_duplicate: str = "error",
) -> DataFrame:
    """Long to wide, one column per label in ``cols`` (found by a distinct when omitted).

    A missing label, or one that ``cols`` does not list, has no column to go to: an error.
    """
    check_choice("on_duplicate", on_duplicate, ON_DUPLICATE)
    names = list(cols) if cols is not None else observed_values(df, col)
    told = f"concat('no column for label ', coalesce(cast({ident(col)} AS string), 'NULL'))"
    listed = f"{ident(col)} IN ({', '.join(map(text, names))})" if names else "false"
    placed = df.withColumn(
        col, F.expr(f"CASE WHEN {listed} THEN {ident(col)} ELSE cast(raise_error({told}) AS string) END")
    )
    if on_duplicate == "count":
        cells, repeated = _counted(placed, [row, col], value_col)
        wide = cells.groupBy(row).pivot(col, names).agg(F.first(F.struct("_count", "_value")))
        cell = lambda c: F.when(repeated, F.coalesce(F.col(f"{ident(c)}._count"), F.lit(0)).cast("double")).otherwise(
            F.col(f"{ident(c)}._value")
        )
        return wide.select(row, *[cell(c).alias(c) for c in names])
    return placed.groupBy(row).pivot(col, names).agg(F.expr(_one_value(value_col)))


def numbered(df: DataFrame, out: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Distinct rows numbered 1, 2, ... in order, range by range, so no task sees them all."""
    keys = df.columns
    cut = ranged(df.distinct(), keys, range_rows)
    before = before_range(cut.withColumn("_one", F.lit(1).cast("long")), [], "_one")
    inside = over(["_range"], "ORDER BY " + ", ".join(idents(keys)))
    return cut.join(before.select("_range", "_before"), "_range").selectExpr(
        *idents(keys), f"_before + row_number() {inside} AS {ident(out)}"
    )


def grid(rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Every row of ``rows`` with every row of ``cols``, both distinct, of any number and type.

    The rows of ``cols`` are numbered; a row first gets the numbers of its blocks, each a row of its own that can
    be dealt out, and a block the numbers inside it. No array is longer than a block or the number of blocks.
    """
    numbers = freeze(numbered(cols, "_g"))
    count = numbers.count()
    blocks = rows.selectExpr("*", f"explode(sequence(0L, {max(count - 1, 0)}L div {GRID_BLOCK})) AS _b")
    if count > GRID_BLOCK:
        blocks = blocks.repartition(*idents(rows.columns), "_b")
    inside = f"explode(sequence(_b * {GRID_BLOCK} + 1, least((_b + 1) * {GRID_BLOCK}, {count}L))) AS _g"
    placed = blocks.filter(F.lit(count > 0)).selectExpr(*idents(rows.columns), inside)
    return placed.join(numbers, "_g").select(*idents(rows.columns), *idents(cols.columns))


def densify(
    df: DataFrame, row_keys: Sequence[str], col_keys: Sequence[str], value_col: str = VALUE
) -> DataFrame:
    """Complete the grid row_keys x observed col_keys, absent cells as NULL rows.

    The distinct column keys are numbered, every row key gets all numbers, block by block, and the typed
    keys and the values are joined back: any type of key, missing ones included, any number of
    them. The grid is as large as it must be; where only its counts are wanted use
    ``expected_rows``. A second row for a cell is an error.
    """
    keyed = [*row_keys, *col_keys]
    cells = df.groupBy(*keyed).agg(F.expr(f"{_one_value(value_col)} AS {ident(value_col)}"))
    whole = grid(df.select(*row_keys).distinct(), df.select(*col_keys))
    return null_safe_join(whole, cells, keyed, "left").select(*keyed, value_col)


def expected_rows(
    df: DataFrame,
    row_keys: Sequence[str],
    group_keys: Sequence[str],
    sample_keys: Sequence[str],
    value_col: str = VALUE,
) -> DataFrame:
    """Per row key and group: the rows its completed grid would have, and the values present.

    A group (a site and time, say) has as many rows for every row key as samples were seen in
    it anywhere. This is what counts and strict medians need of the grid, without the grid:
    ``rows`` - ``present`` cells are missing. Row keys that a group has no row for don't appear.
    """
    samples = df.select(*group_keys, *sample_keys).distinct()
    size = samples.groupBy(*group_keys).agg(F.count(F.lit(1)).alias("rows"))
    present_ = df.groupBy(*row_keys, *group_keys).agg(
        F.expr(f"count({present(ident(value_col))}) AS present")
    )
    joined = null_safe_join(present_, size, group_keys)
    return joined.select(*row_keys, *group_keys, "rows", "present")


def to_analysis(wide: DataFrame, labels: dict[str, float], analyte_col: str = ANALYTE) -> DataFrame:
    """log2 matrix to (analyte, site, time, sample, value), empty cells as NULL rows.

    ``labels`` maps time labels to minutes; another label counts if it is a number.
    """
    cells = measures(wide, [analyte_col])
    keys = []
    for name in cells:
        site, label, _ = name_parts_text(name, 3)
        minutes = labels.get(label)
        if minutes is None and re.match(NUMERIC_SHAPE, label):
            minutes = float(label)
        time = "cast(NULL AS double)" if minutes is None else number(minutes)
        keys.append([text(site), time, text(name)])
    long = unstack(
        wide, [analyte_col], list(cells.values()), [SITE, TIME, SAMPLE], keys, VALUE
    )
    return long.withColumnRenamed(analyte_col, ANALYTE)
