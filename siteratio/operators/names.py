"""Sample and analyte names: keys, duplicates, re-acquired samples."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteratio.functions.scalars import RERUN_SUFFIX, name_part, paste
from siteratio.functions.sqltext import idents
from siteratio.runtime import broadcast_if_small
from siteratio.schema import SAMPLE


def split_name(df: DataFrame, col: str, parts: Sequence[str]) -> DataFrame:
    """Add one column per underscore part of a name held in the rows."""
    n = len(parts)
    return df.withColumns({p: name_part(F.col(col), n, i) for i, p in enumerate(parts, start=1)})


def dup_label(
    df: DataFrame, name_col: str, order_col: str, suffix: str = "duplicate"
) -> DataFrame:
    """Suffix every occurrence of a name but the first, ignoring case.

    The first occurrence is a minimum per name, so names aggregate map-side and only
    repeated names meet the table again; no window holds a whole name group. In a long table
    all rows with one value of ``order_col`` are one occurrence.
    """
    first = (
        df.groupBy(F.lower(name_col).alias("_name"))
        .agg(F.min(order_col).alias("_first"), F.max(order_col).alias("_last"))
        .filter(F.col("_last") > F.col("_first"))
        .drop("_last")
    )
    marked = df.withColumn("_name", F.lower(name_col)).join(
        broadcast_if_small(first), "_name", "left"
    )
    repeated = F.col(order_col) > F.col("_first")
    label = F.when(repeated, paste(F.col(name_col), F.lit(suffix))).otherwise(F.col(name_col))
    return marked.withColumn(name_col, label).selectExpr(*idents(df.columns))


def supersede(df: DataFrame, sample_col: str = SAMPLE, suffix: str = RERUN_SUFFIX) -> DataFrame:
    """Where a sample was re-acquired, keep the re-run under the original name."""
    base = F.regexp_replace(F.col(sample_col), suffix, "")
    replaced = df.filter(F.col(sample_col).rlike(suffix)).select(base.alias(sample_col)).distinct()
    kept = df.join(broadcast_if_small(replaced), sample_col, "left_anti")
    return kept.withColumn(sample_col, base).selectExpr(*idents(df.columns))


def supersede_columns(columns: Sequence[str], suffix: str = RERUN_SUFFIX) -> dict[str, str]:
    """The same rule for the columns of a wide table: kept column -> its final name."""
    replaced = {re.sub(suffix, "", c) for c in columns if re.search(suffix, c)}
    kept = {c: re.sub(suffix, "", c) for c in columns if c not in replaced}
    if len(set(kept.values())) < len(kept):
        raise ValueError("a sample has more than one re-run")
    return kept
