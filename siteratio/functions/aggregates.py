"""Aggregate expressions with explicit treatment of missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteratio.functions.scalars import clean


def _complete(x: Column) -> Column:
    return F.count(x) == F.count(F.lit(1))


def median_strict(c: Column) -> Column:
    """Median, NULL as soon as one value of the group is missing."""
    x = clean(c)
    return F.when(_complete(x), F.median(x))


def median_skip(c: Column) -> Column:
    """Median of the values that are present."""
    return F.median(clean(c))


def mean_strict(c: Column) -> Column:
    """Mean, NULL as soon as one value of the group is missing."""
    x = clean(c)
    return F.when(_complete(x), F.avg(x))


def group_rows() -> Column:
    """Rows of the group, missing values included."""
    return F.count(F.lit(1))
