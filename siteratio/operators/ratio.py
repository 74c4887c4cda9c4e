"""Each site divided by a reference site of the same group.

The reference values of a group are conditional aggregates, so they combine
map-side and leave one row per group; the measurements are then joined to that row.
A group that holds a large share of all rows is split by adaptive skew handling,
which a window over the group could not be.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteratio.functions.scalars import divide_safe
from siteratio.functions.sqltext import exprs, ident, idents, number, present, text
from siteratio.operators.joins import null_safe_join
from siteratio.schema import (
    CELL_KEYS,
    ON_MISSING_REF,
    ON_MULTI_REF,
    RATIO,
    REPLICATE,
    SITE,
    VALUE,
    check_choice,
)


def reference_value(cond: str, value: str, on_multi_ref: str = "error") -> str:
    """Aggregate text: the value of the group's one reference row (NULL if there is none)."""
    check_choice("on_multi_ref", on_multi_ref, ON_MULTI_REF)
    picked = f"CASE WHEN {cond} THEN {value} END"
    if on_multi_ref == "mean":
        return f"avg({present(picked)})"
    if on_multi_ref == "median":
        return f"median({present(picked)})"
    several = "cast(raise_error('several reference rows in one group') AS double)"
    return f"CASE WHEN count_if({cond}) > 1 THEN {several} ELSE max({picked}) END"


def weighted_reference(
    site_col: str,
    value_col: str,
    weights: Mapping[str, float],
    also: str | None = None,
    on_multi_ref: str = "error",
) -> str:
    """Aggregate text: weighted sum of reference sites, NULL if one of them is missing."""
    terms = []
    for site, weight in weights.items():
        cond = f"{ident(site_col)} = {text(site)}" + (f" AND {also}" if also else "")
        picked = reference_value(cond, ident(value_col), on_multi_ref)
        terms.append(f"({picked})" if weight == 1 else f"({picked}) * {number(weight)}")
    return " + ".join(terms)


def paired_ratio(
    df: DataFrame,
    keys: Sequence[str] = tuple(CELL_KEYS),
    site_col: str = SITE,
    value_col: str = VALUE,
    ref: str | None = None,
    weights: Mapping[str, float] | None = None,
    replicates: Sequence[str] | None = None,
    replicate_col: str = REPLICATE,
    on_missing_ref: str = "null",
    on_multi_ref: str = "error",
    nonfinite: str = "null",
    out: str = RATIO,
) -> DataFrame:
    """Add ``reference`` (label) and ``out`` = value / reference value of the group.

    ``ref`` names one reference site; ``weights`` a mixture of sites. With
    ``replicates`` every row is divided by each reference replicate in turn (one
    output row per replicate, mixtures pair the same replicate number); a replicate
    the group lacks gives a NULL ratio. The fan-out happens after the join, so the
    shuffle carries each measurement once.
    """
    check_choice("on_missing_ref", on_missing_ref, ON_MISSING_REF)
    if ref is None and not weights:
        raise ValueError("name a reference site or weights")
    mix = dict(weights) if weights else {ref: 1.0}
    name = "".join(mix)
    conds = {
        name + k: f"{ident(replicate_col)} = {text(k)}" for k in replicates or ()
    } or {name: None}
    refs = (
        df.filter(f"{ident(site_col)} IN ({', '.join(map(text, mix))})")
        .groupBy(*keys)
        .agg(
            *exprs(
                *[
                    f"{weighted_reference(site_col, value_col, mix, cond, on_multi_ref)} AS _v{i}"
                    for i, cond in enumerate(conds.values())
                ]
            )
        )
    )
    dealt = ", ".join(
        f"named_struct('reference', {text(label)}, 'v', _v{i})" for i, label in enumerate(conds)
    )
    kept = idents(df.columns)
    joined = null_safe_join(df, refs, keys, "left")
    if len(conds) == 1:
        dealt = joined.selectExpr(*kept, f"{text(name)} AS reference", "_v0 AS _v")
    else:
        fanned = joined.selectExpr(*kept, f"explode(array({dealt})) AS _ref")
        dealt = fanned.selectExpr(*kept, "_ref.reference AS reference", "_ref.v AS _v")
    ref_value = F.col("_v")
    if on_missing_ref == "error":
        ref_value = F.expr(
            "coalesce(_v, cast(raise_error('a group lacks its reference') AS double))"
        )
    ratio = divide_safe(F.col(value_col), ref_value, nonfinite)
    return dealt.withColumn(out, ratio).drop("_v")


def group_scalar(df: DataFrame, keys: Sequence[str], scalars: Mapping[str, str]) -> DataFrame:
    """Attach per-group aggregates (name -> expression text) to every row of the group."""
    per_group = df.groupBy(*keys).agg(*exprs(*[f"{e} AS {ident(n)}" for n, e in scalars.items()]))
    return null_safe_join(df, per_group, keys, "left").selectExpr(*idents([*df.columns, *scalars]))
