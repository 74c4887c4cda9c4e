"""Ion counts to log2 ratios, in long form: one row per analyte and sample.

For studies with more samples than a table can have columns. The plan is the same for ten samples
and for a million: names are rows. Two things are small and are found first: the distinct sample names, with
everything that a name decides (keys, re-runs, route, output name, size of its group), and from them the
cells of the result. Measurements meet their names in one join and are then brought together once, by
(analyte, subject, timepoint): such a group has a row per site and replicate, its references included, so
ratios, the pairs of replicates and their median are expressions over one array.

Rows that a long table lacks are cells that a wide one would hold empty. They stay absent here, and
``expected`` counts of the samples take their place: a replicate that was not measured empties a strict
median, and the statistics count it as a missing value. ``complete`` gives the whole grid where it is wanted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteratio.functions.scalars import (
    RERUN_SUFFIX,
    all_there_text,
    cond_replace,
    log2_text,
    map_timepoint,
    quotient_text,
    replace_seq,
    to_double_text,
)
from siteratio.functions.sqltext import exprs, ident, idents, number, over, present, text
from siteratio.operators.joins import null_safe_join
from siteratio.operators.names import dup_label, split_name
from siteratio.operators.reshape import grid
from siteratio.operators.summarise import filter_regex
from siteratio.plans.cohorts import LIVER_INFLOW, SITE_LABELS, TIME_LABELS
from siteratio.runtime import freeze
from siteratio.schema import (
    ANALYTE,
    NONFINITE,
    ON_MISSING_REF,
    ON_MULTI_REF,
    REPLICATE,
    ROW_ID,
    SAMPLE,
    SITE,
    SUBJECT,
    TIME,
    TIMEPOINT,
    VALUE,
    check_choice,
)

#: Columns of the cells of a result: one row per column that the wide matrix would have.
CELL = [SITE, TIMEPOINT, SUBJECT, SAMPLE]

#: Mixtures that a route can name by its place in this list.
MIXTURES: list[Mapping[str, float]] = [{"FA": 1.0}, {"RV": 1.0}, LIVER_INFLOW]
_FA, _RV, _INFLOW = range(3)


@dataclass(frozen=True)
class Policies:
    """What happens to groups without a reference, with several, and to results that are not finite."""

    on_missing_ref: str = "null"
    on_multi_ref: str = "error"
    nonfinite: str = "null"

    def __post_init__(self) -> None:
        check_choice("on_missing_ref", self.on_missing_ref, ON_MISSING_REF)
        check_choice("on_multi_ref", self.on_multi_ref, ON_MULTI_REF)
        check_choice("nonfinite", self.nonfinite, NONFINITE)


def _or_raise(cond: str, message: str, value: str, kind: str = "string") -> str:
    return f"CASE WHEN {cond} THEN cast(raise_error({message}) AS {kind}) ELSE {value} END"


def _superseded(names: DataFrame) -> DataFrame:
    """sample and ``base``: names that a re-run replaces are gone, re-runs have the name they replace."""
    base = F.regexp_replace(SAMPLE, RERUN_SUFFIX, "")
    replaced = names.filter(F.col(SAMPLE).rlike(RERUN_SUFFIX)).select(base.alias(SAMPLE)).distinct()
    kept = names.join(replaced, SAMPLE, "left_anti").withColumn("base", base)
    several = _or_raise("count(1) OVER (PARTITION BY base) > 1", "concat('more than one re-run of ', base)", "base")
    return kept.selectExpr(SAMPLE, f"{several} AS base")


def _cells_of(routed: DataFrame, min_samples: int, one_each: bool) -> DataFrame:
    """Finish the sample table: ``expected`` samples of a cell, cells that count, keys that are unique.

    ``routed`` has sample, subject, timepoint, site, replicate, label, route (NULL: not measured), the output's site, time and
    subject labels and its name. Every window here runs over names.
    """
    key = over([SUBJECT, TIMEPOINT, SITE, REPLICATE])
    cell = ["label", TIMEPOINT, SUBJECT]
    twice = "concat('samples name the same measurement: ', sample)"
    counted = routed.selectExpr(
        "*",
        f"{_or_raise(f'count(1) {key} > 1', twice, SITE)} AS _site",
        f"count(route) {over(cell)} AS expected",
        f"row_number() {over(cell, 'ORDER BY sample')} = 1 AND route IS NOT NULL AS _first",
        f"min(struct(label, timepoint, subject)) {over(['name'])} AS _one",
        f"max(struct(label, timepoint, subject)) {over(['name'])} AS _other",
    )
    sized = counted.selectExpr("*", f"count_if(_first) {over(['label', TIMEPOINT])} AS _size")
    clash = "route IS NOT NULL AND _one <> _other" + (" OR route IS NOT NULL AND expected > 1" if one_each else "")
    kept = f"route IS NOT NULL AND _size >= {min_samples}"
    return sized.selectExpr(
        SAMPLE,
        SUBJECT,
        TIMEPOINT,
        f"_site AS {SITE}",
        REPLICATE,
        f"CASE WHEN {kept} THEN route END AS route",
        f"CASE WHEN {kept} THEN {_or_raise(clash, 'concat(\'more than one value for \', name)', 'name')} END AS name",
        "expected",
        "out_site",
        "out_time",
        "out_subject",
    )


def single_samples(names: DataFrame, min_samples: int = 3) -> DataFrame:
    """The sample table of the single-value design from distinct ``sample`` names."""
    parsed = split_name(_superseded(names), "base", [SUBJECT, TIMEPOINT, SITE])
    route = (
        f"CASE WHEN site = 'LV' THEN {_RV} WHEN site = 'H' THEN {_INFLOW}"
        f" WHEN site = 'RV' OR contains(site, 'FA') OR contains(subject, 'qc') THEN NULL ELSE {_FA} END"
    )
    label = "CASE site WHEN 'LV' THEN 'Lung' WHEN 'H' THEN 'Liver' ELSE site END"
    routed = (
        parsed.selectExpr(SAMPLE, SUBJECT, TIMEPOINT, SITE, f"'1' AS {REPLICATE}", f"{label} AS label", f"{route} AS route")
        .withColumn("out_site", cond_replace(F.col("label"), SITE_LABELS))
        .withColumn("out_time", replace_seq(F.col(TIMEPOINT), TIME_LABELS.items()))
        .withColumn("out_subject", F.replace(F.col(SUBJECT), F.lit("FP"), F.lit("Ct")))
        .withColumn("name", F.concat_ws("_", "out_site", "out_time", "out_subject"))
    )
    return _cells_of(routed, min_samples, one_each=True)


def replicate_samples(names: DataFrame, secondary: Sequence[str] = ("1.2", "2.2", "3.2")) -> DataFrame:
    """The sample table of the replicated design from distinct ``sample`` names."""
    parsed = split_name(names, SAMPLE, [SUBJECT, TIMEPOINT, SITE, REPLICATE])
    parsed = parsed.withColumn(SUBJECT, F.replace(F.col(SUBJECT), F.lit("HF"), F.lit("")))
    parsed = parsed.filter(~F.col(REPLICATE).isin(*secondary) & ~F.col(SUBJECT).contains("qc"))
    lung = "site = CASE WHEN subject = '1' THEN 'A' ELSE 'LV' END"
    skipped = "contains(site, 'LV') OR contains(site, 'RV') OR contains(site, 'A')"
    route = f"CASE WHEN {lung} THEN {_RV} WHEN site = 'H' THEN {_INFLOW} WHEN {skipped} THEN NULL ELSE {_FA} END"
    label = f"CASE WHEN {lung} THEN 'lung' WHEN site = 'H' THEN 'liver' ELSE site END"
    routed = (
        parsed.selectExpr(SAMPLE, SUBJECT, TIMEPOINT, SITE, REPLICATE, f"{label} AS label", f"{route} AS route")
        .withColumn("out_site", F.lower("label"))
        .withColumn("out_time", F.lower(TIMEPOINT))
        .withColumn("out_subject", F.lower(SUBJECT))
        .withColumn("name", F.concat_ws("_", "out_site", "out_time", "out_subject"))
    )
    return _cells_of(routed, 1, one_each=False)


def _reference_of(policies: Policies) -> str:
    """Aggregate text: the value that a cell with (maybe) several rows stands for as a reference."""
    if policies.on_multi_ref == "mean":
        return f"avg({present(VALUE)})"
    if policies.on_multi_ref == "median":
        return f"median({present(VALUE)})"
    sites = ", ".join(sorted({text(s) for m in MIXTURES for s in m}))
    several = "'several reference rows in one group'"
    return _or_raise(f"count(1) > 1 AND {SITE} IN ({sites})", several, f"max({VALUE})", "double")


def _mixtures(replicates: Sequence[str], policies: Policies) -> list[str]:
    """Per mixture: the array of its values for each reference replicate, NULL where no cell asks for it."""

    def one(site: str) -> str:
        found = f"filter(cells, c -> c.site = {text(site)} AND c.replicate = k)"
        if policies.on_missing_ref == "null":
            return f"get({found}, 0).ref"
        lacks = f"concat('a group lacks its reference {site} ', k)"
        return _or_raise(f"size({found}) = 0", lacks, f"get({found}, 0).ref", "double")

    told = ", ".join(map(text, replicates))
    columns = []
    for i, weights in enumerate(MIXTURES):
        terms = " + ".join(one(s) if w == 1 else f"({one(s)}) * {number(w)}" for s, w in weights.items())
        columns.append(
            f"CASE WHEN exists(cells, c -> c.route = {i}) THEN transform(array({told}), k -> {terms}) END"
        )
    return columns


def long_ratios(
    rows: DataFrame, samples: DataFrame, replicates: Sequence[str], policies: Policies = Policies()
) -> DataFrame:
    """analyte, site, timepoint, subject, sample and value: log2 of the median over all pairs of a cell's samples
    with its reference replicates, NULL as soon as one pair is missing.

    ``rows`` has analyte, sample and value, ``samples`` is a sample table. A group (analyte, subject, timepoint) has a row per
    site and replicate; more rows of one measurement are an error, or are reduced inside tasks where ``on_multi_ref`` allows
    several rows of a reference.
    """
    known = rows.join(samples, SAMPLE)
    keys = [ANALYTE, SUBJECT, TIMEPOINT]
    if policies.on_multi_ref == "error":
        known = known.repartition(*keys)  # so that neither step below shuffles again
    several = "concat('more than one value for ', max(name))"
    cells = known.groupBy(*keys, SITE, REPLICATE).agg(
        *exprs(
            f"{_or_raise('count(1) > 1 AND max(route) IS NOT NULL', several, f'max({VALUE})', 'double')} AS v",
            f"{_reference_of(policies)} AS ref",
            "max(route) AS route",
            "max(struct(name, expected, out_site, out_time, out_subject)) AS out",
        )
    )
    packed = cells.groupBy(*keys).agg(F.expr("collect_list(struct(site, replicate, v, ref, route, out)) AS cells"))
    told = (
        packed.filter("exists(cells, c -> c.route IS NOT NULL)")
        .selectExpr(ANALYTE, "cells", f"array({', '.join(_mixtures(replicates, policies))}) AS refs")
        .selectExpr(
            "*", "explode(array_distinct(transform(filter(cells, c -> c.route IS NOT NULL), c -> struct(c.out, c.route)))) AS o"
        )
    )
    pair = quotient_text("c.v", "r", policies.nonfinite)
    measured = "filter(cells, c -> c.route IS NOT NULL AND c.out.name = o.out.name)"
    pairs = f"sort_array(flatten(transform({measured}, c -> transform(refs[o.route], r -> {pair}))))"
    n = len(replicates)
    there = all_there_text("p[0]", "p[size(p) - 1]", policies.nonfinite)
    if policies.nonfinite == "ieee":
        there = f"({there} OR isnan(p[0]) AND size(p) = 1)"  # a single ratio may be undefined, a median not
    whole = f"size(p) = o.out.expected * {n} AND {there}"
    middle = "CASE WHEN size(p) % 2 = 1 THEN p[size(p) div 2] ELSE (p[size(p) div 2 - 1] + p[size(p) div 2]) / 2 END"
    met = told.selectExpr(ANALYTE, "o", f"{pairs} AS p").selectExpr("*", f"CASE WHEN {whole} THEN {middle} END AS m")
    return met.selectExpr(
        ANALYTE,
        f"o.out.out_site AS {SITE}",
        f"o.out.out_time AS {TIMEPOINT}",
        f"o.out.out_subject AS {SUBJECT}",
        f"o.out.name AS {SAMPLE}",
        f"{log2_text('m', policies.nonfinite)} AS {VALUE}",
    )


def _rows(long: DataFrame, analyte_col: str, sample_col: str, value_col: str) -> DataFrame:
    """analyte, sample and value as a double (text is parsed), and row_id where the table has one."""
    numeric = isinstance(long.schema[value_col].dataType, T.NumericType)
    value = f"cast({ident(value_col)} AS double)" if numeric else to_double_text(f"cast({ident(value_col)} AS string)")
    ids = [ROW_ID] if ROW_ID in long.columns else []
    return long.selectExpr(
        *ids, f"{ident(analyte_col)} AS {ANALYTE}", f"{ident(sample_col)} AS {SAMPLE}", f"{value} AS {VALUE}"
    )


def _tables(counts: DataFrame, samples: DataFrame, replicates: Sequence[str], policies: Policies) -> dict[str, DataFrame]:
    cells = samples.filter("name IS NOT NULL").selectExpr(
        f"out_site AS {SITE}", f"out_time AS {TIMEPOINT}", f"out_subject AS {SUBJECT}", f"name AS {SAMPLE}"
    )
    rows = counts.select(ANALYTE, SAMPLE, VALUE)
    return {
        "ion_counts": counts,
        "log2va": long_ratios(rows, samples, replicates, policies),
        "samples": cells.distinct(),
    }


def job_ratio_single_long(
    long: DataFrame,
    analyte_col: str = ANALYTE,
    sample_col: str = SAMPLE,
    value_col: str = VALUE,
    min_samples: int = 3,
    on_missing_ref: str = "null",
    on_multi_ref: str = "error",
    nonfinite: str = "null",
) -> dict[str, DataFrame]:
    """The single-value job over rows: cleaned counts, log2 ratios, and the cells they can have.

    Rows of equal analyte names (case ignored) are told apart by ``row_id``, if the table has it.
    """
    policies = Policies(on_missing_ref, on_multi_ref, nonfinite)
    counts = _rows(long, analyte_col, sample_col, value_col)
    if ROW_ID in counts.columns:
        counts = dup_label(counts, ANALYTE, ROW_ID)
    samples = freeze(single_samples(counts.select(SAMPLE).distinct(), min_samples))
    return _tables(counts, samples, ["1"], policies)


def job_ratio_replicate_long(
    long: DataFrame,
    analyte_col: str = ANALYTE,
    sample_col: str = SAMPLE,
    value_col: str = VALUE,
    replicates: Sequence[str] = ("1", "2", "3"),
    secondary: Sequence[str] = ("1.2", "2.2", "3.2"),
    on_missing_ref: str = "null",
    on_multi_ref: str = "error",
    nonfinite: str = "null",
) -> dict[str, DataFrame]:
    """The replicated job over rows: cleaned counts, log2 of the median over all pairs, and the cells."""
    policies = Policies(on_missing_ref, on_multi_ref, nonfinite)
    counts = filter_regex(_rows(long, analyte_col, sample_col, value_col).drop(ROW_ID), SAMPLE, "_U_")
    samples = freeze(replicate_samples(counts.select(SAMPLE).distinct(), secondary))
    return _tables(counts, samples, replicates, policies)


def complete(log2: DataFrame, samples: DataFrame, analytes: DataFrame) -> DataFrame:
    """The whole grid of analytes and cells, absent ones as rows without a value."""
    whole = grid(analytes.select(ANALYTE).distinct(), samples.select(*CELL))
    values = log2.select(ANALYTE, SAMPLE, VALUE)
    return null_safe_join(whole, values, [ANALYTE, SAMPLE], "left").selectExpr(*idents([ANALYTE, *CELL, VALUE]))


def with_minutes(table: DataFrame, labels: Mapping[str, float]) -> DataFrame:
    """Add ``time`` in minutes to ratios or cells; another label counts if it is a number."""
    return table.withColumn(TIME, map_timepoint(F.col(TIMEPOINT), labels))
