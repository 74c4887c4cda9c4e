"""A whole study: raw counts in, ratio tables and statistics tables out."""

from __future__ import annotations

from inspect import signature

from pyspark.sql import SparkSession

from siteratio.operators.summarise import sort_by_keys
from siteratio.plans.cohorts import REPEATED_OUTPUTS, REPLICATED, SINGLE
from siteratio.plans.long import job_ratio_replicate_long, job_ratio_single_long, with_minutes
from siteratio.plans.ratios import job_ratio_replicate, job_ratio_single
from siteratio.plans.statistics import job_statistics
from siteratio.schema import ANALYTE, ROW_ID, SAMPLE, VALUE, check_choice
from siteratio.sources.tables import read_log2, read_long, read_wide, write_stat, write_tables

DESIGNS = {"single": SINGLE, "replicate": REPLICATED}
LAYOUTS = ("wide", "long")
JOBS = {
    ("single", "wide"): job_ratio_single,
    ("replicate", "wide"): job_ratio_replicate,
    ("single", "long"): job_ratio_single_long,
    ("replicate", "long"): job_ratio_replicate_long,
}

#: Columns that identify a row of a statistics table, in print order.
KEY_COLUMNS = ["analyte", "site", "time", "group1", "group2", "effect"]


def run_study(
    spark: SparkSession,
    counts: str,
    out: str,
    design: str,
    analyte_col: str = ANALYTE,
    fmt: str = "parquet",
    layout: str = "wide",
    sample_col: str = SAMPLE,
    value_col: str = VALUE,
    **options,
) -> dict[str, str]:
    """Run both stages and write ``out``/ion_counts, ``out``/log2va and ``out``/statistics/*.

    The stages meet in the log2 ratios on disk. With ``layout="long"`` the counts have a row per analyte and sample
    and so have the ratios; ``out``/samples then lists the cells they can have. ``options`` are those of the ratio job
    (``on_missing_ref``, ``nonfinite``, ``min_samples``; ``replicates``, ``secondary``; ``on_multi_ref`` of the long
    ones, where a measurement can have several rows) and of the statistics
    (``only``, ``p_digits``, ``term``, ``bh_mode``). Returns output name -> location.
    """
    if design not in DESIGNS:
        raise ValueError(f"design must be one of {tuple(DESIGNS)}")
    cohort = DESIGNS[design]
    check_choice("layout", layout, LAYOUTS)
    job = JOBS[design, layout]
    own = {k: options.pop(k) for k in list(options) if k in signature(job).parameters}
    # Hot join partitions are split also where the next step could reuse the partitioning.
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    if layout == "long":
        rows = read_long(spark, counts, analyte_col, sample_col, value_col, fmt)
        where = write_tables(job(rows, analyte_col, sample_col, value_col, **own), out)
        ratios, samples = (with_minutes(spark.read.parquet(where[k]), cohort.minutes) for k in ("log2va", "samples"))
        measured = {"analysis": ratios, "samples": samples, "analytes": spark.read.parquet(where["ion_counts"])}
        log2 = None
    else:
        wide = read_wide(spark, counts, analyte_col, fmt)
        where = write_tables(job(wide if design == "single" else wide.drop(ROW_ID), analyte_col, **own), out)
        log2, measured = read_log2(spark, where["log2va"]), {}
    for name, table in job_statistics(log2, cohort, **measured, **options).items():
        if REPEATED_OUTPUTS.get(name) in where:  # delivered again under another name: its rows are there already
            written = spark.read.option("header", True).csv(where[REPEATED_OUTPUTS[name]])
            where[name] = write_stat(written, f"{out.rstrip('/')}/statistics", name)
            continue
        keys = [c for c in KEY_COLUMNS if c in table.columns]
        where[name] = write_stat(sort_by_keys(table, keys), f"{out.rstrip('/')}/statistics", name)
    return where
