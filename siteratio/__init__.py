"""Paired-ratio analysis of measurement matrices on Spark."""

from siteratio.operators.fdr import add_stars, bh_adjust
from siteratio.operators.joins import natural_join
from siteratio.operators.names import dup_label, split_name, supersede
from siteratio.operators.ratio import group_scalar, paired_ratio
from siteratio.operators.reshape import (
    assert_unique,
    densify,
    expected_rows,
    drop_cols_like,
    lower_names,
    to_analysis,
    to_keyed,
    to_long,
    to_wide,
)
from siteratio.operators.selection import group_median
from siteratio.operators.stattests import (
    ancova,
    anova_oneway,
    anova_time,
    ttest_one_sample,
    ttest_pairs,
    ttest_welch,
)
from siteratio.operators.summarise import (
    baseline_delta,
    filter_group_size,
    filter_regex,
    sort_by_keys,
)
from siteratio.plans.long import job_ratio_replicate_long, job_ratio_single_long
from siteratio.plans.ratios import job_ratio_replicate, job_ratio_single
from siteratio.plans.statistics import job_statistics
from siteratio.plans.study import run_study
from siteratio.sources.tables import read_log2, read_long, read_wide, write_stat, write_tables

__all__ = [
    "add_stars",
    "ancova",
    "anova_oneway",
    "anova_time",
    "assert_unique",
    "baseline_delta",
    "bh_adjust",
    "densify",
    "expected_rows",
    "drop_cols_like",
    "dup_label",
    "filter_group_size",
    "filter_regex",
    "group_median",
    "group_scalar",
    "job_ratio_replicate",
    "job_ratio_replicate_long",
    "job_ratio_single",
    "job_ratio_single_long",
    "job_statistics",
    "lower_names",
    "natural_join",
    "paired_ratio",
    "read_log2",
    "read_long",
    "read_wide",
    "run_study",
    "sort_by_keys",
    "split_name",
    "supersede",
    "to_analysis",
    "to_keyed",
    "to_long",
    "to_wide",
    "ttest_one_sample",
    "ttest_pairs",
    "ttest_welch",
    "write_stat",
    "write_tables",
]
