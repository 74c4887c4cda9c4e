"""Plans keep the properties that matter at scale."""

import pathlib
import re

import pytest

import __spark_entry__ as entry
from checks.common import ORACLE, QUERIES
from checks.basics import line_log2
from siteratio.operators import stattests as st
from siteratio.operators.ratio import paired_ratio
from siteratio.plans.study import run_study
from siteratio.runtime import checkpoint_root, freeze, scratch_path
from siteratio.sources import fixtures as fix

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(entry.queries())


def test_no_pairwise_products_and_no_row_wise_python(spark):
    for name in ("ratio_replicate_ref", "ttest_detailed", "ancova_site_time", "densify", "natural_merge", "supersede_anti"):
        text = plan(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name
        assert "BatchEvalPython" not in text, name


def test_python_runs_only_on_finished_tests(spark):
    text = plan(st.ttest_one_sample(line_log2(spark, SF), ["analyte", "site"]))
    assert text.count("ArrowEvalPython") == 1
    # Above the final aggregate: everything below it is JVM code.
    assert text.index("ArrowEvalPython") < text.index("HashAggregate")


def test_ratio_filters_reach_the_scan_and_rows_are_not_windowed(spark):
    keyed = spark.read.parquet(f"{SF}/orders.parquet").selectExpr(
        "o_custkey AS analyte", "o_orderpriority AS subject", "o_orderdate AS timepoint",
        "o_orderstatus AS site", "o_totalprice AS value",
    )
    text = plan(paired_ratio(keyed, ref="F", on_multi_ref="mean"))
    assert "EqualTo(o_orderstatus,F)" in text and "Window" not in text
    assert "o_orderkey" not in text


def test_scans_read_only_needed_columns(spark):
    text = plan(fix.lineitem_keyed(spark, SF))
    schema = re.search(r"ReadSchema: struct<([^>]*)", text).group(1)
    assert "l_quantity" not in schema and "l_extendedprice" in schema


def test_frozen_data_goes_to_the_folder_the_session_names(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_root(spark) == root and scratch_path(spark, "x").startswith(root)
    before = {p for p in pathlib.Path(root).rglob("part-*")}
    assert freeze(spark.range(5)).count() == 5
    assert {p for p in pathlib.Path(root).rglob("part-*")} - before


@pytest.mark.parametrize("design,tables", [("single", 17), ("replicate", 16)])
def test_whole_study_runs_from_files(spark, tmp_path, design, tables):
    wide = fix.wide_single(spark, SF) if design == "single" else fix.wide_replicate(spark, SF)
    counts = str(tmp_path / "counts")
    wide.coalesce(1).write.option("header", True).option("nullValue", "NA").csv(counts)
    where = run_study(spark, counts, str(tmp_path / "out"), design, fmt="csv")
    assert len(where) == tables + 2
    table = spark.read.option("header", True).csv(where["o6_2_fold"])
    assert {"analyte", "site", "group2", "p_adj", "median_change", "direction"} <= set(table.columns)
    assert table.count() == 2 * 3 * 3
