"""The ratio jobs over rows against the jobs over the wide matrix, and their policies."""

import math
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siteratio.operators.reshape import to_long
from siteratio.plans.cohorts import REPEATED_OUTPUTS, REPLICATED, SINGLE
from siteratio.plans.long import (
    complete,
    job_ratio_replicate_long,
    job_ratio_single_long,
    replicate_samples,
    single_samples,
    with_minutes,
)
from siteratio.plans.ratios import job_ratio_replicate, job_ratio_single
from siteratio.plans.statistics import job_statistics
from siteratio.plans.study import run_study

SINGLE_NAMES = [
    *[f"FP{s}_{t}_{o}" for s in (1, 2, 3, 4) for t in ("000m", "030m") for o in ("FA", "P", "H", "RV", "LV", "C")],
    "FP1_000m_P_20210101",
    *[f"FPqc_000m_{o}" for o in ("FA", "P", "RV", "LV")],
    "FP1_060m_FA",
    "FP1_060m_P",  # too few of this site and time
    "FP5_000m_P",  # no reference at all
    "FP_6_030m_H",  # a surplus underscore stays with the subject
]
REPLICATE_NAMES = [
    *[f"HF{s}_{t}_{o}_{k}" for s in (1, 2) for t in ("000m", "120m") for o in ("FA", "P", "H", "RV", "A", "LV", "CA") for k in (1, 2, 3)],
    "HF2_000m_P_1.2",
    "HF2_000m_U_1",
    "HFqc1_000m_P_1",
    "HF3_000m_P_1",
    "HF3_000m_FA_1",
    "HF3_000m_FA_2",
    "HF3_000m_FA_3",
]


def matrix(spark, names, analytes, first):
    cell = lambda i, j: None if (i * 7 + j) % 23 == 0 else 0.0 if (i + j) % 29 == 3 else float((i * 31 + j * 17) % 101 + 1)
    rows = [(i, a, *[cell(i, j) for j in range(len(names))]) for i, a in enumerate(analytes)]
    rows.append((len(rows), "Empty", *[None] * len(names)))
    schema = f"row_id long, {first} string, " + ", ".join(f"`{n}` double" for n in names)
    return spark.createDataFrame(rows, schema)


def cells(frame):
    value = lambda v: v if v is None or not math.isnan(v) else "NaN"
    return {(r.analyte, r.sample): value(r.value) for r in frame.collect()}


def gridded(tables):
    return cells(complete(tables["log2va"], tables["samples"], tables["ion_counts"]))


def close(a, b):
    assert a.keys() == b.keys()
    for k, v in a.items():
        assert v == b[k] or v == pytest.approx(b[k], rel=1e-12), k


@pytest.mark.parametrize("sparse", [False, True])
@pytest.mark.parametrize("nonfinite", ["null", "ieee"])
def test_single_equals_the_wide_job(spark, sparse, nonfinite):
    wide = matrix(spark, SINGLE_NAMES, ["Val", "val", "Leu"], "analyte")
    long = to_long(wide, ["row_id", "analyte"])
    if sparse:  # rows without a value are left out, but for the analyte that has none
        long = long.filter("value IS NOT NULL OR analyte = 'Empty'")
    tables = job_ratio_single_long(long.repartition(3), nonfinite=nonfinite)
    want = job_ratio_single(wide, nonfinite=nonfinite)
    close(gridded(tables), cells(to_long(want["log2va"], ["analyte"])))
    assert {r.analyte for r in tables["ion_counts"].collect()} == {"Val", "val_duplicate", "Leu", "Empty"}
    assert {r.sample for r in tables["samples"].collect()} == set(want["log2va"].columns) - {"analyte"}


@pytest.mark.parametrize("sparse", [False, True])
@pytest.mark.parametrize("nonfinite", ["null", "ieee"])
def test_replicate_equals_the_wide_job(spark, sparse, nonfinite):
    wide = matrix(spark, REPLICATE_NAMES, ["Val", "Leu"], "Name").drop("row_id")
    long = to_long(wide, ["Name"])
    if sparse:
        long = long.filter("value IS NOT NULL OR Name = 'Empty'")
    tables = job_ratio_replicate_long(long.repartition(3), "Name", nonfinite=nonfinite)
    want = job_ratio_replicate(wide, "Name", nonfinite=nonfinite)
    close(gridded(tables), cells(to_long(want["log2va"], ["analyte"])))
    assert not [r for r in tables["ion_counts"].filter("sample LIKE '%U%'").collect()]


def rows_of(frame, cells_):
    return frame([("m", s, float(v)) for s, v in cells_], "analyte string, sample string, value double")


def one(tables, name):
    return [r.value for r in tables["log2va"].filter(F.col("sample") == name).collect()]


def test_policies(frame):
    few = {"min_samples": 1}
    base = [("FP1_000m_P", 8), ("FP1_000m_FA", 2)]
    assert one(job_ratio_single_long(rows_of(frame, base), **few), "Intestine_0min_Ct1") == [2.0]
    # several rows of the reference
    twice = rows_of(frame, [*base, ("FP1_000m_FA", 6)])
    with pytest.raises(PySparkException, match="several reference rows"):
        job_ratio_single_long(twice, **few)["log2va"].collect()
    for policy in ("mean", "median"):
        assert one(job_ratio_single_long(twice, on_multi_ref=policy, **few), "Intestine_0min_Ct1") == [1.0]
    # several rows of a measured sample are an error under every policy
    again = rows_of(frame, [*base, ("FP1_000m_P", 4)])
    for policy in ("error", "mean"):
        with pytest.raises(PySparkException, match="more than one value|several reference"):
            job_ratio_single_long(again, on_multi_ref=policy, **few)["log2va"].collect()
    # no reference
    alone = rows_of(frame, base[:1])
    assert one(job_ratio_single_long(alone, **few), "Intestine_0min_Ct1") == [None]
    with pytest.raises(PySparkException, match="lacks its reference FA"):
        job_ratio_single_long(alone, on_missing_ref="error", **few)["log2va"].collect()
    # the reference of a cell that does not count may be missing
    assert job_ratio_single_long(alone, on_missing_ref="error")["log2va"].collect() == []
    zero = rows_of(frame, [("FP1_000m_P", 8), ("FP1_000m_FA", 0)])
    assert one(job_ratio_single_long(zero, **few), "Intestine_0min_Ct1") == [None]
    assert one(job_ratio_single_long(zero, nonfinite="ieee", **few), "Intestine_0min_Ct1") == [math.inf]
    for bad in ("on_multi_ref", "on_missing_ref", "nonfinite"):
        with pytest.raises(ValueError, match=bad):
            job_ratio_single_long(alone, **{bad: "?"})


def test_names_that_clash_are_errors(frame):
    with pytest.raises(PySparkException, match="more than one re-run"):
        job_ratio_single_long(rows_of(frame, [("FP1_000m_P_20210101", 1), ("FP1_000m_P_20210102", 1)]))
    # HF1 and 1 are the same subject once the prefix is off
    with pytest.raises(PySparkException, match="same measurement"):
        job_ratio_replicate_long(rows_of(frame, [("HF1_000m_P_1", 1), ("1_000m_P_1", 1)]))
    # LV and Lung would both be Lung
    lungs = [(f"FP{k}_000m_{o}", 1) for k in (1, 2, 3) for o in ("LV", "Lung")]
    with pytest.raises(PySparkException, match="more than one value for Lung"):
        job_ratio_single_long(rows_of(frame, lungs))


def test_text_values_and_empty_tables(frame):
    text = frame([("m", "FP1_000m_P", "8"), ("m", "FP1_000m_FA", "2"), ("m", "FP2_000m_P", "?")], "analyte string, sample string, value string")
    assert one(job_ratio_single_long(text, min_samples=1), "Intestine_0min_Ct1") == [2.0]
    tables = job_ratio_single_long(text.limit(0))
    assert tables["log2va"].count() == 0 and tables["samples"].count() == 0
    assert gridded(tables) == {}


def test_statistics_from_sparse_rows_equal_those_of_the_matrix(spark):
    # the matrix reads keys off its column names again, which a surplus underscore would mislead
    wide = matrix(spark, [n for n in SINGLE_NAMES if "FP_6" not in n], ["Val", "Ile", "Leu"], "analyte")
    log2 = job_ratio_single(wide)["log2va"]
    tables = job_ratio_single_long(to_long(wide, ["row_id", "analyte"]).filter("value IS NOT NULL OR analyte = 'Empty'"))
    analysis, samples = (with_minutes(tables[k], SINGLE.minutes) for k in ("log2va", "samples"))
    only = ["o1_site_fam", "o2_time_fam", "o3_2_ancova", "o6_2_fold"]
    a = job_statistics(log2, SINGLE, only=only)
    b = job_statistics(None, SINGLE, only=only, analysis=analysis, samples=samples, analytes=tables["ion_counts"])
    for name in only:
        left, right = (sorted(map(tuple, t[name].select(*a[name].columns).collect()), key=str) for t in (a, b))
        assert len(left) == len(right), name
        for x, y in zip(left, right):
            for u, v in zip(x, y):
                assert u == v or u == pytest.approx(v, rel=1e-9, abs=1e-12), (name, x, y)


def test_plan_does_not_grow_with_samples(spark):
    """50,000 samples are rows: the plan is the one of ten samples, and every sample has its ratio."""

    def study(subjects):
        sites = "element_at(array('FA', 'P', 'H', 'RV', 'LV'), cast(id % 5 + 1 AS int))"
        return spark.range(0, subjects * 5, 1, 8).selectExpr(
            "explode(array('a', 'b')) AS analyte",
            f"concat('FP', id div 5, '_000m_', {sites}) AS sample",
            "cast(id % 7 + 1 AS double) AS value",
        )

    shape = lambda df: re.findall(r"^[ :+-]*([A-Z]\w+)", df._jdf.queryExecution().executedPlan().toString(), re.MULTILINE)
    small, large = (job_ratio_single_long(study(n))["log2va"] for n in (2 * 5, 10_000))
    assert shape(large) == shape(small) and len(shape(large)) < 40
    assert large.filter("value IS NOT NULL").count() == 2 * 3 * 10_000
    assert large.select("sample").distinct().count() == 3 * 10_000


def test_measurements_are_shuffled_once_after_their_names(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr(
        "event_type AS analyte", "concat('FP', user_id, '_000m_P') AS sample", "value"
    )
    plan = job_ratio_single_long(rows)["log2va"]._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("Exchange hashpartitioning(analyte") == 1


def test_sample_tables_say_what_counts(spark):
    names = spark.createDataFrame([(n,) for n in SINGLE_NAMES], "sample string")
    got = {r.sample: r for r in single_samples(names).collect()}
    assert "FP1_000m_P" not in got and got["FP1_000m_P_20210101"].name == "Intestine_0min_Ct1"
    assert got["FP1_060m_P"].route is None and got["FP1_000m_FA"].route is None
    assert got["FP_6_030m_H"].subject == "FP_6" and got["FP_6_030m_H"].name == "Liver_30min_Ct_6"
    twice = spark.createDataFrame([(n,) for n in REPLICATE_NAMES], "sample string")
    reps = {r.sample: r for r in replicate_samples(twice).collect()}
    assert reps["HF2_000m_P_1"].expected == 3 and reps["HF3_000m_P_1"].expected == 1
    assert reps["HF1_000m_A_1"].name == "lung_000m_1" and reps["HF2_000m_A_1"].route is None
    assert "HF2_000m_P_1.2" not in reps and "HFqc1_000m_P_1" not in reps


@pytest.mark.parametrize("design,cohort", [("single", SINGLE), ("replicate", REPLICATED)])
def test_whole_study_runs_over_rows(spark, tmp_path, design, cohort):
    from siteratio.sources import fixtures as fix

    keyed = fix.keyed_single if design == "single" else fix.keyed_replicate
    rows = keyed(spark, "/root/testdata/sf0.001").selectExpr("analyte AS name", "sample AS id", "value AS area")
    counts = str(tmp_path / "counts")
    rows.coalesce(2).write.option("header", True).option("nullValue", "NA").csv(counts)
    options = {"fmt": "csv", "layout": "long", "sample_col": "id", "value_col": "area", "nonfinite": "null"}
    where = run_study(spark, counts, str(tmp_path / "out"), design, "name", **options)
    assert len(where) == len([*cohort.outputs, *REPEATED_OUTPUTS]) + 3
    table = spark.read.option("header", True).csv(where["o6_2_fold"])
    assert {"analyte", "site", "group2", "p_adj", "median_change", "direction"} <= set(table.columns)
    assert table.count() == 2 * 3 * 3
    with pytest.raises(ValueError, match="layout"):
        run_study(spark, counts, str(tmp_path / "other"), design, "name", layout="?")
