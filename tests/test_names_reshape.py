import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siteratio.functions import scalars as fx
from siteratio.operators.names import dup_label, split_name, supersede, supersede_columns
from siteratio.operators import reshape
from siteratio.operators.reshape import (
    assert_unique,
    densify,
    expected_rows,
    drop_cols_like,
    lower_names,
    to_keyed,
    to_long,
    to_wide,
)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_dup_label_ignores_case_and_follows_row_order(frame):
    df = frame(
        [(1, "Valine"), (2, "valine"), (3, "VALINE"), (4, "Leucine")], "row_id long, name string"
    )
    got = dict(rows(dup_label(df, "name", "row_id"), "row_id", "name"))
    assert got == {1: "Valine", 2: "valine_duplicate", 3: "VALINE_duplicate", 4: "Leucine"}


def test_supersede_with_and_without_reruns(frame):
    names = ["FP1_000m_FA", "FP1_000m_FA_20210315", "FP2_000m_FA"]
    df = frame([(n, float(i)) for i, n in enumerate(names)], "sample string, value double")
    assert rows(supersede(df), "sample", "value") == [("FP1_000m_FA", 1.0), ("FP2_000m_FA", 2.0)]
    plain = df.filter("sample = 'FP2_000m_FA'")
    assert rows(supersede(plain), "sample") == [("FP2_000m_FA",)]
    assert supersede_columns(names) == {
        "FP1_000m_FA_20210315": "FP1_000m_FA",
        "FP2_000m_FA": "FP2_000m_FA",
    }
    with pytest.raises(ValueError):
        supersede_columns(["a_20210101", "a_20210202"])


def test_name_joins_also_work_shuffled(frame, monkeypatch):
    """Beyond the broadcast bound the same results come from a shuffle join."""
    monkeypatch.setattr("siteratio.runtime.BROADCAST_ROWS", 0)
    df = frame([(i, "same" if i % 3 == 0 else f"n{i}") for i in range(60)], "row_id long, name string")
    got = dict(rows(dup_label(df, "name", "row_id"), "row_id", "name"))
    assert len(got) == 60 and got[0] == "same" and sum(v == "same_duplicate" for v in got.values()) == 19
    names = [("a_1_b", 1.0), ("a_1_b_20210101", 2.0), ("c_1_b", 3.0)]
    assert rows(supersede(frame(names, "sample string, value double")), "sample", "value") == [("a_1_b", 2.0), ("c_1_b", 3.0)]


def test_split_name_is_greedy_and_keeps_unmatched_names(frame):
    df = frame([("a_b_c_d",), ("noparts",), (None,)], "sample string")
    got = rows(split_name(df, "sample", ["x", "y", "z"]), "x", "y", "z")
    assert set(got) == {("a_b", "c", "d"), ("noparts",) * 3, (None,) * 3}
    assert fx.name_parts_text("a_b_c_d", 3) == ["a_b", "c", "d"]
    assert fx.name_parts_text("noparts", 3) == ["noparts"] * 3


def test_numeric_text(frame):
    texts = ["12", " 3 ", "1e5", "NA", "x", "1.5d", "2f", ".5", "-7.", "", None]
    df = frame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(fx.to_double(F.col("t"))).collect()]
    assert got == [12.0, 3.0, 1e5, None, None, None, None, 0.5, -7.0, None, None]


def test_division_and_log_policies(frame):
    inf, nan = math.inf, math.nan
    df = frame([(1.0, 2.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (nan, 1.0), (None, 1.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    assert [r[0] for r in df.select(fx.divide_safe(a, b)).collect()] == [0.5, None, None, None, None, None]
    ieee = [r[0] for r in df.select(fx.divide_safe(a, b, "ieee")).collect()]
    assert ieee[:3] == [0.5, inf, -inf] and math.isnan(ieee[3]) and math.isnan(ieee[4]) and ieee[5] is None
    v = frame([(8.0,), (0.0,), (-1.0,), (nan,), (None,)], "v double")
    assert [r[0] for r in v.select(fx.log2_safe(F.col("v"))).collect()] == [3.0, None, None, None, None]
    ieee = [r[0] for r in v.select(fx.log2_safe(F.col("v"), "ieee")).collect()]
    assert ieee[:2] == [3.0, -inf] and math.isnan(ieee[2]) and math.isnan(ieee[3]) and ieee[4] is None
    with pytest.raises(ValueError):
        fx.divide_safe(a, b, "other")


def test_labels(frame):
    df = frame([(0.0, 1.0), (30.0, -1.0), (None, 0.0), (2.5, None)], "t double, m double")
    got = df.select(
        fx.flag_fed(F.col("t")), fx.flag_direction(F.col("m")), fx.number_label(F.col("t")),
        fx.paste(F.lit("s"), F.col("t").cast("int")),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("Fast", "release", "0", "s_0"),
        ("Fed", "uptake", "30", "s_30"),
        (None, "none", None, "s_NA"),
        ("Fed", None, "2.5", "s_2"),
    ]
    stars = frame([(1e-4,), (1e-3,), (0.01,), (0.05,), (0.051,), (1.0,), (None,)], "p double")
    assert [r[0] for r in stars.select(fx.signif_stars("p")).collect()] == [
        "****", "***", "**", "*", "ns", "ns", None,
    ]


def test_wide_to_long_keeps_empty_cells_and_parses_text(frame):
    df = frame([("m1", "1.5", 2), ("m2", "NA", None)], "name string, `a_1.2` string, b int")
    assert rows(to_long(df, ["name"]), "name", "sample", "value") == rows(
        frame(
            [("m1", "a_1.2", 1.5), ("m1", "b", 2.0), ("m2", "a_1.2", None), ("m2", "b", None)],
            "name string, sample string, value double",
        ),
        "name", "sample", "value",
    )
    inferred = to_long(frame([("m1", "x", 2)], "name string, note string, b int"))
    assert inferred.columns == ["name", "note", "sample", "value"]
    keyed = to_keyed(frame([("m", 1.0)], "name string, FP1_000m_FA double"), ["name"], ["p", "t", "s"])
    assert rows(keyed, "sample", "p", "t", "s", "value") == [("FP1_000m_FA", "FP1", "000m", "FA", 1.0)]


def test_column_name_edits(frame):
    df = frame([(1, 2, 3)], "Name int, HF1_U_1 int, hf1_qc int")
    assert drop_cols_like(df, "_U_").columns == ["Name", "hf1_qc"]
    assert drop_cols_like(df, "QC", ignore_case=True).columns == ["Name", "HF1_U_1"]
    assert lower_names(df).columns == ["name", "hf1_u_1", "hf1_qc"]


def test_pivot_guard(frame):
    df = frame([("m", "a", 1.0), ("m", "b", 2.0), ("n", "a", 3.0)], "r string, c string, v double")
    assert [tuple(x) for x in to_wide(df, "r", "c", "v").orderBy("r").collect()] == [
        ("m", 1.0, 2.0), ("n", 3.0, None),
    ]
    twice = df.union(df.filter("r = 'n'"))
    with pytest.raises(PySparkException):
        to_wide(twice, "r", "c", "v").collect()
    counted = to_wide(twice, "r", "c", "v", on_duplicate="count").orderBy("r").collect()
    assert [tuple(x) for x in counted] == [("m", 1.0, 1.0), ("n", 2.0, 0.0)]
    with pytest.raises(PySparkException):
        assert_unique(twice, ["r", "c"], "v").collect()


def test_densify_equals_pivot_then_unpivot(frame):
    cells = [("m", s, t, 1.0) for s in ("x", "y") for t in (0.0, 30.0, 60.0)]
    df = frame(cells + [("n", "x", 0.0, 5.0), ("n", "y", None, 6.0)], "a string, s string, t double, v double")
    dense = densify(df, ["a"], ["s", "t"], "v")
    assert dense.count() == 14
    assert dense.filter("v IS NULL").count() == 6
    assert rows(dense.filter("v IS NOT NULL"), "a", "s", "t", "v") == rows(df, "a", "s", "t", "v")


def test_grid_is_made_of_blocks(spark, monkeypatch):
    """More columns than a block holds, of two typed keys with a missing one: every pair once."""
    monkeypatch.setattr(reshape, "GRID_BLOCK", 7)
    rows_ = spark.range(5).selectExpr("nullif(id, 3) AS r")
    cols = spark.range(40).selectExpr("nullif(concat('c', id), 'c9') AS c", "id * 0.5D AS t")
    got = [tuple(x) for x in reshape.grid(rows_, cols).collect()]
    assert len(got) == len(set(got)) == 5 * 40
    assert {x[0] for x in got} == {0, 1, 2, None, 4} and (None, None, 4.5) in got
    assert reshape.grid(rows_, cols.limit(0)).count() == 0 and reshape.grid(rows_.limit(0), cols).count() == 0


def test_count_rule_is_decided_inside_the_plan(spark, frame):
    """No job runs while the plan is made; without a repeat the values stay."""
    df = frame([("m", "a", 1.5), ("n", "b", None)], "r string, c string, v double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    plain = assert_unique(df, ["r", "c"], "v", on_duplicate="count")
    wide = to_wide(df, "r", "c", "v", cols=["a", "b"], on_duplicate="count")
    assert not tracker.getJobIdsForGroup("planning")
    spark.sparkContext.setJobGroup("other", "other")
    assert rows(plain, "r", "c", "v") == rows(df, "r", "c", "v")
    assert sorted(map(tuple, wide.collect())) == [("m", 1.5, None), ("n", None, None)]
    twice = assert_unique(df.union(df), ["r", "c"], "v", on_duplicate="count")
    assert {r.v for r in twice.collect()} == {2.0}


def test_labels_without_a_column_are_errors(frame):
    df = frame([("m", "a", 1.0), ("m", None, 2.0)], "r string, c string, v double")
    with pytest.raises(ValueError, match="missing labels"):
        to_wide(df, "r", "c", "v")
    with pytest.raises(PySparkException, match="no column for label"):
        to_wide(df.fillna("b", ["c"]), "r", "c", "v", cols=["a"]).collect()


def test_densify_keeps_typed_keys_apart(spark, frame):
    day = "timestamp'2024-01-01 00:00:00"
    df = spark.sql(f"SELECT * FROM VALUES ('m', {day}.123456', 1D), ('n', {day}.123999', 2D) AS t(a, t, v)")
    dense = densify(df, ["a"], ["t"], "v")
    assert dense.schema["t"].dataType == df.schema["t"].dataType
    assert dense.count() == 4 and dense.select("t").distinct().count() == 2
    assert sorted(r.v for r in dense.collect() if r.v is not None) == [1.0, 2.0]
    twice = frame([("m", 1, 1.0), ("m", 1, 2.0)], "a string, t int, v double")
    with pytest.raises(PySparkException):
        densify(twice, ["a"], ["t"], "v").collect()


def test_expected_rows_beyond_the_bound_of_a_table(spark):
    # 12,000 samples in one group, far more than a table has columns
    df = spark.range(12_000).selectExpr("'m' AS a", "id AS s", "'x' AS g", "1D AS v")
    df = df.unionByName(df.where("s < 3").selectExpr("'n' AS a", "s", "g", "IF(s = 0, NULL, v) AS v"))
    got = {r.a: (r.g, r.rows, r.present) for r in expected_rows(df, ["a"], ["g"], ["s"], "v").collect()}
    assert got == {"m": ("x", 12_000, 12_000), "n": ("x", 12_000, 2)}
