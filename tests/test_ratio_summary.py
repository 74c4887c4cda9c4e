import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siteratio.functions.aggregates import mean_strict, median_skip, median_strict
from siteratio.operators.joins import natural_join
from siteratio.operators.ratio import group_scalar, paired_ratio
from siteratio.operators.selection import PER_HALVING, _by_size, group_median
from siteratio.operators.summarise import (
    baseline_delta,
    collapse_alternatives,
    filter_group_size,
    filter_regex,
)

KEYED = "subject string, timepoint string, analyte string, site string, value double"
REPS = "subject string, timepoint string, analyte string, site string, replicate string, value double"


def test_single_reference_and_its_policies(frame):
    df = frame(
        [("s", "0", "m", "FA", 2.0), ("s", "0", "m", "P", 6.0), ("s", "1", "m", "P", 6.0), ("s", "2", "m", "FA", 0.0), ("s", "2", "m", "P", 1.0)],
        KEYED,
    )
    got = {(r.timepoint, r.site): r.ratio for r in paired_ratio(df, ref="FA").collect()}
    assert got == {("0", "FA"): 1.0, ("0", "P"): 3.0, ("1", "P"): None, ("2", "FA"): None, ("2", "P"): None}
    with pytest.raises(PySparkException):
        paired_ratio(df, ref="FA", on_missing_ref="error").collect()
    twice = df.union(df.filter("timepoint = '0' AND site = 'FA'").withColumn("value", F.lit(4.0)))
    with pytest.raises(PySparkException):
        paired_ratio(twice, ref="FA").collect()
    mean = paired_ratio(twice, ref="FA", on_multi_ref="mean").filter("timepoint = '0' AND site = 'P'")
    assert [r.ratio for r in mean.collect()] == [2.0]


def test_scaling_leaves_ratios_unchanged(frame):
    df = frame([("s", "0", "m", x, v) for x, v in (("FA", 2.0), ("P", 3.0), ("H", 5.0))], KEYED)
    up = df.withColumn("value", F.col("value") * 8)
    key = lambda d: sorted((r.site, r.ratio) for r in paired_ratio(d, ref="FA").collect())
    assert key(df) == key(up)


def test_replicates_fan_out_to_nine_pairs_and_missing_gives_null(frame):
    cells = [("s", "0", "m", site, str(k), float(10 * j + k)) for j, site in enumerate(("FA", "P"), 1) for k in (1, 2, 3)]
    df = frame(cells, REPS)
    ratios = paired_ratio(df, ref="FA", replicates=["1", "2", "3"])
    keys = ["subject", "timepoint", "analyte", "site"]
    p = [r.ratio for r in ratios.filter("site = 'P'").collect()]
    assert len(p) == 9
    assert sorted(p) == sorted((20.0 + i) / (10.0 + j) for i in (1, 2, 3) for j in (1, 2, 3))
    assert {r.reference for r in ratios.collect()} == {"FA1", "FA2", "FA3"}
    med = ratios.groupBy(*keys).agg(median_strict(F.col("ratio")).alias("m")).filter("site = 'P'")
    assert med.collect()[0].m == statistics.median(p)
    less = paired_ratio(df.filter("NOT (site = 'FA' AND replicate = '2')"), ref="FA", replicates=["1", "2", "3"])
    assert less.filter("site = 'P' AND reference = 'FA2' AND ratio IS NULL").count() == 3
    assert less.groupBy(*keys).agg(median_strict(F.col("ratio")).alias("m")).filter("m IS NOT NULL").count() == 0


def test_weighted_reference_pairs_the_same_replicate(frame):
    cells = [("s", "0", "m", x, str(k), v * k) for x, v in (("P", 1.0), ("FA", 2.0), ("H", 6.0)) for k in (1, 2)]
    df = frame(cells, REPS)
    got = paired_ratio(df, weights={"P": 0.8, "FA": 0.2}, replicates=["1", "2"]).filter("site = 'H'")
    by = {(r.replicate, r.reference): r.ratio for r in got.collect()}
    assert by[("1", "PFA1")] == pytest.approx(6 / 1.2)
    assert by[("1", "PFA2")] == pytest.approx(6 / 2.4)
    single = paired_ratio(df.filter("replicate = '1' AND site <> 'FA'"), weights={"P": 0.8, "FA": 0.2})
    assert all(r.ratio is None for r in single.collect())


def test_medians_strict_and_skip(frame):
    df = frame([("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", None), ("c", float("nan")), ("c", 2.0), ("d", None)], "g string, v double")
    got = {r.g: (r.s, r.k, r.m) for r in df.groupBy("g").agg(
        median_strict(F.col("v")).alias("s"), median_skip(F.col("v")).alias("k"), mean_strict(F.col("v")).alias("m")).collect()}
    assert got == {"a": (2.0, 2.0, 2.0), "b": (None, 1.0, None), "c": (None, 2.0, None), "d": (None, None, None)}


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("cuts", [(64, 1 << 20), (1, 2), (1, 1 << 20)])
def test_selected_median_equals_the_builtin(spark, strict, cuts):
    # Group 0 holds a third of all rows; values tie, some are missing, zero, negative or infinite.
    df = spark.range(0, 3000, 1, 4).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 40 END AS g",
        "CASE WHEN id % 997 = 5 THEN NULL WHEN id % 991 = 7 THEN double('NaN') WHEN id % 701 = 3 THEN double('-Infinity')"
        " ELSE cast((id * 7919) % 211 - 90 AS double) / 7 END AS v",
    )
    plain = df.groupBy("g").agg((median_strict if strict else median_skip)(F.col("v")).alias("median"))
    got = group_median(df, ["g"], "v", strict=strict, per_halving=cuts[0], splits=cuts[1])
    expect = {r.g: r.median for r in plain.collect()}
    assert {r.g: r.median for r in got.collect()} == expect and len(expect) > 20


def test_selected_median_of_odd_groups(spark):
    rows = [(None, float(i)) for i in range(9)] + [("x", 1.0), ("none", None), ("none", None)]
    # neighbours a single bit apart, the whole range of doubles, one value many times
    rows += [("near", 1 + k * 2.0**-52) for k in range(11)] + [("far", x) for x in (-1.7e308, 5e-324, -5e-324, 1.7e308)]
    rows += [("same", 0.1)] * 50 + [("inf", float("inf"))] * 3 + [("inf", 2.0), ("inf", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r.g: r.median for r in group_median(df, ["g"], "v", strict=False).collect()}
    assert got == {
        None: 4.0, "x": 1.0, "none": None, "near": 1 + 5 * 2.0**-52, "far": 0.0, "same": 0.1, "inf": float("inf"),
    }
    assert group_median(df.limit(0), ["g"], "v").count() == 0


def test_no_task_of_a_median_holds_a_hot_group(spark):
    """A third of all rows in one group leave each task as a few buckets."""
    df = spark.range(0, 300_000, 1, 8).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('g', id % 500) END AS g", "cast(xxhash64(id) AS double) / 1e15 AS v"
    )
    buckets = df.selectExpr("g", f"{_by_size('v', PER_HALVING)} AS d").groupBy("g", "d").count()
    assert buckets.filter("g = 'hot'").count() < 30_000  # of 100,000 values
    values = sorted(r.v for r in df.filter("g = 'hot'").collect())
    got = {r.g: r.median for r in group_median(df, ["g"], "v").collect()}
    assert got["hot"] == statistics.median(values) and len(got) == 1 + len({k % 500 for k in range(300_000) if k % 3})


def test_patterns_are_bounded(spark):
    hot = spark.range(0, 30_000, 1, 4).selectExpr("CASE WHEN id % 3 = 0 THEN 'h' ELSE 'g' END AS g", "concat('x', id % 4) AS s")
    odd = spark.createDataFrame([(None, "a|b"), ("none", None), ("dup", "é"), ("dup", "é")], "g string, s string")
    df = hot.unionByName(odd)
    got = {r.g: r.pattern for r in collapse_alternatives(df, ["g"], "s").collect()}
    four = "|".join(f"^x{k}$" for k in range(4))
    assert got == {"h": four, "g": four, None: "^a|b$", "none": "", "dup": "^é$"}
    assert len(four) == 19
    assert collapse_alternatives(df.filter("g = 'h'"), ["g"], "s", max_bytes=19).first().pattern == four
    with pytest.raises(PySparkException, match="use an anti join"):
        collapse_alternatives(df, ["g"], "s", max_bytes=18).collect()


def test_group_size_counts_missing_values(frame):
    df = frame([("a", None), ("a", 1.0), ("b", 1.0), (None, 1.0), (None, 2.0)], "g string, v double")
    assert {r.g for r in filter_group_size(df, ["g"], 2).collect()} == {"a", None}


def test_regex_filters_keep_missing_text_when_dropping(frame):
    df = frame([("FA",), ("P",), (None,)], "s string")
    assert {r.s for r in filter_regex(df, "s", "FA").collect()} == {"P", None}
    assert {r.s for r in filter_regex(df, "s", "FA", keep=True).collect()} == {"FA"}


def test_natural_join_matches_missing_keys(frame):
    a = frame([("x", 1.0), (None, 2.0)], "k string, a double")
    b = frame([(None, 3.0), ("y", 4.0)], "k string, b double")
    assert [tuple(r) for r in natural_join(a, b).collect()] == [(None, 2.0, 3.0)]
    assert natural_join(a, b, null_safe=False).count() == 0


def test_baseline_delta(frame):
    df = frame([("m", 0.0, 1.0), ("m", 30.0, -2.0), ("n", 30.0, 5.0)], "a string, t double, v double")
    got = {(r.a, r.t): r.d for r in baseline_delta(df, ["a"], "t", {"v": "d"}).collect()}
    assert got == {("m", 30.0): 3.0, ("n", 30.0): None}


def test_group_scalar(frame):
    df = frame([("m", 1.0), ("m", 2.0)], "a string, v double")
    got = group_scalar(df, ["a"], {"top": "max(v)"}).collect()
    assert sorted((r.v, r.top) for r in got) == [(1.0, 2.0), (2.0, 2.0)]


def test_a_group_with_a_third_of_the_rows_is_split(spark):
    """Adaptive execution splits the hot group of a ratio join; results stay whole."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(0, 60000, 1, 8).selectExpr(
            "'s' AS subject", "'0' AS timepoint",
            "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('m', id % 2000) END AS analyte",
            "CASE WHEN id IN (0) OR (id % 3 > 0 AND id < 2000) THEN 'FA' ELSE 'P' END AS site",
            "cast(id + 1 AS double) AS value",
        )
        ratio = paired_ratio(df, ref="FA", on_multi_ref="mean")
        rows = ratio.filter("analyte = 'hot'").count()
        ratio.write.format("noop").mode("overwrite").save()
        got = ratio.collect()
        plan = ratio._jdf.queryExecution().executedPlan().toString()
        assert len(got) == 60000 and rows == 20000
        assert "skew=true" in plan
        # Also where the next grouping could have reused the partitioning of the join.
        sums = ratio.groupBy("subject", "timepoint", "analyte", "site").agg(F.count("value").alias("n"))
        assert sum(r.n for r in sums.collect()) == 60000
        assert "skew=true" in sums._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_missing_keys_are_groups(frame):
    df = frame([(None, "A", 2.0), (None, "B", 6.0), ("g", "A", 1.0)], "k string, site string, value double")
    got = paired_ratio(df, ["k"], ref="A").filter("k IS NULL").select("site", "ratio").collect()
    assert sorted(map(tuple, got)) == [("A", 1.0), ("B", 3.0)]
    assert sorted(r.n for r in group_scalar(df, ["k"], {"n": "count(1)"}).collect()) == [1, 2, 2]
    times = frame([(None, 0.0, 2.0), (None, 30.0, 5.0)], "k string, time double, v double")
    assert [r.d for r in baseline_delta(times, ["k"], "time", {"v": "d"}).collect()] == [3.0]
