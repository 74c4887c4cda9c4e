import math
import statistics
import time

import pytest
from pyspark.sql import functions as F

from siteratio.operators.joins import natural_join
from siteratio.operators.reshape import to_analysis
from siteratio.plans.cohorts import REPEATED_OUTPUTS, REPLICATED, SINGLE
from siteratio.plans.ratios import job_ratio_replicate, job_ratio_single
from siteratio.plans.statistics import job_statistics
from siteratio.sources.staged import current
from siteratio.sources.tables import read_log2, read_wide, write_stat, write_tables


def single_columns():
    names = [f"FP{s}_{t}_{o}" for s in (1, 2, 3) for t in ("000m", "030m") for o in ("FA", "P", "H", "RV", "LV")]
    names += ["FP1_000m_P_20210101", "FPqc_000m_FA", "FPqc_000m_P", "FPqc_000m_RV", "FPqc_000m_LV"]
    names += ["FP1_060m_FA", "FP1_060m_P"]
    return names


@pytest.fixture(scope="module")
def single(spark):
    names = single_columns()
    schema = "row_id long, analyte string, " + ", ".join(f"`{n}` double" for n in names)
    rows = [(i, a, *[float(7 * i + j + 1) for j in range(len(names))]) for i, a in enumerate(["Val", "val", "Leu"])]
    return spark.createDataFrame(rows, schema), {r[1]: dict(zip(names, r[2:])) for r in rows}


def test_single_cohort_ratios(single):
    wide, value = single
    tables = job_ratio_single(wide)
    got = {r.analyte: r.asDict() for r in tables["log2va"].collect()}
    assert set(got) == {"Val", "val_duplicate", "Leu"}
    v, row = value["Leu"], got["Leu"]
    # The re-run replaces the original column of the same sample.
    assert row["Intestine_0min_Ct1"] == pytest.approx(math.log2(v["FP1_000m_P_20210101"] / v["FP1_000m_FA"]))
    assert row["Intestine_30min_Ct2"] == pytest.approx(math.log2(v["FP2_030m_P"] / v["FP2_030m_FA"]))
    assert row["Lung_0min_Ct3"] == pytest.approx(math.log2(v["FP3_000m_LV"] / v["FP3_000m_RV"]))
    inflow = 0.8 * v["FP2_030m_P"] + 0.2 * v["FP2_030m_FA"]
    assert row["Liver_30min_Ct2"] == pytest.approx(math.log2(v["FP2_030m_H"] / inflow))
    # QC subjects count for lung and liver only; two samples of a site and time are too few.
    assert "Lung_0min_Ctqc" in row and "Intestine_0min_Ctqc" not in row
    assert not [c for c in row if "60min" in c or c.startswith("Femoral")]
    assert [r.analyte for r in tables["ion_counts"].orderBy("row_id").collect()] == ["Val", "val_duplicate", "Leu"]


def test_single_cohort_plan_has_no_shuffle_of_measurements(single):
    plan = job_ratio_single(single[0])["log2va"]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan
    assert "hashpartitioning" not in plan.split("BroadcastExchange")[0]


def test_wide_plans_stay_small_with_many_samples(spark):
    """A sample adds its columns and constants to the plan, not an expression of its own; 5,400 of them compile in seconds."""
    names = [f"HF{s}_{t}_{o}_{k}" for s in range(1, 91) for t in ("000m", "030m", "060m", "120m") for o in ("FA", "P", "H", "RV", "LV") for k in (1, 2, 3)]
    assert len(names) == 5400
    rows = spark.range(3).selectExpr("concat('m', id) AS Name", *[f"cast(id + {j % 17 + 1} AS double) AS `{n}`" for j, n in enumerate(names)])
    spark.conf.set("spark.sql.debug.maxToStringFields", "25")
    started = time.perf_counter()
    log2 = job_ratio_replicate(rows, "Name")["log2va"]
    plan = log2._jdf.queryExecution().executedPlan().toString()
    spent = time.perf_counter() - started
    assert spent < 60 and plan.count("try_divide") <= 2
    value = dict(zip(names, (1 + j % 17 for j in range(5400))))
    got = log2.filter("analyte = 'm0'").select("p_060m_7", "liver_120m_90").first()
    pairs = lambda s, t, site, ref: [value[f"HF{s}_{t}_{site}_{i}"] / ref(k) for i in (1, 2, 3) for k in (1, 2, 3)]
    fa = lambda s, t: lambda k: value[f"HF{s}_{t}_FA_{k}"]
    inflow = lambda s, t: lambda k: 0.8 * value[f"HF{s}_{t}_P_{k}"] + 0.2 * value[f"HF{s}_{t}_FA_{k}"]
    assert got[0] == pytest.approx(math.log2(statistics.median(pairs(7, "060m", "P", fa(7, "060m")))))
    assert got[1] == pytest.approx(math.log2(statistics.median(pairs(90, "120m", "H", inflow(90, "120m")))))


def test_repeated_analytes_are_refused(spark, single):
    wide, _ = single
    third = wide.union(wide.filter("analyte = 'Val'").selectExpr("99L AS row_id", "'val' AS analyte", *[f"`{c}`" for c in wide.columns[2:]]))
    with pytest.raises(ValueError, match="repeats"):
        job_ratio_single(third)


def test_replicate_cohort_ratios(spark):
    names = [
        f"HF{s}_000m_{o}_{k}" for s in (1, 2) for o in ("FA", "P", "H", "RV", "A", "LV", "CA") for k in (1, 2, 3)
    ]
    extra = ["HF2_000m_P_1.2", "HF2_000m_U_1"]
    schema = "Name string, " + ", ".join(f"`{n}` double" for n in names + extra)
    row = ("Val", *[float((i * 37) % 50 + 1) for i in range(len(names) + 2)])
    missing = ("Leu", *[None if n == "HF2_000m_FA_2" else 2.0 for n in names + extra])
    tables = job_ratio_replicate(spark.createDataFrame([row, missing], schema), "Name")
    assert "HF2_000m_U_1" not in tables["ion_counts"].columns
    got = {r.analyte: r.asDict() for r in tables["log2va"].collect()}
    v = dict(zip(names, row[1:]))

    def log2_median(site, refs):
        return math.log2(statistics.median(v[f"{site}_{i}"] / r for i in (1, 2, 3) for r in refs))

    fa = [v[f"HF2_000m_FA_{k}"] for k in (1, 2, 3)]
    inflow = [0.8 * v[f"HF2_000m_P_{k}"] + 0.2 * v[f"HF2_000m_FA_{k}"] for k in (1, 2, 3)]
    assert got["Val"]["p_000m_2"] == pytest.approx(log2_median("HF2_000m_P", fa))
    assert got["Val"]["liver_000m_2"] == pytest.approx(log2_median("HF2_000m_H", inflow))
    assert got["Val"]["lung_000m_2"] == pytest.approx(log2_median("HF2_000m_LV", [v[f"HF2_000m_RV_{k}"] for k in (1, 2, 3)]))
    assert got["Val"]["lung_000m_1"] == pytest.approx(log2_median("HF1_000m_A", [v[f"HF1_000m_RV_{k}"] for k in (1, 2, 3)]))
    assert set(got["Val"]) == {"analyte"} | {f"{o}_000m_{s}" for o in ("p", "liver", "lung") for s in (1, 2)}
    # One missing reference replicate empties the strict median.
    assert got["Leu"]["p_000m_2"] is None and got["Leu"]["p_000m_1"] == 0.0


@pytest.fixture(scope="module")
def log2(spark):
    names = [f"{o}_{t}_{s}" for o in ("Lung", "Liver", "Aorta") for t in ("0min", "30min", "60min", "120min") for s in ("a", "b", "c")]
    names.append("Colon_0min_a")
    cell = lambda i, j: None if (i, j) == (1, 3) else math.sin(i * 5 + j * 1.7) + 0.1 * i
    rows = [(f"m{i}", *[cell(i, j) for j in range(len(names))]) for i in range(4)]
    return spark.createDataFrame(rows, "analyte string, " + ", ".join(f"`{n}` double" for n in names))


def test_analysis_keeps_missing_cells(log2):
    analysis = to_analysis(log2, SINGLE.minutes)
    assert analysis.count() == 4 * 37 and analysis.filter("value IS NULL").count() == 1
    assert {r.time for r in analysis.select("time").distinct().collect()} == {0.0, 30.0, 60.0, 120.0}


def test_statistics_outputs(log2):
    tables = job_statistics(log2, SINGLE)
    assert set(tables) == {*SINGLE.outputs, *REPEATED_OUTPUTS}
    assert len(tables) == 17
    site = {(r.analyte, r.site): r for r in tables["o1_site_fam"].collect()}
    assert len(site) == 16 and site[("m0", "Colon")].p is None and site[("m0", "Lung")].n == 12
    # A site needs more than five rows, missing ones counted.
    assert {r.site for r in tables["o3_anova_time"].collect()} == {"Lung", "Liver", "Aorta"}
    time = {(r.analyte, r.site, r.time): r for r in tables["o2_time_fam"].collect()}
    gap = time[("m1", "Lung", 30.0)]
    assert gap.n == 2 and gap.median is None and gap.direction is None
    fold = tables["o6_2_fold"].collect()
    assert len(fold) == 4 * 3 * 3 and {r.group2 for r in fold} == {"30", "60", "120"}
    for r in fold:
        base = time[(r.analyte, r.site, 0.0)].median
        later = time[(r.analyte, r.site, float(r.group2))].median
        assert r.median_change == (None if None in (base, later) else pytest.approx(abs(later - base)))
    assert {r.effect for r in tables["o3_2_ancova"].collect()} == {"site", "time"}
    combo = tables["o4_2_anova_combo"].collect()
    assert {r.dfn for r in combo} == {8.0}  # two whole sites and one cell, Aorta left out
    for name, df in tables.items():
        for r in df.select("p", "p_adj").collect():
            assert r.p is None or 0 <= r.p <= r.p_adj <= 1, name


def test_statistics_from_a_long_table(log2):
    wide = job_statistics(log2, SINGLE, only=["o1_time"])["o1_time"]
    analysis = to_analysis(log2, SINGLE.minutes)
    long = job_statistics(None, SINGLE, only=["o1_time"], analysis=analysis)["o1_time"]
    key = lambda df: sorted(df.collect(), key=str)
    assert key(wide) == key(long)


def test_factor_time_and_digits(log2):
    only = ["o3_anova_time", "o3_2_ancova"]
    tables = job_statistics(log2, SINGLE, only=only, term="factor", p_digits=3)
    assert {r.dfn for r in tables["o3_anova_time"].collect()} == {3.0}
    ps = [r.p for r in tables["o3_2_ancova"].collect() if r.p is not None]
    assert ps and all(float(f"{p:.2e}") == p for p in ps)


def test_scaled_adjustment_gives_the_same_tables(log2):
    a, b = (job_statistics(log2, SINGLE, only=["o8_time_fam"], bh_mode=m)["o8_time_fam"] for m in ("window", "scaled"))
    both = natural_join(a.select("analyte", "site", "time", "p_adj"), b.selectExpr("analyte", "site", "time", "p_adj AS q"))
    assert both.count() == 4 * 13
    assert both.filter("NOT (p_adj <=> q)").count() == 0


def test_replicate_cohort_has_its_own_outputs(log2):
    with pytest.raises(ValueError):
        job_statistics(log2, REPLICATED, only=["o1_fed"])
    assert len([*REPLICATED.outputs, *REPEATED_OUTPUTS]) == 16


def test_sources_and_sinks(spark, tmp_path, log2):
    where = write_tables({"counts": log2, "log2va": log2}, str(tmp_path / "out"))
    again = read_log2(spark, where["log2va"])
    assert again.columns == log2.columns and again.count() == 4
    path = write_stat(log2.selectExpr("analyte", "cast(NULL AS double) AS p"), str(tmp_path), "stat")
    text = "".join(r.value for r in spark.read.text(path).collect())
    assert "NA" in text


def test_a_table_may_be_replaced_by_what_is_read_from_it(spark, tmp_path, log2):
    out = str(tmp_path / "out")
    first = write_tables({"log2va": log2}, out)
    table = read_log2(spark, f"{out}/log2va")
    second = write_tables({"log2va": table.filter("analyte = 'm0'")}, out)
    assert first != second and read_log2(spark, f"{out}/log2va").count() == 1
    assert table.count() == 4  # a reader that began before keeps its rows


def test_a_write_that_fails_leaves_the_old_table(spark, tmp_path, log2):
    out = str(tmp_path / "out")
    write_tables({"log2va": log2}, out)
    broken = log2.withColumn("x", F.expr("CASE WHEN analyte = 'm2' THEN cast(raise_error('lost') AS double) END"))
    with pytest.raises(Exception, match="lost"):
        write_tables({"log2va": broken}, out)
    assert read_log2(spark, f"{out}/log2va").columns == log2.columns
    assert read_log2(spark, f"{out}/log2va").count() == 4
    write_stat(log2.select("analyte"), out, "stat")
    write_stat(log2.select("analyte").limit(2), out, "stat")
    path = current(spark, f"{out}/stat")
    assert spark.read.option("header", True).csv(path).count() == 2
    assert current(spark, str(tmp_path / "nowhere")) == str(tmp_path / "nowhere")


def test_many_files_are_read_in_the_order_of_their_names(spark, tmp_path, log2):
    order = [r.analyte for r in log2.orderBy("analyte").collect()]
    for k, name in enumerate(order):
        log2.filter(F.col("analyte") == name).coalesce(1).write.parquet(str(tmp_path / "many" / f"part={k}"))
    numbered = read_wide(spark, str(tmp_path / "many" / "part=*"))
    assert [r.analyte for r in numbered.orderBy("row_id").select("analyte").collect()] == order


def test_a_name_may_be_written_na(spark, tmp_path):
    (tmp_path / "a.csv").write_text("analyte,s\nNA,1.5\nVal,NA\n")
    got = read_wide(spark, str(tmp_path / "a.csv"), fmt="csv").select("analyte", "s").collect()
    assert sorted(map(tuple, got), key=str) == [("NA", "1.5"), ("Val", None)]


def test_a_path_that_only_looks_alike_may_be_written(spark, tmp_path, log2):
    log2.write.parquet(str(tmp_path / "scout" / "log2va"))
    where = write_tables({"log2va": spark.read.parquet(str(tmp_path / "scout" / "log2va"))}, str(tmp_path / "out"))
    assert spark.read.parquet(where["log2va"]).count() == log2.count()
