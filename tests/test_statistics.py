import math
from decimal import Decimal as D
from decimal import localcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteratio.functions import tails
from siteratio.operators import stattests as st
from siteratio.operators.fdr import _cut, bh_adjust


def close(a, b, tol=1e-10):
    assert a == pytest.approx(b, rel=tol, abs=1e-13)


# ------------------------------------------------------------------------ tails


def test_t_tail_closed_forms():
    t = np.array([0.1, 1.0, 3.7, 40.0])
    close(tails.t_two_sided(t, np.full(4, 1.0)), 1 - 2 * np.arctan(t) / np.pi)
    close(tails.t_two_sided(t, np.full(4, 2.0)), 1 - t / np.sqrt(2 + t * t), 1e-9)
    wide = [math.erfc(x / math.sqrt(2)) for x in (0.5, 2.0, 5.0)]
    close(tails.t_two_sided(np.array([0.5, 2.0, 5.0]), np.full(3, 1e8)), wide, 1e-5)


def test_f_tail_closed_forms():
    f, d2 = np.array([0.3, 1.0, 9.0]), np.array([3.0, 50.0, 1e6])
    close(tails.f_upper(f, np.full(3, 2.0), d2), (1 + 2 * f / d2) ** (-d2 / 2), 1e-9)
    t, v = np.array([0.5, 2.5, 6.0]), np.array([3.0, 8.0, 17.5])
    close(tails.f_upper(t * t, np.ones(3), v), tails.t_two_sided(t, v))


def _log_gamma(z):
    """Stirling's series in 50 digits."""
    z, shift = D(z), D(0)
    while z < 60:
        shift, z = shift + z.ln(), z + 1
    numbers = [(1, 6), (-1, 30), (1, 42), (-1, 30), (5, 66), (-691, 2730), (7, 6), (-3617, 510), (43867, 798)]
    out = (z - D("0.5")) * z.ln() - z + (2 * D("3.14159265358979323846264338327950288419716939937510582")).ln() / 2
    for k, (n, d) in enumerate(numbers, start=1):
        out += D(n) / d / (2 * k * (2 * k - 1) * z ** (2 * k - 1))
    return out - shift


def _beta_in_digits(a, b, x, y):
    """I_x(a, b) from its continued fraction in 50 digits, which leave room for what cancels."""
    swap = x >= (a + 1) / (a + b + 2)
    if swap:
        a, b, x, y = b, a, y, x
    c, d = D(1), 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            h *= c * d
        if abs(c * d - 1) < D("1e-30"):
            break
    part = (a * x.ln() + b * y.ln() - _log_gamma(a) - _log_gamma(b) + _log_gamma(a + b) - a.ln()).exp() * h
    return 1 - part if swap else part


@pytest.mark.parametrize("dof", [3, 900, 9_999, 10_001, 1e6, 1e9, 1e12])
def test_tails_at_many_degrees_of_freedom(dof):
    """Relative 1e-10, and the logarithm, up to 1e12 degrees of freedom."""
    cases = [(1, t * t) for t in (0.01, 1.0, 1.5, 5.0, 30.0)] + [(d1, f) for d1 in (2, 7, 200) for f in (0.2, 1.0, 4.0, 30.0)]
    with localcontext() as context:
        context.prec = 50
        for d1, f in cases:
            whole = D(dof) + D(d1) * D(f)
            want = _beta_in_digits(D(dof) / 2, D(d1) / 2, D(dof) / whole, D(d1) * D(f) / whole)
            args = np.array([f]), np.array([float(d1)]), np.array([float(dof)])
            if want > D("1e-300"):
                assert abs(D(float(tails.f_upper(*args)[0])) / want - 1) < D("1e-10"), (d1, f)
            assert tails.f_upper(*args, log10=True)[0] == pytest.approx(float(want.log10()), rel=1e-10, abs=1e-12)
            if d1 == 1:
                t = np.array([f**0.5]), np.array([float(dof)])
                close(tails.t_two_sided(*t), tails.f_upper(*args), 1e-9)
                close(tails.t_two_sided(*t, log10=True), tails.f_upper(*args, log10=True), 1e-9)


def test_logarithms_keep_tails_below_the_smallest_double():
    args = np.array([5000.0]), np.array([2.0]), np.array([4000.0])
    assert tails.f_upper(*args)[0] == 0.0 or tails.f_upper(*args)[0] < 1e-300
    close(tails.f_upper(*args, log10=True), -2000 * np.log10(1 + 2.5), 1e-12)
    close(tails.t_two_sided(np.array([60.0]), np.array([1e12]), log10=True), -784.0, 1e-2)
    edge = tails.t_two_sided(np.array([0.0, np.inf, np.nan]), np.full(3, 5.0), log10=True)
    assert edge[0] == 0 and edge[1] == -np.inf and np.isnan(edge[2])


def test_tails_match_the_jvm_library(spark):
    rows = [(t, v) for t in (0.01, 0.7, 2.2, 8.0, 30.0) for v in (1.0, 2.7, 9.0, 63.5, 400.0)]
    df = spark.createDataFrame(rows, "statistic double, df double")
    jvm = F.java_method(
        F.lit("org.apache.commons.math3.special.Beta"), F.lit("regularizedBeta"),
        F.expr("df / (df + statistic * statistic)"), F.expr("df / 2"), F.lit(0.5),
    ).cast("double")
    for r in tails.add_p_t(df).withColumn("jvm", jvm).collect():
        close(r.p, r.jvm, 1e-9)


def test_tail_edges(spark):
    df = spark.createDataFrame(
        [(0.0, 3.0), (math.inf, 3.0), (-math.inf, 3.0), (None, 3.0), (1.0, None), (math.nan, 2.0)],
        "statistic double, df double",
    )
    assert [r.p for r in tails.add_p_t(df).collect()] == [1.0, 0.0, 0.0, None, None, None]
    f = spark.createDataFrame([(0.0, 2.0, 3.0), (math.inf, 2.0, 3.0), (None, 2.0, 3.0)], "f double, dfn double, dfd double")
    assert [r.p for r in tails.add_p_f(f).collect()] == [1.0, 0.0, None]


def test_t_quantile_inverts_the_tail(spark):
    dof = np.array([1.0, 1.37, 8.0, 500.0, 1e7])
    q = tails.t_two_sided_quantile(0.05, dof)
    close(tails.t_two_sided(q, dof), np.full(5, 0.05))
    close(q[[0, 2, 3]], [12.7062047362, 2.3060041352, 1.9647198375])
    got = tails.add_t_quantile(spark.createDataFrame([(8.0,), (None,)], "df double")).collect()
    close(got[0].t_quantile, 2.3060041352)
    assert got[1].t_quantile is None


# ------------------------------------------------------------------------ tests


@pytest.fixture(scope="module")
def cells(spark):
    """Unbalanced sites x times with missing values."""
    rng = np.random.default_rng(5)
    rows = []
    for a in ("m1", "m2", "m3"):
        for i, s in enumerate("wxyz"):
            for t in (0.0, 30.0, 60.0, 120.0):
                for _ in range(int(rng.integers(1, 6))):
                    v = None if rng.random() < 0.1 else float(rng.normal(i * 0.3 + t / 200, 1))
                    rows.append((a, s, t, v))
    return spark.createDataFrame(rows, "analyte string, site string, time double, value double")


def by(pdf, *keys):
    return pdf.dropna(subset=["value"]).groupby(list(keys))


def test_one_sample_against_numpy(cells):
    pdf = cells.toPandas()
    got = {(r.analyte, r.site): r for r in st.ttest_one_sample(cells, ["analyte", "site"], mu=0.2).collect()}
    for k, g in by(pdf, "analyte", "site"):
        v = g["value"].to_numpy()
        close(got[k].statistic, (v.mean() - 0.2) / (v.std(ddof=1) / math.sqrt(len(v))))
        assert (got[k].n, got[k].df) == (len(v), len(v) - 1)


def test_welch_and_pairs_against_numpy(cells):
    armed = cells.withColumn("arm", F.when(F.col("time") == 0, "Fast").otherwise("Fed"))
    got = {(r.analyte, r.site): r for r in st.ttest_welch(armed, ["analyte", "site"], "value", "arm").collect()}
    pairs = {
        (r.analyte, r.group2): r
        for r in st.ttest_pairs(cells, ["analyte"], "value", "time", [(0, 30), (0, 120)], detailed=True).collect()
    }

    def welch(a, b):
        va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
        return (a.mean() - b.mean()) / math.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1))

    pdf = cells.toPandas().dropna(subset=["value"])
    for k, g in pdf.groupby(["analyte", "site"]):
        a, b = g[g.time == 0].value.to_numpy(), g[g.time > 0].value.to_numpy()
        if len(a) > 1 and len(b) > 1:
            t, v = welch(a, b)
            close(got[k].statistic, t)
            close(got[k].df, v)
            assert (got[k].group1, got[k].group2) == ("Fast", "Fed")
        else:
            assert got[k].statistic is None and got[k].n1 == len(a)
    for k, g in pdf.groupby("analyte"):
        a, b = g[g.time == 0].value.to_numpy(), g[g.time == 120].value.to_numpy()
        r = pairs[(k, "120")]
        t, v = welch(a, b)
        close(r.statistic, t)
        half = float(tails.t_two_sided_quantile(0.05, np.array([v]))[0]) * (a.mean() - b.mean()) / t
        close(sorted([r.conf_low, r.conf_high]), sorted([a.mean() - b.mean() - half, a.mean() - b.mean() + half]))
    assert len(pairs) == 6


def _rss(columns, y):
    design = np.column_stack(columns)
    coef = np.linalg.lstsq(design, y, rcond=None)[0]
    return float(((y - design @ coef) ** 2).sum())


def _dummies(x):
    return [(x == level).astype(float) for level in sorted(set(x))]


@pytest.mark.parametrize("term", ["numeric", "factor"])
def test_ancova_against_least_squares(cells, term):
    got = {(r.analyte, r.effect): r for r in st.ancova(cells, ["analyte"], "value", "site", "time", term).collect()}
    for a, g in by(cells.toPandas(), "analyte"):
        a = a[0] if isinstance(a, tuple) else a
        y, site, t = g.value.to_numpy(), g.site.to_numpy(), g.time.to_numpy()
        time_cols = [t] if term == "numeric" else _dummies(t)
        levels = 1 if term == "numeric" else len(set(t)) - 1
        full = _rss(_dummies(site) + time_cols, y)
        dfd = len(y) - len(set(site)) - levels
        no_time = _rss(_dummies(site), y)
        no_site = _rss([np.ones_like(y)] + time_cols, y)
        for effect, rss, dfn in (("site", no_site, len(set(site)) - 1), ("time", no_time, levels)):
            r = got[(a, effect)]
            close(r.f, ((rss - full) / dfn) / (full / dfd), 1e-8)
            close(r.ges, (rss - full) / rss, 1e-8)
            assert (r.dfn, r.dfd) == (dfn, dfd)


def _rank(columns):
    return int(np.linalg.matrix_rank(np.column_stack(columns)))


def test_factor_ancova_of_layouts_that_fall_apart(spark):
    """Unbalanced, empty and disconnected cells: ranks and sums of squares of the full design."""
    rng = np.random.default_rng(11)
    layouts = {
        "whole": [(s, t) for s in "abcd" for t in range(5)],
        "holes": [(s, t) for i, s in enumerate("abcdef") for t in range(6) if (i + t) % 3],
        "apart": [(s, t) for s, ts in (("a", (0, 1)), ("b", (0, 1)), ("c", (2, 3)), ("d", (2, 3, 4)), ("e", (5,))) for t in ts],
        "one_time": [(s, 0) for s in "abc"],
        "one_site": [("a", t) for t in range(4)],
        "many": [(f"s{k}", t) for k in range(40) for t in range(12) if (k * 5 + t) % 4],
    }
    rows = []
    for name, cells_ in layouts.items():
        for s, t in cells_:
            for _ in range(int(rng.integers(1, 4))):
                rows.append((name, s, t * 30.0, float(rng.normal() + 1e4 * (name == "holes"))))
    rows += [("perfect", s, float(t), {"a": 1.0, "b": 4.0, "c": 9.0}[s] + t / 3) for s in "abc" for t in range(4) for _ in (1, 2)]
    rows += [("void", "a", 0.0, None), (None, "a", 0.0, 1.0), (None, "b", 1.0, 2.0), (None, "a", 1.0, 2.5), (None, "b", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, site string, time double, value double").repartition(3)
    result = st.ancova(df, ["g"], "value", "site", "time", "factor")
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "CartesianProduct" not in plan
    got = {(r.g, r.effect): r for r in result.collect()}
    assert {g for g, _ in got} == {*layouts, "perfect", None}
    for name in (*layouts, None):
        mine = [r for r in rows if r[0] == name]
        site, t, y = (np.array([r[i] for r in mine]) for i in (1, 2, 3))
        a, b = _dummies(site), _dummies(t)
        rank, full = _rank(a + b), _rss(a + b, y)
        for effect, rest in (("site", b), ("time", a)):
            r, dfn, dfd = got[(name, effect)], rank - _rank(rest), len(y) - rank
            if dfn < 1 or dfd < 1:
                assert (r.f, r.dfn, r.dfd) == (None, None, None)
                continue
            ss = _rss(rest, y) - full
            assert (r.dfn, r.dfd) == (dfn, dfd), name
            close(r.f, (ss / dfn) / (full / dfd), 1e-6)
            close(r.ges, ss / (ss + full), 1e-6)
    assert got[("perfect", "site")].f is None or got[("perfect", "site")].f > 1e20


@pytest.mark.parametrize("term", ["numeric", "factor"])
def test_anova_time_against_least_squares(cells, term):
    got = {r.analyte: r for r in st.anova_time(cells, ["analyte"], "value", term=term).collect()}
    for a, g in by(cells.toPandas(), "analyte"):
        a = a[0] if isinstance(a, tuple) else a
        y, t = g.value.to_numpy(), g.time.to_numpy()
        cols = [np.ones_like(y), t] if term == "numeric" else _dummies(t)
        full, none = _rss(cols, y), _rss([np.ones_like(y)], y)
        dfn = len(cols) - 1
        close(got[a].f, ((none - full) / dfn) / (full / (len(y) - dfn - 1)), 1e-8)


def test_two_arm_anova_is_the_pooled_t_squared(cells):
    two = cells.filter("site IN ('w', 'x')")
    got = {r.analyte: r.f for r in st.anova_oneway(two, ["analyte"], "value", "site").collect()}
    for a, g in by(two.toPandas(), "analyte"):
        a = a[0] if isinstance(a, tuple) else a
        u, v = g[g.site == "w"].value.to_numpy(), g[g.site == "x"].value.to_numpy()
        pooled = ((len(u) - 1) * u.var(ddof=1) + (len(v) - 1) * v.var(ddof=1)) / (len(u) + len(v) - 2)
        close(got[a], (u.mean() - v.mean()) ** 2 / (pooled * (1 / len(u) + 1 / len(v))))


def test_merged_moments_equal_direct_ones(cells):
    keys = ["analyte", "site"]
    fine = st.cell_moments(cells, [*keys, "time"])
    merged = {(r.analyte, r.site): r for r in st.merge_moments(fine, keys).collect()}
    for r in st.cell_moments(cells, keys).collect():
        m = merged[(r.analyte, r.site)]
        assert (m.rows, m.n) == (r.rows, r.n)
        close(m.mean, r.mean)
        close(m.css, r.css)
    xy = {(r.analyte, r.site): r for r in st.merge_xy(st.xy_from_cells(fine, keys, "time"), keys).collect()}
    for r in st.xy_moments(cells, keys, "time", "value").collect():
        m = xy[(r.analyte, r.site)]
        close([m.sxx, m.sxy, m.syy, m.mx], [r.sxx, r.sxy, r.syy, r.mx], 1e-9)


def test_degenerate_groups_keep_their_row(spark):
    df = spark.createDataFrame(
        [("one", "Fast", 1.0), ("flat", "Fast", 2.0), ("flat", "Fast", 2.0), ("none", "Fast", None), ("none", "Fed", None)],
        "g string, arm string, value double",
    )
    one = {r.g: r for r in st.ttest_one_sample(df, ["g"]).collect()}
    assert {k: (r.n, r.statistic, r.p) for k, r in one.items()} == {
        "one": (1, None, None), "flat": (2, None, None), "none": (0, None, None),
    }
    welch = {r.g: r for r in st.ttest_welch(df, ["g"], "value", "arm").collect()}
    assert len(welch) == 3 and all(r.p is None for r in welch.values())
    assert {r.g: r.f for r in st.anova_oneway(df, ["g"], "value", "arm").collect()} == dict.fromkeys(("one", "flat", "none"))


# ------------------------------------------------------------------- adjustment


def step_up(ps):
    known = [p for p in ps if p is not None]
    m = len(known)
    rank = lambda p: sum(q <= p for q in known)
    return [None if p is None else min(1.0, min(q * m / rank(q) for q in known if q >= p)) for p in ps]


@pytest.mark.parametrize("mode,piece_rows", [("window", 1 << 20), ("scaled", 20), ("auto", 3)])
@pytest.mark.parametrize("family", [[], ["fam"]])
def test_bh_is_the_step_up_rule(spark, mode, family, piece_rows):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        # A third of the tests share one p-value; some have none.
        p = 0.04 if i % 3 == 0 else None if i % 17 == 1 else round(float(rng.beta(0.5, 2)), 3)
        rows.append((i, "abc"[min(i % 7, 2)], p))
    rows.append((300, "alone", 0.2))
    rows.append((301, None, 0.3))
    df = spark.createDataFrame(rows, "i int, fam string, p double")
    got = {r.i: r.p_adj for r in bh_adjust(df, family=family, mode=mode, per_halving=4, piece_rows=piece_rows).collect()}
    groups = {}
    for i, fam, p in rows:
        groups.setdefault(fam if family else 0, []).append((i, p))
    expect = {}
    for members in groups.values():
        expect.update(zip([i for i, _ in members], step_up([p for _, p in members])))
    assert got.keys() == expect.keys()
    for i, q in expect.items():
        assert got[i] == pytest.approx(q, abs=1e-15) if q is not None else got[i] is None


def test_bh_pieces_stay_small_where_one_p_holds_a_third(spark):
    """Equal p are dealt out by row, others by value; their order among each other changes nothing."""
    df = spark.range(0, 9000, 1, 4).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 0.25 ELSE (id * 7919 % 9001) / 9001 END AS _p", "'f' AS fam"
    )
    tests, pieces = _cut(df, ["fam"], per_halving=1, piece_rows=100)
    sizes = [r._c for r in pieces.collect()]
    assert sum(sizes) == 9000 and max(sizes) <= 200
    assert tests.groupBy("_range", "_sub").count().count() == len(sizes)
    got = {r.id: r.p_adj for r in bh_adjust(df.withColumnRenamed("_p", "p"), per_halving=1, piece_rows=100).collect()}
    whole = {r.id: r.p_adj for r in bh_adjust(df.withColumnRenamed("_p", "p")).collect()}
    assert got == whole and len({got[i] for i in range(0, 9000, 3)}) == 1


def test_bh_shuffles_the_tests_once(spark):
    df = spark.range(2000).selectExpr("id", "(id * 7919 % 2003) / 2003 AS p", "id % 3 AS fam")
    text = bh_adjust(df, family=["fam"])._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in text.splitlines() if "Join" in line]
    assert joins and not any("_p#" in line for line in joins)  # by piece, never by p
    rows = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "_range" in line]
    assert len(rows) <= 4  # tests and pieces, then the least quotients; the tests' is used twice


def test_bh_after_rounding_to_three_digits(spark):
    df = spark.createDataFrame([(0.012344,), (0.0123449,), (0.5,), (None,)], "p double")
    got = sorted((r.p, r.p_adj) for r in bh_adjust(df, p_digits=3).filter("p IS NOT NULL").collect())
    assert got[0] == got[1] == (0.0123, pytest.approx(0.0123 * 3 / 2))


def test_one_arm_groups_keep_both_labels(frame):
    df = frame([("a", "Fed", 1.0), ("a", "Fed", 2.0), ("b", "Fast", 1.0), ("b", "Fed", 3.0)], "k string, arm string, v double")
    for levels in (None, ("Fast", "Fed")):
        got = {r.k: r for r in st.ttest_welch(df, ["k"], "v", "arm", levels=levels).collect()}
        assert (got["a"].group1, got["a"].group2, got["a"].n1, got["a"].n2) == ("Fast", "Fed", 0, 2)
        assert (got["b"].n1, got["b"].n2) == (1, 1)
    with pytest.raises(ValueError, match="two levels"):
        st.ttest_welch(df.union(df.selectExpr("k", "'third'", "v")), ["k"], "v", "arm").collect()


def test_key_names_that_would_be_ambiguous_are_refused(frame):
    df = frame([("a", 1.0)], "n string, v double")
    with pytest.raises(ValueError, match="rename the key columns"):
        st.ttest_one_sample(df, ["n"], "v")
