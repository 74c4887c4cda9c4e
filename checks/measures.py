"""Ratios, aggregates, tests, adjustment and distribution functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.basics import LINE_KEYS, line_log2
from checks.common import (
    SQL_LINES,
    SQL_LINE_LOG2,
    SQL_REPLICATE,
    SQL_SINGLE,
    check,
    sql_ancova,
    sql_ancova_factors,
    sql_arms,
    sql_bh,
    sql_limits,
    sql_one_sample,
    sql_oneway,
    sql_p_f,
    sql_p_t,
    sql_pairs,
    sql_select,
    sql_slope,
    sql_welch,
)
from siteratio.functions import scalars as fx
from siteratio.functions.aggregates import group_rows, mean_strict
from siteratio.functions.tails import add_p_f, add_p_t, add_t_quantile
from siteratio.operators import stattests as st
from siteratio.operators.fdr import add_stars, bh_adjust
from siteratio.operators.joins import natural_join
from siteratio.operators.ratio import group_scalar, paired_ratio
from siteratio.operators.selection import group_median
from siteratio.operators.summarise import baseline_delta
from siteratio.plans.cohorts import BASELINE_PAIRS, LIVER_INFLOW
from siteratio.runtime import freeze
from siteratio.sources import fixtures as fix

CELL = ["analyte", "site", "time"]
BY_SITE = ["analyte", "site"]
CELL_SQL = 'analyte, site, "time"'
SITE_SQL = "analyte, site"

# ----------------------------------------------------------------------- ratios


@check(
    "ratio_single_ref",
    sql_select(
        SQL_LINES
        + """, r AS (
  SELECT k.*, 'AF' AS reference, k.value / a.value AS ratio FROM keyed k
  LEFT JOIN keyed a ON a.site = 'AF' AND a.analyte = k.analyte AND a.subject = k.subject AND a."time" = k."time")""",
        "r",
        "analyte subject time:d site value:d reference ratio:d",
    ),
)
def ratio_single_ref(spark, sf):
    return paired_ratio(fix.lineitem_keyed(spark, sf), LINE_KEYS, ref="AF")


_K = "(SELECT unnest(['1','2','3']) AS k) x"


@check(
    "ratio_replicate_ref",
    sql_select(
        SQL_REPLICATE
        + f""", r AS (
  SELECT s.*, 'FA' || k AS reference, s.value / a.value AS ratio FROM keyed s CROSS JOIN {_K}
  LEFT JOIN keyed a ON a.site = 'FA' AND a.replicate = k AND a.analyte = s.analyte
   AND a.subject = s.subject AND a.timepoint = s.timepoint)""",
        "r",
        "analyte subject timepoint site replicate sample value:d reference ratio:d",
    ),
)
def ratio_replicate_ref(spark, sf):
    return paired_ratio(fix.keyed_replicate(spark, sf), ref="FA", replicates=fix.REPLICATES)


@check(
    "ratio_weighted_ref",
    sql_select(
        SQL_SINGLE
        + """, r AS (
  SELECT s.*, 'PFA' AS reference, s.value / (p.value * 0.8::DOUBLE + a.value * 0.2::DOUBLE) AS ratio
  FROM keyed s
  LEFT JOIN keyed p ON p.site = 'P' AND p.analyte = s.analyte AND p.subject = s.subject AND p.timepoint = s.timepoint
  LEFT JOIN keyed a ON a.site = 'FA' AND a.analyte = s.analyte AND a.subject = s.subject AND a.timepoint = s.timepoint
  WHERE s.site IN ('FA', 'P', 'H'))""",
        "r",
        "analyte subject timepoint site sample value:d reference ratio:d",
    ),
)
def ratio_weighted_ref(spark, sf):
    liver = fix.keyed_single(spark, sf).filter(F.col("site").isin("FA", "P", "H"))
    return paired_ratio(liver, weights=LIVER_INFLOW)


@check(
    "ratio_weighted_replicate_ref",
    sql_select(
        SQL_REPLICATE
        + f""", r AS (
  SELECT s.*, 'PFA' || k AS reference, s.value / (p.value * 0.8::DOUBLE + a.value * 0.2::DOUBLE) AS ratio
  FROM keyed s CROSS JOIN {_K}
  LEFT JOIN keyed p ON p.site = 'P' AND p.replicate = k AND p.analyte = s.analyte
   AND p.subject = s.subject AND p.timepoint = s.timepoint
  LEFT JOIN keyed a ON a.site = 'FA' AND a.replicate = k AND a.analyte = s.analyte
   AND a.subject = s.subject AND a.timepoint = s.timepoint
  WHERE s.site IN ('FA', 'P', 'H'))""",
        "r",
        "analyte subject timepoint site replicate sample value:d reference ratio:d",
    ),
)
def ratio_weighted_replicate_ref(spark, sf):
    liver = fix.keyed_replicate(spark, sf).filter(F.col("site").isin("FA", "P", "H"))
    return paired_ratio(liver, weights=LIVER_INFLOW, replicates=fix.REPLICATES)


@check(
    "group_broadcast",
    sql_select(
        SQL_SINGLE
        + """, g AS (
  SELECT *, max(CASE WHEN site = 'FA' THEN value END) OVER w AS fa, count(*) OVER w AS n FROM keyed
  WINDOW w AS (PARTITION BY analyte, subject, timepoint))""",
        "g",
        "analyte subject timepoint site sample value:d fa:d n:i",
    ),
)
def group_broadcast(spark, sf):
    scalars = {"fa": "max(CASE WHEN site = 'FA' THEN value END)", "n": "count(1)"}
    return group_scalar(fix.keyed_single(spark, sf), ["subject", "timepoint", "analyte"], scalars)


# ------------------------------------------------------------------- aggregates

_STRICT = "CASE WHEN count(value) = count(*) THEN {f}(value) END"
_MEDIANS = (
    SQL_LINE_LOG2
    + f", m AS (SELECT {CELL_SQL}, {_STRICT.format(f='median')} AS median, {_STRICT.format(f='avg')} AS mean,"
    " count(*) AS n FROM l2 GROUP BY ALL)"
)


@check("median_strict", sql_select(_MEDIANS, "m", "analyte site time:d median:d"))
def median_strict(spark, sf):
    return group_median(line_log2(spark, sf), CELL, "value")


@check(
    "median_skip",
    sql_select(SQL_LINE_LOG2 + f", m AS (SELECT {SITE_SQL}, median(value) AS median FROM l2 GROUP BY ALL)", "m", "analyte site median:d"),
)
def median_skip(spark, sf):
    return group_median(line_log2(spark, sf), BY_SITE, "value", strict=False)


@check("mean_strict", sql_select(_MEDIANS, "m", "analyte site time:d mean:d"))
def mean_strict_q(spark, sf):
    return line_log2(spark, sf).groupBy(*CELL).agg(mean_strict(F.col("value")).alias("mean"))


@check("group_count", sql_select(_MEDIANS, "m", "analyte site time:d n:i"))
def group_count(spark, sf):
    return line_log2(spark, sf).groupBy(*CELL).agg(group_rows().alias("n"))


@check("distinct_values", sql_select(SQL_LINES, "(SELECT DISTINCT site FROM keyed)", "site"))
def distinct_values(spark, sf):
    return fix.lineitem_keyed(spark, sf).select("site").distinct()


def summary(spark, sf):
    l2 = freeze(line_log2(spark, sf))
    means = l2.groupBy(*CELL).agg(mean_strict(F.col("value")).alias("mean"))
    return freeze(natural_join(group_median(l2, CELL, "value"), means))


@check("natural_merge", sql_select(_MEDIANS, "m", "analyte site time:d median:d mean:d"))
def natural_merge(spark, sf):
    return summary(spark, sf)


@check(
    "baseline_delta",
    sql_select(
        _MEDIANS
        + """, d AS (
  SELECT a.analyte, a.site, a."time", a.median, a.mean, abs(a.median - b.median) AS median_change,
         abs(a.mean - b.mean) AS mean_change
  FROM m a LEFT JOIN m b ON b."time" = 0 AND b.analyte = a.analyte AND b.site = a.site WHERE a."time" <> 0)""",
        "d",
        "analyte site time:d median:d mean:d median_change:d mean_change:d",
    ),
)
def baseline_delta_q(spark, sf):
    changes = {"median": "median_change", "mean": "mean_change"}
    return baseline_delta(summary(spark, sf), BY_SITE, "time", changes)


# ------------------------------------------------------------------------ tests

TTEST1 = "n:i estimate:d statistic:d df:d p:d"
TTEST2 = "group1 group2 n1:i n2:i statistic:d df:d p:d"
DETAIL = "estimate:d estimate1:d estimate2:d conf_low:d conf_high:d"
EFFECT = "effect dfn:d dfd:d f:d p:d ges:d"
ADJ = "p_adj:d p_adj_signif"


@check(
    "ttest_one_sample",
    sql_select(SQL_LINE_LOG2 + "," + sql_one_sample("l2", "t", SITE_SQL), "t", f"analyte site {TTEST1}"),
)
def ttest_one_sample(spark, sf):
    return st.ttest_one_sample(line_log2(spark, sf), BY_SITE)


SQL_ARMED = (
    SQL_LINE_LOG2 + ", a AS (SELECT *, CASE WHEN \"time\" = 0 THEN 'Fast' ELSE 'Fed' END AS arm FROM l2)"
)


@check(
    "ttest_welch",
    sql_select(
        SQL_ARMED + "," + sql_arms("a", "b", SITE_SQL, "arm", ("Fast", "Fed")) + "," + sql_welch("b", "t", SITE_SQL),
        "t",
        f"analyte site {TTEST2}",
    ),
)
def ttest_welch(spark, sf):
    armed = line_log2(spark, sf).withColumn("arm", fx.flag_fed(F.col("time")))
    return st.ttest_welch(armed, BY_SITE, "value", "arm")


SQL_PAIRED = SQL_LINE_LOG2 + "," + sql_pairs("l2", "b", SITE_SQL) + "," + sql_welch("b", "t", SITE_SQL)


@check("ttest_pairwise_baseline", sql_select(SQL_PAIRED, "t", f"analyte site {TTEST2}"))
def ttest_pairwise_baseline(spark, sf):
    return st.ttest_pairs(line_log2(spark, sf), BY_SITE, "value", "time", BASELINE_PAIRS)


@check(
    "ttest_detailed",
    "WITH RECURSIVE"
    + sql_select(SQL_PAIRED + "," + sql_limits("t", "u"), "u", f"analyte site {TTEST2} {DETAIL}")[4:],
)
def ttest_detailed(spark, sf):
    return st.ttest_pairs(line_log2(spark, sf), BY_SITE, "value", "time", BASELINE_PAIRS, detailed=True)


SQL_SITE = SQL_LINE_LOG2 + "," + sql_oneway("l2", "t", "analyte", "site", "site")


@check("anova_oneway_site", sql_select(SQL_SITE, "t", f"analyte {EFFECT}"))
def anova_oneway_site(spark, sf):
    return st.anova_oneway(line_log2(spark, sf), ["analyte"], "value", "site")


@check(
    "anova_oneway_combo",
    sql_select(
        SQL_LINE_LOG2
        + ", c AS (SELECT *, site || '_' || \"time\"::INT AS site_time FROM l2 WHERE site <> 'RO'),"
        + sql_oneway("c", "t", "analyte", "site_time", "site_time"),
        "t",
        f"analyte {EFFECT}",
    ),
)
def anova_oneway_combo(spark, sf):
    label = fx.paste(F.col("site"), fx.number_label(F.col("time")))
    kept = line_log2(spark, sf).filter(F.col("site") != "RO").withColumn("site_time", label)
    return st.anova_oneway(kept, ["analyte"], "value", "site_time")


@check("anova_time", sql_select(SQL_LINE_LOG2 + "," + sql_slope("l2", "t", SITE_SQL), "t", f"analyte site {EFFECT}"))
def anova_time(spark, sf):
    return st.anova_time(line_log2(spark, sf), BY_SITE, "value")


@check(
    "anova_time_factor",
    sql_select(SQL_LINE_LOG2 + "," + sql_oneway("l2", "t", SITE_SQL, '"time"', "time"), "t", f"analyte site {EFFECT}"),
)
def anova_time_factor(spark, sf):
    return st.anova_time(line_log2(spark, sf), BY_SITE, "value", term="factor")


@check("ancova_site_time", sql_select(SQL_LINE_LOG2 + "," + sql_ancova("l2", "t", "analyte"), "t", f"analyte {EFFECT}"))
def ancova_site_time(spark, sf):
    return st.ancova(line_log2(spark, sf), ["analyte"], "value", "site", "time")


@check(
    "ancova_site_time_factor",
    sql_select(SQL_LINE_LOG2 + "," + sql_ancova_factors("l2", "t", "analyte"), "t", f"analyte {EFFECT}"),
)
def ancova_site_time_factor(spark, sf):
    return st.ancova(line_log2(spark, sf), ["analyte"], "value", "site", "time", term="factor")


@check("effect_size_ges", sql_select(SQL_SITE, "t", "analyte effect ges:d"))
def effect_size_ges(spark, sf):
    return st.anova_oneway(line_log2(spark, sf), ["analyte"], "value", "site").select("analyte", "effect", "ges")


# ------------------------------------------------------------ adjustment, labels

SQL_TESTS = SQL_LINE_LOG2 + "," + sql_one_sample("l2", "t", CELL_SQL)
ADJUSTED = f"analyte site time:d {TTEST1} p_adj:d"


def cell_tests(spark, sf):
    return st.ttest_one_sample(line_log2(spark, sf), CELL)


@check("bh_global", sql_select(SQL_TESTS + "," + sql_bh("t", "u"), "u", ADJUSTED))
def bh_global(spark, sf):
    return bh_adjust(cell_tests(spark, sf))


@check("bh_by_family", sql_select(SQL_TESTS + "," + sql_bh("t", "u", "site"), "u", ADJUSTED))
def bh_by_family(spark, sf):
    return bh_adjust(cell_tests(spark, sf), family=["site"])


@check("bh_scaled", sql_select(SQL_TESTS + "," + sql_bh("t", "u", "site"), "u", ADJUSTED))
def bh_scaled(spark, sf):
    return bh_adjust(cell_tests(spark, sf), family=["site"], mode="scaled", per_halving=16)


@check(
    "bh_three_digits",
    sql_select(
        SQL_TESTS + ", r AS (SELECT * REPLACE (printf('%.2e', p)::DOUBLE AS p) FROM t)," + sql_bh("r", "u"),
        "u",
        ADJUSTED,
    ),
)
def bh_three_digits(spark, sf):
    return bh_adjust(cell_tests(spark, sf), p_digits=3)


@check("signif_stars", sql_select(SQL_TESTS + "," + sql_bh("t", "u", "site"), "u", f"{ADJUSTED} p_adj_signif"))
def signif_stars(spark, sf):
    return add_stars(bh_adjust(cell_tests(spark, sf), family=["site"]))


# ------------------------------------------------------------ tail probabilities

SQL_STATS = """
s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 10 AS statistic, l_suppkey % 60 + 1 + l_discount AS df
      FROM lineitem),
d AS (SELECT DISTINCT statistic, df FROM s)
"""


@check(
    "p_two_sided_t",
    sql_select(
        SQL_STATS + "," + sql_p_t("d", "t") + ", j AS (SELECT s.*, t.p FROM s JOIN t USING (statistic, df))",
        "j",
        "l_orderkey:i l_linenumber l_partkey:i statistic:d df:d p:d",
    ),
)
def p_two_sided_t(spark, sf):
    stats = fix.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (F.col("l_quantity") / 10).alias("statistic"),
        (F.col("l_suppkey") % 60 + 1 + F.col("l_discount")).alias("df"),
    )
    return add_p_t(stats)


SQL_FSTATS = """
s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / 30000 AS f, (l_linenumber % 9 + 1)::DOUBLE AS dfn,
             (l_suppkey % 60 + 2)::DOUBLE AS dfd FROM lineitem),
d AS (SELECT DISTINCT f, dfn, dfd FROM s)
"""


@check(
    "p_upper_f",
    sql_select(
        SQL_FSTATS + "," + sql_p_f("d", "t") + ", j AS (SELECT s.*, t.p FROM s JOIN t USING (f, dfn, dfd))",
        "j",
        "l_orderkey:i l_linenumber l_partkey:i f:d dfn:d dfd:d p:d",
    ),
)
def p_upper_f(spark, sf):
    stats = fix.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (F.col("l_extendedprice") / 30000).alias("f"),
        (F.col("l_linenumber") % 9 + 1).cast("double").alias("dfn"),
        (F.col("l_suppkey") % 60 + 2).cast("double").alias("dfd"),
    )
    return add_p_f(stats)


#: Statistics whose tails reach far below what p itself can show in a few decimals.
SQL_FAR_T = """
s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS statistic, (l_suppkey % 90 + 1 + l_discount)::DOUBLE AS df
      FROM lineitem),
d AS (SELECT DISTINCT statistic, df FROM s)
"""


@check(
    "p_two_sided_t_log10",
    sql_select(
        SQL_FAR_T + "," + sql_p_t("d", "t", log10=True) + ", j AS (SELECT s.*, t.log10_p FROM s JOIN t USING (statistic, df))",
        "j",
        "l_orderkey:i l_linenumber l_partkey:i statistic:d df:d log10_p:d",
    ),
)
def p_two_sided_t_log10(spark, sf):
    stats = fix.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_quantity").cast("double").alias("statistic"),
        (F.col("l_suppkey") % 90 + 1 + F.col("l_discount")).cast("double").alias("df"),
    )
    return add_p_t(stats, out="log10_p", log10=True)


SQL_FAR_F = """
s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / 100 AS f, (l_linenumber % 9 + 1)::DOUBLE AS dfn,
             (l_suppkey % 90 + 2)::DOUBLE AS dfd FROM lineitem),
d AS (SELECT DISTINCT f, dfn, dfd FROM s)
"""


@check(
    "p_upper_f_log10",
    sql_select(
        SQL_FAR_F + "," + sql_p_f("d", "t", log10=True) + ", j AS (SELECT s.*, t.log10_p FROM s JOIN t USING (f, dfn, dfd))",
        "j",
        "l_orderkey:i l_linenumber l_partkey:i f:d dfn:d dfd:d log10_p:d",
    ),
)
def p_upper_f_log10(spark, sf):
    stats = fix.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (F.col("l_extendedprice") / 100).alias("f"),
        (F.col("l_linenumber") % 9 + 1).cast("double").alias("dfn"),
        (F.col("l_suppkey") % 90 + 2).cast("double").alias("dfd"),
    )
    return add_p_f(stats, out="log10_p", log10=True)


@check(
    "t_quantile",
    "WITH RECURSIVE "
    + sql_select(
        "s AS (SELECT p_partkey, (p_size % 45 + 1)::DOUBLE AS df, 0.0::DOUBLE AS estimate, 1.0::DOUBLE AS _se FROM part),"
        + sql_limits("s", "u")
        + ", v AS (SELECT p_partkey, df, conf_high AS t_quantile FROM u)",
        "v",
        "p_partkey:i df:d t_quantile:d",
    )[5:],
)
def t_quantile(spark, sf):
    dof = fix.table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 45 + 1).cast("double").alias("df"))
    return add_t_quantile(dof)
