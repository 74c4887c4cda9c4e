"""The composite jobs of both cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.common import (
    SQL_REPLICATE,
    SQL_SINGLE,
    check,
    sql_ancova,
    sql_arms,
    sql_bh,
    sql_limits,
    sql_one_sample,
    sql_oneway,
    sql_pairs,
    sql_select,
    sql_slope,
    sql_welch,
)
from checks.measures import ADJ, CELL_SQL, DETAIL, EFFECT, SITE_SQL, TTEST1, TTEST2
from siteratio.operators.reshape import to_long
from siteratio.plans.cohorts import REPLICATED, SINGLE
from siteratio.plans.long import complete, job_ratio_replicate_long, job_ratio_single_long, with_minutes
from siteratio.plans.ratios import job_ratio_replicate, job_ratio_single
from siteratio.plans.statistics import job_statistics
from siteratio.runtime import scratch_path
from siteratio.sources import fixtures as fix


def stored(df: DataFrame, name: str) -> DataFrame:
    """Hand a matrix on as a dataset, the way the stages of a study are chained."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


_GRID = """,
cells AS (
  SELECT a.analyte, s AS number, t AS timepoint, o AS site
  FROM (SELECT DISTINCT analyte FROM keyed) a, (SELECT unnest(['1','2','3','4','5','6']) AS s),
       (SELECT unnest(['000m','030m','060m','120m']) AS t), (SELECT unnest(['P','H','LV']) AS o)),
"""
_MINUTES = "CASE timepoint WHEN '000m' THEN 0 WHEN '030m' THEN 30 WHEN '060m' THEN 60 ELSE 120 END::DOUBLE"


def _at(site: str, extra: str = "") -> str:
    return (
        f"(SELECT value FROM keyed k WHERE k.analyte = c.analyte AND k.subject = c.subject"
        f" AND k.timepoint = c.timepoint AND k.site = '{site}' {extra})"
    )


SQL_LOG2_SINGLE = (
    SQL_SINGLE
    + _GRID
    + f"""
c AS (SELECT analyte, 'FP' || number AS subject, timepoint, site FROM cells),
v AS (
  SELECT c.*, k.value, {_at('FA')} AS fa, {_at('RV')} AS rv, {_at('P')} AS p
  FROM c LEFT JOIN keyed k USING (analyte, subject, timepoint, site)),
l2r AS (
  SELECT analyte, subject, timepoint, CASE site WHEN 'P' THEN 'Intestine' WHEN 'H' THEN 'Liver' ELSE 'Lung' END AS site,
         value / nullif(CASE site WHEN 'P' THEN fa WHEN 'LV' THEN rv ELSE p * 0.8::DOUBLE + fa * 0.2::DOUBLE END, 0) AS ratio
  FROM v),
l2 AS (
  SELECT analyte, site, {_MINUTES} AS "time",
         site || '_' || CASE timepoint WHEN '000m' THEN '0min' WHEN '030m' THEN '30min' WHEN '060m' THEN '60min'
           ELSE '120min' END || '_' || replace(subject, 'FP', 'Ct') AS sample,
         CASE WHEN ratio > 0 THEN log2(ratio) END AS value
  FROM l2r)
"""
)

SQL_LOG2_REPLICATE = (
    SQL_REPLICATE
    + _GRID
    + f"""
c AS (SELECT analyte, number AS subject, timepoint, CASE WHEN site = 'LV' AND number = '1' THEN 'A' ELSE site END AS site
      FROM cells),
refs AS (
  SELECT c.*, k,
         CASE c.site WHEN 'P' THEN {_at('FA', 'AND k.replicate = x.k')}
              WHEN 'H' THEN {_at('P', 'AND k.replicate = x.k')} * 0.8::DOUBLE + {_at('FA', 'AND k.replicate = x.k')} * 0.2::DOUBLE
              ELSE {_at('RV', 'AND k.replicate = x.k')} END AS ref
  FROM c, (SELECT unnest(['1','2','3']) AS k) x),
pairs AS (
  SELECT r.analyte, r.subject, r.timepoint, r.site, m.value / nullif(r.ref, 0) AS ratio
  FROM refs r CROSS JOIN (SELECT unnest(['1','2','3']) AS j)
  LEFT JOIN keyed m ON m.analyte = r.analyte AND m.subject = r.subject AND m.timepoint = r.timepoint
   AND m.site = r.site AND m.replicate = j),
l2r AS (
  SELECT analyte, subject, timepoint, CASE site WHEN 'P' THEN 'p' WHEN 'H' THEN 'liver' ELSE 'lung' END AS site,
         CASE WHEN count(ratio) = count(*) THEN median(ratio) END AS ratio
  FROM pairs GROUP BY ALL),
l2 AS (
  SELECT analyte, site, {_MINUTES} AS "time", site || '_' || timepoint || '_' || subject AS sample,
         CASE WHEN ratio > 0 THEN log2(ratio) END AS value
  FROM l2r)
"""
)


@check("job_ratio_single", sql_select(SQL_LOG2_SINGLE, "l2", "analyte sample value:d"))
def ratio_single(spark, sf):
    tables = job_ratio_single(stored(fix.wide_single(spark, sf), "counts"))
    return to_long(tables["log2va"], ["analyte"])


@check("job_ratio_replicate", sql_select(SQL_LOG2_REPLICATE, "l2", "analyte sample value:d"))
def ratio_replicate(spark, sf):
    tables = job_ratio_replicate(stored(fix.wide_replicate(spark, sf), "counts"))
    return to_long(tables["log2va"], ["analyte"])


# ------------------------------------------------------------ the same jobs over rows


def _long_tables(rows: DataFrame, job, **options) -> dict[str, DataFrame]:
    """The tables of a long job, its ratios handed on as a dataset. Only cells that were measured have a row."""
    counts = stored(rows.select("analyte", "sample", "value"), "counts")
    tables = job(counts, **options)
    return {"counts": counts, "samples": tables["samples"], "log2va": stored(tables["log2va"], "log2va")}


def _grid(tables: dict[str, DataFrame]) -> DataFrame:
    return complete(tables["log2va"], tables["samples"], tables["counts"]).select("analyte", "sample", "value")


@check("job_ratio_single_long", sql_select(SQL_LOG2_SINGLE, "l2", "analyte sample value:d"))
def ratio_single_long(spark, sf):
    return _grid(_long_tables(fix.keyed_single(spark, sf), job_ratio_single_long))


@check("job_ratio_replicate_long", sql_select(SQL_LOG2_REPLICATE, "l2", "analyte sample value:d"))
def ratio_replicate_long(spark, sf):
    return _grid(_long_tables(fix.keyed_replicate(spark, sf), job_ratio_replicate_long))


_SQL_IEEE = SQL_LOG2_SINGLE.replace(
    "value / nullif(CASE site WHEN 'P' THEN fa WHEN 'LV' THEN rv ELSE p * 0.8::DOUBLE + fa * 0.2::DOUBLE END, 0) AS ratio",
    "value / CASE site WHEN 'P' THEN fa WHEN 'LV' THEN rv ELSE p * 0.8::DOUBLE + fa * 0.2::DOUBLE END AS ratio",
).replace(
    "CASE WHEN ratio > 0 THEN log2(ratio) END AS value",
    "CASE WHEN isnan(ratio) OR ratio < 0 THEN 'NaN'::DOUBLE WHEN ratio = 0 THEN '-Infinity'::DOUBLE ELSE log2(ratio) END AS value",
)
#: Events with small values count as zeros, so that ratios are zero, infinite or undefined.
_ZEROS = "CASE WHEN value < {cut} THEN 0 ELSE value END"


@check(
    "job_ratio_nonfinite_long",
    sql_select(
        _SQL_IEEE.replace("avg(value) AS value", f"avg({_ZEROS.format(cut=40)}) * (avg(value) > 40)::INT AS value"),
        "(SELECT analyte, sample, CASE WHEN isnan(value) THEN 'NaN' WHEN isinf(value) THEN 'Inf' || sign(value)::INT END AS kind,"
        " CASE WHEN isfinite(value) THEN value END AS value FROM l2)",
        "analyte sample kind value:d",
    ),
)
def ratio_nonfinite_long(spark, sf):
    small = f"avg({_ZEROS.format(cut=40)}) * CASE WHEN avg(value) > 40 THEN 1 ELSE 0 END AS value"
    keys = ["analyte", "subject", "timepoint", "site"]
    events = fix.events_long(spark, sf).selectExpr(
        "analyte", "concat('FP', number) AS subject", "timepoint", "site_single AS site", "value"
    )
    rows = events.groupBy(*keys).agg(F.expr(small)).selectExpr("*", "concat_ws('_', subject, timepoint, site) AS sample")
    got = _grid(_long_tables(rows, job_ratio_single_long, nonfinite="ieee"))
    infinite = "abs(value) = double('Infinity')"
    return got.selectExpr(
        "analyte",
        "sample",
        f"CASE WHEN isnan(value) THEN 'NaN' WHEN {infinite} THEN concat('Inf', cast(sign(value) AS int)) END AS kind",
        f"CASE WHEN NOT isnan(value) AND NOT {infinite} THEN value END AS value",
    )


# ------------------------------------------------------------ statistics tables

_MED_SITE = f", m AS (SELECT {SITE_SQL}, median(value) AS median FROM l2 GROUP BY ALL)"
_MED_TIME = (
    f", m0 AS (SELECT {CELL_SQL}, CASE WHEN count(value) = count(*) THEN median(value) END AS median,"
    " CASE WHEN count(value) = count(*) THEN avg(value) END AS mean FROM l2 GROUP BY ALL)"
    ", m AS (SELECT *, CASE WHEN median > 0 THEN 'release' WHEN median < 0 THEN 'uptake'"
    " WHEN median = 0 THEN 'none' END AS direction FROM m0)"
)
_BIG = (
    ", z AS (SELECT * FROM l2 QUALIFY count(*) OVER (PARTITION BY analyte, site) > 5)"
    ", za AS (SELECT *, CASE WHEN \"time\" = 0 THEN 'Fast' ELSE 'Fed' END AS arm FROM z)"
)
_FED = ', fed AS (SELECT * FROM l2 WHERE "time" <> 0)'
_COMBO = ", combo AS (SELECT *, site || '_' || \"time\"::INT AS site_time FROM l2 WHERE site <> 'Aorta')"
_FAST_FED = _BIG + "," + sql_arms("za", "b", SITE_SQL, "arm", ("Fast", "Fed")) + "," + sql_welch("b", "t", SITE_SQL)
_PAIRS = _BIG + "," + sql_pairs("z", "b", SITE_SQL) + "," + sql_welch("b", "t", SITE_SQL)


_BY_SITE = "," + sql_one_sample("l2", "t", SITE_SQL)
_BY_TIME = "," + sql_one_sample("l2", "t", CELL_SQL)
_BY_FED = _FED + "," + sql_one_sample("fed", "t", SITE_SQL)
_SLOPE = _BIG + "," + sql_slope("z", "t", SITE_SQL)
_FOLD = (
    ", x AS (SELECT u.*, abs(m.median - m_0.median) AS median_change, abs(m.mean - m_0.mean) AS mean_change,"
    ' m.median, m.direction FROM u JOIN m ON m.analyte = u.analyte AND m.site = u.site AND m."time"::INT::VARCHAR = u.group2'
    ' JOIN m m_0 ON m_0.analyte = u.analyte AND m_0.site = u.site AND m_0."time" = 0)'
)

#: output -> (CTEs after l2, source, columns, recursive)
_PLANS = {
    "o1_site": (_BY_SITE + "," + sql_bh("t", "u"), "u", f"analyte site {TTEST1} {ADJ}", False),
    "o1_site_fam": (
        _BY_SITE + "," + sql_bh("t", "u", "site") + _MED_SITE,
        "u JOIN m USING (analyte, site)",
        f"analyte site median:d {TTEST1} {ADJ}",
        False,
    ),
    "o1_fed": (_BY_FED + "," + sql_bh("t", "u"), "u", f"analyte site {TTEST1} {ADJ}", False),
    "o1_fed_fam": (_BY_FED + "," + sql_bh("t", "u", "site"), "u", f"analyte site {TTEST1} {ADJ}", False),
    "o1_time": (_BY_TIME + "," + sql_bh("t", "u"), "u", f"analyte site time:d {TTEST1} {ADJ}", False),
    "o2_time_fam": (
        _BY_TIME + "," + sql_bh("t", "u", "site") + _MED_TIME,
        'u JOIN m USING (analyte, site, "time")',
        f"analyte site time:d {TTEST1} {ADJ} median:d direction",
        False,
    ),
    "o8_time_fam": (
        _BY_TIME + "," + sql_bh("t", "u", "site"),
        "u",
        f"analyte site time:d {TTEST1} {ADJ}",
        False,
    ),
    "o3_anova_time": (_SLOPE + "," + sql_bh("t", "u"), "u", f"analyte site {EFFECT} {ADJ}", False),
    "o4_anova_time_fam": (_SLOPE + "," + sql_bh("t", "u", "site"), "u", f"analyte site {EFFECT} {ADJ}", False),
    "o3_2_anova_site": (
        "," + sql_oneway("l2", "t", "analyte", "site", "site") + "," + sql_bh("t", "u"),
        "u",
        f"analyte {EFFECT} {ADJ}",
        False,
    ),
    "o3_2_ancova": (
        "," + sql_ancova("l2", "t", "analyte") + "," + sql_bh("t", "u"),
        "u",
        f"analyte {EFFECT} {ADJ}",
        False,
    ),
    "o4_2_anova_combo": (
        _COMBO + "," + sql_oneway("combo", "t", "analyte", "site_time", "site_time") + "," + sql_bh("t", "u"),
        "u",
        f"analyte {EFFECT} {ADJ}",
        False,
    ),
    "o5_fast_fed": (_FAST_FED + "," + sql_bh("t", "u"), "u", f"analyte site {TTEST2} {ADJ}", False),
    "o6_fast_fed_fam": (_FAST_FED + "," + sql_bh("t", "u", "site"), "u", f"analyte site {TTEST2} {ADJ}", False),
    "o5_2_pairs": (_PAIRS + "," + sql_bh("t", "u"), "u", f"analyte site {TTEST2} {ADJ}", False),
    "o6_2_pairs_fam": (
        _PAIRS + "," + sql_limits("t", "c2") + "," + sql_bh("c2", "u", "site"),
        "u",
        f"analyte site {TTEST2} {DETAIL} {ADJ}",
        True,
    ),
    "o6_2_fold": (
        _PAIRS + "," + sql_limits("t", "c2") + "," + sql_bh("c2", "u", "site") + _MED_TIME + _FOLD,
        "x",
        f"analyte site {TTEST2} {DETAIL} {ADJ} median_change:d mean_change:d median:d direction",
        True,
    ),
}


def _register_long(key: str, output: str, cohort, base_sql: str, keyed, job) -> None:
    """The same table from rows: absent cells are counted from the samples, never made."""
    ctes, source, spec, recursive = _PLANS[output]
    sql = sql_select(base_sql + ctes, source, spec)
    if recursive:
        sql = "WITH RECURSIVE" + sql[len("WITH"):]

    @check(key, sql)
    def run(spark, sf):
        tables = _long_tables(keyed(spark, sf), job)
        analysis, samples = (with_minutes(tables[k], cohort.minutes) for k in ("log2va", "samples"))
        options = {"analysis": analysis, "samples": samples, "analytes": tables["counts"]}
        return job_statistics(None, cohort, only=[output], **options)[output]


def _register(key: str, output: str, cohort, base_sql: str, log2) -> None:
    ctes, source, spec, recursive = _PLANS[output]
    sql = sql_select(base_sql + ctes, source, spec)
    if recursive:
        sql = "WITH RECURSIVE" + sql[len("WITH"):]

    @check(key, sql)
    def run(spark, sf):
        return job_statistics(log2(spark, sf), cohort, only=[output])[output]


def _log2_single(spark, sf):
    return stored(job_ratio_single(stored(fix.wide_single(spark, sf), "counts"))["log2va"], "log2va")


def _log2_replicate(spark, sf):
    wide = stored(fix.wide_replicate(spark, sf), "counts")
    return stored(job_ratio_replicate(wide)["log2va"], "log2va")


for _name in SINGLE.outputs:
    _register(_name, _name, SINGLE, SQL_LOG2_SINGLE, _log2_single)
for _name in REPLICATED.outputs:
    _key = f"{_name}_rep" if _name in SINGLE.outputs else _name
    _register(_key, _name, REPLICATED, SQL_LOG2_REPLICATE, _log2_replicate)

#: Tables that depend on missing cells most: strict medians, sites by their rows, counts.
for _name in ("o1_site_fam", "o2_time_fam", "o3_2_ancova", "o6_2_fold"):
    _register_long(f"{_name}_long", _name, SINGLE, SQL_LOG2_SINGLE, fix.keyed_single, job_ratio_single_long)
    _register_long(
        f"{_name}_rep_long", _name, REPLICATED, SQL_LOG2_REPLICATE, fix.keyed_replicate, job_ratio_replicate_long
    )
