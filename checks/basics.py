"""Scans, projections, filters, reshaping and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.common import (
    SQL_EVENTS,
    SQL_LINES,
    SQL_LINE_LOG2,
    SQL_REPLICATE,
    SQL_SINGLE,
    check,
    sql_select,
)
from siteratio.functions import scalars as fx
from siteratio.operators.names import dup_label, split_name, supersede
from siteratio.operators.ratio import paired_ratio
from siteratio.operators.reshape import (
    assert_unique,
    densify,
    expected_rows,
    drop_cols_like,
    lower_names,
    to_long,
    to_wide,
)
from siteratio.operators.summarise import (
    collapse_alternatives,
    filter_group_size,
    filter_regex,
    sort_by_keys,
    with_columns_from,
)
from siteratio.plans.cohorts import REPLICATE_MINUTES, SITE_LABELS, TIME_LABELS
from siteratio.runtime import scratch_path
from siteratio.sources import fixtures as fix
from siteratio.sources.tables import read_log2, read_wide, write_stat, write_tables

KEYED = "analyte subject timepoint site sample value:d"
LINE_KEYS = ["subject", "time", "analyte"]


def line_log2(spark: SparkSession, sf: str) -> DataFrame:
    """(analyte, subject, time, site, value = log2 ratio to AF) from lineitem."""
    keyed = fix.lineitem_keyed(spark, sf)
    ratio = paired_ratio(keyed, LINE_KEYS, ref="AF").filter(F.col("site") != "AF")
    return ratio.select("analyte", "subject", "time", "site", fx.log2_safe(F.col("ratio")).alias("value"))


# ------------------------------------------------------------ sources and sinks

SQL_GRID = (
    SQL_SINGLE
    + """,
names AS (
  SELECT 'FP' || s || '_' || t || '_' || o AS sample
  FROM (SELECT unnest(['1','2','3','4','5','6']) AS s), (SELECT unnest(['000m','030m','060m','120m']) AS t),
       (SELECT unnest(['FA','P','H','RV','LV']) AS o)),
grid AS (
  SELECT a.analyte, n.sample, k.value
  FROM (SELECT DISTINCT analyte FROM keyed) a CROSS JOIN names n
  LEFT JOIN keyed k ON k.analyte = a.analyte AND k.sample = n.sample)
"""
)


@check(
    "scan_wide",
    sql_select(
        SQL_GRID + ", s AS (SELECT substr(analyte, 2)::BIGINT AS row_id, * FROM grid)",
        "s",
        "row_id:i analyte sample value:d",
    ),
)
def scan_wide(spark, sf):
    path = scratch_path(spark, "wide")
    fix.wide_single(spark, sf).write.parquet(path)
    return to_long(read_wide(spark, path), ["row_id", "analyte"])


@check("scan_log2", sql_select(SQL_GRID, "grid", "analyte sample value:d"))
def scan_log2(spark, sf):
    path = scratch_path(spark, "log2")
    wide = fix.wide_single(spark, sf).drop("row_id").withColumnRenamed("analyte", "Name")
    wide.write.parquet(path)
    return to_long(read_log2(spark, path, "Name"), ["analyte"])


@check(
    "sink_multi",
    sql_select(
        SQL_SINGLE
        + ", s AS (SELECT 'counts' AS part, analyte, sample, value FROM keyed"
        " UNION ALL SELECT 'log2', analyte, sample, CASE WHEN value > 0 THEN log2(value) END FROM keyed)",
        "s",
        "part analyte sample value:d",
    ),
)
def sink_multi(spark, sf):
    keyed = fix.keyed_single(spark, sf).select("analyte", "sample", "value")
    logs = keyed.withColumn("value", fx.log2_safe(F.col("value")))
    where = write_tables({"counts": keyed, "log2": logs}, scratch_path(spark, "tables"))
    parts = [spark.read.parquet(p).withColumn("part", F.lit(n)) for n, p in where.items()]
    return parts[0].unionByName(parts[1]).select("part", "analyte", "sample", "value")


@check(
    "sink_csv",
    sql_select(
        SQL_LINE_LOG2, "l2", "analyte subject time:d site value:d", "WHERE true"
    ),
)
def sink_csv(spark, sf):
    df = line_log2(spark, sf)
    path = write_stat(df, scratch_path(spark, "stats"), "log2")
    back = spark.read.option("header", True).option("nullValue", "NA").schema(df.schema).csv(path)
    return back


# ------------------------------------------------------------------ projections


@check("rename_cols", sql_select("", "part", "p_partkey:i compound p_brand").replace('"compound"', "p_name AS compound"))
def rename_cols(spark, sf):
    part = fix.table(spark, sf, "part").withColumnRenamed("p_name", "compound")
    return part.select("p_partkey", "compound", "p_brand")


NUMBER_SQL = r"""
t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN value::VARCHAR WHEN 1 THEN ' ' || value || ' '
        WHEN 2 THEN value || 'd' WHEN 3 THEN 'NA' ELSE value || 'e1' END AS text FROM events),
s AS (SELECT event_id, CASE WHEN regexp_full_match(text, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*')
        THEN trim(text)::DOUBLE END AS value FROM t)
"""


@check("cast_numeric", sql_select(NUMBER_SQL, "s", "event_id:i value:d"))
def cast_numeric(spark, sf):
    v = F.col("value").cast("string")
    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, v)
        .when(kind == 1, F.concat(F.lit(" "), v, F.lit(" ")))
        .when(kind == 2, F.concat(v, F.lit("d")))
        .when(kind == 3, "NA")
        .otherwise(F.concat(v, F.lit("e1")))
    )
    return fix.table(spark, sf, "events").select("event_id", fx.to_double(text).alias("value"))


@check("cast_text", "SELECT event_id, user_id::VARCHAR AS variable FROM events")
def cast_text(spark, sf):
    return fix.table(spark, sf, "events").select(
        "event_id", F.col("user_id").cast("string").alias("variable")
    )


@check(
    "drop_cols_like",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_discount, l_tax FROM lineitem",
)
def drop_cols_like_q(spark, sf):
    lines = fix.table(spark, sf, "lineitem")
    return drop_cols_like(drop_cols_like(lines, "NUMBER|PRICE", ignore_case=True), "flag|status|date")


@check("select_cols", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def select_cols(spark, sf):
    return fix.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


@check("bind_cols", sql_select(SQL_SINGLE, "keyed", KEYED))
def bind_cols(spark, sf):
    long = fix.keyed_single(spark, sf).select("analyte", "sample", "value")
    parts = {p: fx.name_part(F.col("sample"), 3, i) for i, p in enumerate(("subject", "timepoint", "site"), 1)}
    return with_columns_from(long, parts).select(*[c.split(":")[0] for c in KEYED.split()])


@check("const_col", "SELECT o_orderkey, 'Fed' AS state, 'FA1' AS combine FROM orders")
def const_col(spark, sf):
    return fix.table(spark, sf, "orders").select(
        "o_orderkey", F.lit("Fed").alias("state"), F.lit("FA1").alias("combine")
    )


@check(
    "lower_colnames",
    sql_select(SQL_GRID + ", s AS (SELECT analyte, lower(sample) AS sample, value FROM grid)", "s", "analyte sample value:d"),
)
def lower_colnames(spark, sf):
    wide = lower_names(fix.wide_single(spark, sf).drop("row_id"))
    return to_long(wide, ["analyte"])


# ---------------------------------------------------------------------- filters


@check(
    "filter_regex_drop",
    sql_select(SQL_REPLICATE, "keyed", KEYED, "WHERE NOT regexp_matches(site, '^H$|LV|RV|A|FA2|FA')"),
)
def filter_regex_drop(spark, sf):
    keyed = fix.keyed_replicate(spark, sf).drop("replicate")
    return filter_regex(keyed, "site", "^H$|LV|RV|A|FA2|FA")


@check(
    "filter_regex_keep",
    sql_select(SQL_REPLICATE, "keyed", KEYED, "WHERE regexp_matches(site, '^A$|^RV$') AND subject = '1'"),
)
def filter_regex_keep(spark, sf):
    keyed = fix.keyed_replicate(spark, sf).drop("replicate")
    return filter_regex(keyed, "site", "^A$|^RV$", keep=True).filter(F.col("subject") == F.lit("1"))


@check("filter_in", sql_select(SQL_SINGLE, "keyed", KEYED, "WHERE site IN ('LV', 'RV')"))
def filter_in(spark, sf):
    return fix.keyed_single(spark, sf).filter(F.col("site").isin("LV", "RV"))


@check("filter_eq", sql_select(SQL_LINES, "keyed", "analyte subject time:d site value:d", 'WHERE "time" <> 0'))
def filter_eq(spark, sf):
    return fix.lineitem_keyed(spark, sf).filter(F.col("time") != 0)


@check(
    "filter_group_size",
    sql_select(
        SQL_SINGLE, "keyed", KEYED, "QUALIFY count(*) OVER (PARTITION BY site, timepoint, analyte) >= 6"
    ),
)
def filter_group_size_q(spark, sf):
    return filter_group_size(fix.keyed_single(spark, sf), ["site", "timepoint", "analyte"], 6)


# -------------------------------------------------------------------- reshaping


@check("unpivot_ids", sql_select(SQL_GRID, "grid", "analyte sample value:d"))
def unpivot_ids(spark, sf):
    return to_long(fix.wide_single(spark, sf).drop("row_id"), ["analyte"])


@check(
    "unpivot_inferred",
    "SELECT p_name, p_brand, p_type, unnest(['p_partkey', 'p_size', 'p_retailprice']) AS sample,"
    " unnest([p_partkey::DOUBLE, p_size::DOUBLE, p_retailprice]) AS value FROM part",
)
def unpivot_inferred(spark, sf):
    return to_long(fix.table(spark, sf, "part"))


PIVOT_COLS = [f"{s}_{t}" for s in ("AO", "NF", "NO", "RF", "RO") for t in (0, 30, 60, 120)]
PIVOT_SQL = (
    SQL_LINES
    + ", g AS (SELECT analyte, site || '_' || \"time\"::INT AS grp, subject, value FROM keyed WHERE site <> 'AF')"
)


@check(
    "pivot_unique",
    sql_select(
        PIVOT_SQL
        + ", w AS (SELECT analyte || '_' || subject AS analyte, "
        + ", ".join(f"max(value) FILTER (grp = '{c}') AS \"{c}\"" for c in PIVOT_COLS)
        + " FROM g GROUP BY ALL)",
        "w",
        "analyte " + " ".join(f"{c}:d" for c in PIVOT_COLS),
    ),
)
def pivot_unique(spark, sf):
    keyed = fix.lineitem_keyed(spark, sf).filter(F.col("site") != "AF")
    rows = keyed.select(
        fx.paste(F.col("analyte"), F.col("subject")).alias("analyte"),
        fx.paste(F.col("site"), fx.number_label(F.col("time"))).alias("grp"),
        "value",
    )
    return to_wide(rows, "analyte", "grp", "value")


@check(
    "pivot_count_guard",
    sql_select(
        SQL_EVENTS
        + ", c AS (SELECT analyte, number || '_' || timepoint AS grp, count(*)::DOUBLE AS value"
        " FROM ev GROUP BY ALL)",
        "c",
        "analyte grp value:d",
    ),
)
def pivot_count_guard(spark, sf):
    cells = fix.events_long(spark, sf).select(
        "analyte", fx.paste(F.col("number"), F.col("timepoint")).alias("grp"), "value"
    )
    return assert_unique(cells, ["analyte", "grp"], on_duplicate="count")


@check(
    "densify",
    sql_select(
        SQL_LINES
        + """, d AS (
  SELECT a.analyte, g.site, g."time", g.subject, k.value
  FROM (SELECT DISTINCT analyte FROM keyed) a
  CROSS JOIN (SELECT DISTINCT site, "time", subject FROM keyed) g
  LEFT JOIN keyed k ON k.analyte = a.analyte AND k.site = g.site AND k."time" = g."time"
   AND k.subject = g.subject)""",
        "d",
        "analyte site time:d subject value:d",
    ),
)
def densify_q(spark, sf):
    return densify(fix.lineitem_keyed(spark, sf), ["analyte"], ["site", "time", "subject"])


DAYS_SQL = """, e AS (
  SELECT user_id // 12 AS analyte, ts::DATE AS day, event_type, event_id % 5 AS sample, avg(value) AS value
  FROM events GROUP BY ALL)"""


def daily(spark, sf):
    """Averages by day and kind of event: keys of three types."""
    return (
        fix.table(spark, sf, "events")
        .groupBy(
            F.floor(F.col("user_id") / 12).alias("analyte"),
            F.to_date("ts").alias("day"),
            "event_type",
            (F.col("event_id") % 5).alias("sample"),
        )
        .agg(F.avg("value").alias("value"))
    )


@check(
    "densify_typed_keys",
    sql_select(
        "z AS (SELECT 1)"
        + DAYS_SQL
        + """, d AS (
  SELECT a.analyte, g.day, g.event_type, g.sample, k.value
  FROM (SELECT DISTINCT analyte FROM e) a CROSS JOIN (SELECT DISTINCT day, event_type, sample FROM e) g
  LEFT JOIN e k ON k.analyte = a.analyte AND k.day = g.day AND k.event_type = g.event_type AND k.sample = g.sample)""",
        "d",
        "analyte:i day event_type sample:i value:d",
    ),
)
def densify_typed_keys(spark, sf):
    return densify(daily(spark, sf), ["analyte"], ["day", "event_type", "sample"])


@check(
    "expected_rows",
    sql_select(
        "z AS (SELECT 1)"
        + DAYS_SQL
        + """, x AS (
  SELECT k.analyte, k.day, k.event_type, any_value(g.n) AS rows, count(k.value) AS present
  FROM e k JOIN (SELECT day, event_type, count(DISTINCT sample) AS n FROM e GROUP BY ALL) g
    ON g.day = k.day AND g.event_type = k.event_type GROUP BY ALL)""",
        "x",
        "analyte:i day event_type rows:i present:i",
    ),
)
def expected_rows_q(spark, sf):
    return expected_rows(daily(spark, sf), ["analyte"], ["day", "event_type"], ["sample"])


# --------------------------------------------------------- names and their parts

RERUN_SQL = (
    SQL_EVENTS
    + """, raw AS (
  SELECT analyte, 'FP' || number || '_' || timepoint || '_' || site
         || CASE WHEN day(ts) >= 25 THEN '_20210315' ELSE '' END AS sample, avg(value) AS value
  FROM ev GROUP BY ALL),
redone AS (SELECT DISTINCT replace(sample, '_20210315', '') AS sample FROM raw WHERE sample LIKE '%2021%'),
s AS (SELECT analyte, replace(sample, '_20210315', '') AS sample, value FROM raw
      WHERE sample NOT IN (SELECT sample FROM redone))
"""
)


def reruns(spark, sf):
    """Long table in which samples of the last days are re-acquisitions."""
    date = F.when(F.day("ts") >= 25, "_20210315").otherwise("")
    name = F.concat(F.lit("FP"), fx.paste(F.col("number"), F.col("timepoint"), F.col("site_single")), date)
    return fix.events_long(spark, sf).groupBy("analyte", name.alias("sample")).agg(F.avg("value").alias("value"))


@check("supersede_anti", sql_select(RERUN_SQL, "s", "analyte sample value:d"))
def supersede_anti(spark, sf):
    return supersede(reruns(spark, sf))


@check(
    "strip_rerun",
    sql_select(
        RERUN_SQL + ", r AS (SELECT analyte, sample, replace(sample, '_20210315', '') AS base, value FROM raw)",
        "r",
        "analyte sample base value:d",
    ),
)
def strip_rerun(spark, sf):
    return reruns(spark, sf).select("analyte", "sample", fx.strip_rerun(F.col("sample")).alias("base"), "value")


@check(
    "str_collapse",
    sql_select(
        RERUN_SQL + ", c AS (SELECT analyte, string_agg(DISTINCT '^' || sample || '$', '|' ORDER BY '^' || sample || '$')"
        " AS pattern FROM raw GROUP BY analyte)",
        "c",
        "analyte pattern",
    ),
)
def str_collapse(spark, sf):
    return collapse_alternatives(reruns(spark, sf), ["analyte"], "sample")


@check(
    "dup_label",
    "SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) > 1"
    " THEN p_name || '_duplicate' ELSE p_name END AS p_name FROM part",
)
def dup_label_q(spark, sf):
    return dup_label(fix.table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")


def _split_sql(sep_parts: int) -> str:
    pat = "_".join(["(.*)"] * sep_parts)
    names = ["subject", "timepoint", "site", "replicate"][:sep_parts]
    cols = ", ".join(f"regexp_replace(sample, '{pat}', '\\{i}') AS {n}" for i, n in enumerate(names, 1))
    return f"p AS (SELECT analyte, sample, {cols} FROM odd)"


ODD_SINGLE = SQL_SINGLE + (
    ", odd AS (SELECT analyte, CASE site WHEN 'P' THEN 'x_' || sample WHEN 'H' THEN subject ELSE sample END"
    " AS sample FROM keyed), "
)
ODD_REPLICATE = SQL_REPLICATE + (
    ", odd AS (SELECT analyte, CASE site WHEN 'P' THEN 'x_' || sample WHEN 'H' THEN subject ELSE sample END"
    " AS sample FROM keyed), "
)


def odd_names(keyed):
    """Names with a surplus part (site P) or without parts (site H)."""
    site, sample = F.col("site"), F.col("sample")
    name = F.when(site == "P", F.concat(F.lit("x_"), sample)).when(site == "H", F.col("subject")).otherwise(sample)
    return keyed.select("analyte", name.alias("sample"))


@check("split_name3", sql_select(ODD_SINGLE + _split_sql(3), "p", "analyte sample subject timepoint site"))
def split_name3(spark, sf):
    return split_name(odd_names(fix.keyed_single(spark, sf)), "sample", ["subject", "timepoint", "site"])


@check("split_name4", sql_select(ODD_REPLICATE + _split_sql(4), "p", "analyte sample subject timepoint site replicate"))
def split_name4(spark, sf):
    parts = ["subject", "timepoint", "site", "replicate"]
    return split_name(odd_names(fix.keyed_replicate(spark, sf)), "sample", parts)


# ------------------------------------------------------------- scalar functions

_LABEL_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SITE_LABELS.items())


@check(
    "recode_map",
    sql_select(
        SQL_SINGLE + f", r AS (SELECT * REPLACE (CASE site {_LABEL_CASE} ELSE site END AS site) FROM keyed)",
        "r",
        KEYED,
    ),
)
def recode_map(spark, sf):
    keyed = fix.keyed_single(spark, sf)
    return keyed.withColumn("site", fx.recode_value(F.col("site"), SITE_LABELS))


@check("str_lower", "SELECT p_partkey, lower(p_type) AS p_type, lower(p_brand) AS p_brand FROM part")
def str_lower(spark, sf):
    return fix.table(spark, sf, "part").select(
        "p_partkey", F.lower("p_type").alias("p_type"), F.lower("p_brand").alias("p_brand")
    )


@check(
    "str_paste",
    "SELECT event_id, event_type || '_' || coalesce(nullif(user_id % 4, 0)::VARCHAR, 'NA') || '_' || day(ts) AS grp"
    " FROM events",
)
def str_paste(spark, sf):
    gap = F.when(F.col("user_id") % 4 != 0, F.col("user_id") % 4)
    return fix.table(spark, sf, "events").select(
        "event_id", fx.paste(F.col("event_type"), gap, F.day("ts")).alias("grp")
    )


@check(
    "str_replace_seq",
    sql_select(
        SQL_SINGLE
        + ", r AS (SELECT analyte, replace(replace(replace(replace(replace(sample, '000m', '0min'), '030m', '30min'),"
        " '060m', '60min'), '120m', '120min'), 'FP', 'Ct') AS sample, value FROM keyed)",
        "r",
        "analyte sample value:d",
    ),
)
def str_replace_seq(spark, sf):
    name = fx.replace_seq(F.col("sample"), [*TIME_LABELS.items(), ("FP", "Ct")])
    return fix.keyed_single(spark, sf).select("analyte", name.alias("sample"), "value")


@check(
    "regex_match",
    "SELECT o_orderkey, regexp_matches(o_orderpriority, '^[12]|LOW') AS hit FROM orders",
)
def regex_match(spark, sf):
    return fix.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderpriority").rlike("^[12]|LOW").alias("hit")
    )


@check(
    "map_timepoint",
    sql_select(
        SQL_EVENTS
        + ", t AS (SELECT event_id, CASE WHEN site = 'H' THEN event_id::VARCHAR WHEN site = 'RV' THEN 'none'"
        " ELSE timepoint END AS label FROM ev), r AS (SELECT event_id, label, CASE label WHEN '000m' THEN 0"
        " WHEN '030m' THEN 30 WHEN '060m' THEN 60 WHEN '120m' THEN 120 ELSE try_cast(label AS DOUBLE) END AS \"time\" FROM t)",
        "r",
        "event_id:i label time:d",
    ),
)
def map_timepoint(spark, sf):
    site = F.col("site_single")
    text = F.when(site == "H", F.col("event_id").cast("string")).when(site == "RV", "none")
    label = text.otherwise(F.col("timepoint"))
    return fix.events_long(spark, sf).select(
        "event_id", label.alias("label"), fx.map_timepoint(label, REPLICATE_MINUTES).alias("time")
    )


@check(
    "cond_replace",
    sql_select(
        SQL_SINGLE + ", r AS (SELECT * REPLACE (CASE site WHEN 'LV' THEN 'Lung' WHEN 'H' THEN 'Liver' ELSE site END AS site) FROM keyed)",
        "r",
        KEYED,
    ),
)
def cond_replace(spark, sf):
    keyed = fix.keyed_single(spark, sf)
    return keyed.withColumn("site", fx.cond_replace(F.col("site"), {"LV": "Lung", "H": "Liver"}))


@check(
    "flag_fed",
    sql_select(
        SQL_LINES + ", r AS (SELECT *, CASE WHEN \"time\" = 0 THEN 'Fast' ELSE 'Fed' END AS state FROM keyed)",
        "r",
        "analyte subject time:d site value:d state",
    ),
)
def flag_fed(spark, sf):
    return fix.lineitem_keyed(spark, sf).withColumn("state", fx.flag_fed(F.col("time")))


@check(
    "flag_direction",
    sql_select(
        SQL_LINE_LOG2
        + ', m AS (SELECT analyte, site, "time", CASE WHEN count(value) = count(*) THEN median(value) END AS median'
        " FROM l2 GROUP BY ALL), r AS (SELECT *, CASE WHEN median > 0 THEN 'release' WHEN median < 0 THEN 'uptake'"
        " WHEN median = 0 THEN 'none' END AS direction FROM m)",
        "r",
        "analyte site time:d median:d direction",
    ),
)
def flag_direction(spark, sf):
    from siteratio.operators.selection import group_median

    medians = group_median(line_log2(spark, sf), ["analyte", "site", "time"], "value")
    return medians.withColumn("direction", fx.flag_direction(F.col("median")))


@check(
    "math_log2",
    "SELECT event_id, CASE WHEN value > 0 THEN round(log2(value), 6) + 0.0 END AS log2_value FROM events",
)
def math_log2(spark, sf):
    return fix.table(spark, sf, "events").select(
        "event_id", fx.log2_safe(F.col("value")).alias("log2_value")
    )


@check(
    "math_divide",
    "SELECT event_id, CASE WHEN user_id % 7 <> 0 THEN round(value / (user_id % 7), 6) END AS ratio FROM events",
)
def math_divide(spark, sf):
    return fix.table(spark, sf, "events").select(
        "event_id", fx.divide_safe(F.col("value"), F.col("user_id") % 7).alias("ratio")
    )


@check(
    "math_abs_diff",
    sql_select("d AS (SELECT l_orderkey, l_linenumber, abs(l_quantity - l_tax * 100) AS diff FROM lineitem)",
               "d", "l_orderkey:i l_linenumber diff:d"),
)
def math_abs_diff(spark, sf):
    return fix.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", fx.abs_diff(F.col("l_quantity"), F.col("l_tax") * 100).alias("diff")
    )


@check("sort_by_keys", sql_select(SQL_SINGLE, "keyed", KEYED, "ORDER BY analyte, sample"))
def sort_by_keys_q(spark, sf):
    return sort_by_keys(fix.keyed_single(spark, sf), ["analyte", "sample"])


@check(
    "union_all",
    sql_select(
        SQL_SINGLE
        + ", u AS (SELECT * REPLACE ('Lung' AS site) FROM keyed WHERE site = 'LV'"
        " UNION ALL SELECT * REPLACE ('Liver' AS site) FROM keyed WHERE site = 'H'"
        " UNION ALL SELECT * FROM keyed WHERE site NOT IN ('LV', 'RV', 'H', 'FA'))",
        "u",
        KEYED,
    ),
)
def union_all(spark, sf):
    keyed = fix.keyed_single(spark, sf)
    lung = keyed.filter(F.col("site") == "LV").withColumn("site", F.lit("Lung"))
    liver = keyed.filter(F.col("site") == "H").withColumn("site", F.lit("Liver"))
    return keyed.filter(~F.col("site").isin("LV", "RV", "H", "FA")).unionByName(lung).unionByName(liver)
