"""The supplied tables read as measurements.

``events`` gives the cohort shapes: 12 users make an analyte (6 subjects x 2), the
event type is the site, the day the time label, the event number the replicate.
``lineitem`` gives a larger long table: 40 parts make an analyte, suppliers are
subjects, the order flags are sites and the quarter is the time.

Every row is used. Rows that fall on the same key are averaged, an aggregate that
combines map-side, so the number of analytes (and of tests) grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteratio.functions.sqltext import text
from siteratio.schema import (
    ANALYTE,
    REPLICATE,
    ROW_ID,
    SAMPLE,
    SITE,
    SUBJECT,
    TIMEPOINT,
    VALUE,
)

SUBJECTS = [str(i) for i in range(1, 7)]
TIMEPOINTS = ["000m", "030m", "060m", "120m"]
REPLICATES = ["1", "2", "3"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Event type as site; subject 1 has its lung outflow at A in the replicated cohort.
_SITE = (
    "CASE event_type WHEN 'view' THEN 'FA' WHEN 'click' THEN 'P' WHEN 'purchase' THEN 'H'"
    " WHEN 'signup' THEN 'RV' ELSE {lung} END"
)
_NUMBER = "cast(user_id % 6 + 1 AS string)"
_TIME = "element_at(array('000m', '030m', '060m', '120m'), day(ts) % 4 + 1)"


def events_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event with all keys."""
    aorta = f"CASE WHEN {_NUMBER} = '1' THEN 'A' ELSE 'LV' END"
    return table(spark, sf_dir, "events").selectExpr(
        "concat('M', cast(floor(user_id / 12) AS string)) AS analyte",
        f"{_NUMBER} AS number",
        f"{_TIME} AS timepoint",
        f"{_SITE.format(lung=text('LV'))} AS site_single",
        f"{_SITE.format(lung=aorta)} AS site_replicate",
        "cast(event_id % 3 + 1 AS string) AS replicate",
        "value",
        "ts",
        "event_id",
    )


def keyed_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(analyte, subject, timepoint, site, sample, value), one value per sample."""
    rows = events_long(spark, sf_dir).selectExpr(
        ANALYTE, "concat('FP', number) AS subject", TIMEPOINT, "site_single AS site", VALUE
    )
    keyed = rows.groupBy(ANALYTE, SUBJECT, TIMEPOINT, SITE).agg(F.expr("avg(value) AS value"))
    sample = "concat_ws('_', subject, timepoint, site) AS sample"
    return keyed.selectExpr(ANALYTE, SUBJECT, TIMEPOINT, SITE, sample, VALUE)


def keyed_replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(analyte, subject, timepoint, site, replicate, sample, value), three replicates."""
    keys = [ANALYTE, SUBJECT, TIMEPOINT, SITE, REPLICATE]
    rows = events_long(spark, sf_dir).selectExpr(
        ANALYTE, "number AS subject", TIMEPOINT, "site_replicate AS site", REPLICATE, VALUE
    )
    keyed = rows.groupBy(*keys).agg(F.expr("avg(value) AS value"))
    sample = "concat('HF', concat_ws('_', subject, timepoint, site, replicate)) AS sample"
    return keyed.selectExpr(*keys, sample, VALUE)


def samples_single() -> list[str]:
    return [
        f"FP{s}_{t}_{o}" for s in SUBJECTS for t in TIMEPOINTS for o in ("FA", "P", "H", "RV", "LV")
    ]


def samples_replicate() -> list[str]:
    return [
        f"HF{s}_{t}_{o}_{r}"
        for s in SUBJECTS
        for t in TIMEPOINTS
        for o in ("FA", "P", "H", "RV", "A" if s == "1" else "LV")
        for r in REPLICATES
    ]


def wide_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide matrix of the single-value cohort with ``row_id`` in analyte order."""
    keyed = keyed_single(spark, sf_dir)
    wide = keyed.groupBy(ANALYTE).pivot(SAMPLE, samples_single()).agg(F.first(VALUE))
    return wide.selectExpr(f"cast(substring({ANALYTE}, 2) AS bigint) AS {ROW_ID}", "*")


def wide_replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide matrix of the three-replicate cohort."""
    keyed = keyed_replicate(spark, sf_dir)
    return keyed.groupBy(ANALYTE).pivot(SAMPLE, samples_replicate()).agg(F.first(VALUE))


def lineitem_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(analyte, subject, time, site, value) from lineitem; site AF is the reference."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "floor(l_partkey / 40) AS part",
        "l_suppkey % 20 AS supplier",
        "quarter(l_shipdate) AS q",
        "l_returnflag",
        "l_linestatus",
        "l_extendedprice",
    )
    # Grouped on the narrow keys; labels are made once per group.
    grouped = rows.groupBy("part", "supplier", "q", "l_returnflag", "l_linestatus").agg(
        F.expr("avg(l_extendedprice) AS value")
    )
    return grouped.selectExpr(
        "concat('B', cast(part AS string)) AS analyte",
        "concat('S', cast(supplier AS string)) AS subject",
        "element_at(array(0D, 30D, 60D, 120D), q) AS time",
        "concat(l_returnflag, l_linestatus) AS site",
        "value",
    )
