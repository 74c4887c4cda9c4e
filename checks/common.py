"""Registry of checked queries and the pieces their oracle SQL is made of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Decimals compared; p-values get one more.
DIGITS = 6
P_DIGITS = 7


def digits_of(name: str) -> int:
    return P_DIGITS if name == "p" or name.startswith("p_adj") else DIGITS


def comparable(df: DataFrame) -> DataFrame:
    """Round doubles so that both engines hash the same values."""
    return df.select(
        *[
            F.round(F.col(f.name), digits_of(f.name)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema
        ]
    )


def sql_select(ctes: str, source: str, spec: str, tail: str = "") -> str:
    """Final SELECT. ``spec`` lists columns; ``name:d`` rounds, ``name:i`` casts to BIGINT."""
    cols = []
    for item in spec.split():
        name, _, kind = item.partition(":")
        q = f'"{name}"'
        if kind == "d":
            r = f"round({q}, {digits_of(name)})"
            cols.append(f"CASE WHEN {r} = 0 THEN 0.0::DOUBLE ELSE {r}::DOUBLE END AS {q}")
        elif kind == "i":
            cols.append(f"{q}::BIGINT AS {q}")
        else:
            cols.append(q)
    head = f"WITH {ctes} " if ctes else ""
    return f"{head}SELECT {', '.join(cols)} FROM {source} {tail}".strip()


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its oracle."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: comparable(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


# ------------------------------------------------------------ fixtures in SQL

SQL_EVENTS = """
ev AS (
  SELECT 'M' || (user_id // 12) AS analyte, (user_id % 6 + 1)::VARCHAR AS number,
         ['000m','030m','060m','120m'][day(ts) % 4 + 1] AS timepoint,
         CASE event_type WHEN 'view' THEN 'FA' WHEN 'click' THEN 'P' WHEN 'purchase' THEN 'H'
              WHEN 'signup' THEN 'RV' ELSE 'LV' END AS site,
         (event_id % 3 + 1)::VARCHAR AS replicate, value, ts, event_id
  FROM events)
"""

SQL_SINGLE = (
    SQL_EVENTS
    + """,
keyed AS (
  SELECT analyte, 'FP' || number AS subject, timepoint, site,
         'FP' || number || '_' || timepoint || '_' || site AS sample, avg(value) AS value
  FROM ev GROUP BY analyte, number, timepoint, site)
"""
)

SQL_REPLICATE = (
    SQL_EVENTS
    + """,
keyed AS (
  SELECT analyte, subject, timepoint, site, replicate,
         'HF' || subject || '_' || timepoint || '_' || site || '_' || replicate AS sample,
         avg(value) AS value
  FROM (SELECT analyte, number AS subject, timepoint,
               CASE WHEN site = 'LV' AND number = '1' THEN 'A' ELSE site END AS site,
               replicate, value FROM ev)
  GROUP BY analyte, subject, timepoint, site, replicate)
"""
)

SQL_LINES = """
keyed AS (
  SELECT 'B' || (l_partkey // 40) AS analyte, 'S' || (l_suppkey % 20) AS subject,
         [0.0::DOUBLE, 30.0::DOUBLE, 60.0::DOUBLE, 120.0::DOUBLE][quarter(l_shipdate)] AS "time",
         l_returnflag || l_linestatus AS site, avg(l_extendedprice) AS value
  FROM lineitem GROUP BY ALL)
"""

SQL_LINE_LOG2 = (
    SQL_LINES
    + """,
l2 AS (
  SELECT k.analyte, k.subject, k."time", k.site,
         CASE WHEN k.value / r.value > 0 THEN log2(k.value / r.value) END AS value
  FROM keyed k LEFT JOIN keyed r
    ON r.site = 'AF' AND r.analyte = k.analyte AND r.subject = k.subject AND r."time" = k."time"
  WHERE k.site <> 'AF')
"""
)

# --------------------------------------------------- distributions and tests in SQL


def _series(x: str, y: str, a: str, b: str, log: bool = False) -> str:
    """I_x(a, b), or its natural logarithm, by its hypergeometric series: 800 terms are plenty up to x = 0.9."""
    front = f"{a} * ln({x}) + {b} * ln({y}) + lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) - ln({a})"
    term = (
        f"exp(lgamma({a} + {b} + i) - lgamma({a} + {b}) - lgamma({a} + 1 + i)"
        f" + lgamma({a} + 1) + i * ln({x}))"
    )
    total = f"list_sum(list_transform(range(0, 800), lambda i: {term}))"
    return f"{front} + ln({total})" if log else f"exp({front}) * {total}"


def sql_tail(source: str, out: str, a: str, b: str, x: str, y: str, stat: str, log10: bool = False) -> str:
    """CTEs adding p = I_x(a, b), or its decimal logarithm as log10_p, to the rows of ``source``."""
    if log10:
        near = f"log10(1 - {_series('_y', '_x', '_b', '_a')})"
        return f"""
{out}_in AS (
  SELECT *, ({a})::DOUBLE AS _a, ({b})::DOUBLE AS _b, ({x})::DOUBLE AS _x, ({y})::DOUBLE AS _y
  FROM {source}),
{out} AS (
  SELECT * EXCLUDE (_a, _b, _x, _y),
         CASE WHEN {stat} IS NULL THEN NULL WHEN _y = 0 THEN 0.0::DOUBLE
              WHEN _x <= 0.9 THEN ({_series('_x', '_y', '_a', '_b', log=True)}) / ln(10) ELSE {near} END AS log10_p
  FROM {out}_in)"""
    return f"""
{out}_in AS (
  SELECT *, ({a})::DOUBLE AS _a, ({b})::DOUBLE AS _b, ({x})::DOUBLE AS _x, ({y})::DOUBLE AS _y
  FROM {source}),
{out} AS (
  SELECT * EXCLUDE (_a, _b, _x, _y),
         CASE WHEN {stat} IS NULL THEN NULL WHEN _y = 0 THEN 1.0::DOUBLE WHEN _x = 0 THEN 0.0::DOUBLE
              WHEN _x <= 0.5 THEN {_series('_x', '_y', '_a', '_b')}
              ELSE 1 - {_series('_y', '_x', '_b', '_a')} END AS p
  FROM {out}_in)"""


def sql_p_t(source: str, out: str, log10: bool = False) -> str:
    t2 = "statistic * statistic"
    return sql_tail(
        source, out, "df / 2", "0.5", f"df / (df + {t2})", f"{t2} / (df + {t2})", "statistic", log10
    )


def sql_p_f(source: str, out: str, log10: bool = False) -> str:
    return sql_tail(
        source, out, "dfd / 2", "dfn / 2", "dfd / (dfd + dfn * f)", "dfn * f / (dfd + dfn * f)", "f", log10
    )


def sql_bh(source: str, out: str, family: str = "") -> str:
    """CTEs adding the step-up adjusted p and its stars."""
    by = f"PARTITION BY {family}" if family else ""
    return f"""
{out}_q AS (
  SELECT *, p * count(p) OVER ({by})
         / count(p) OVER ({by} ORDER BY p NULLS LAST RANGE UNBOUNDED PRECEDING) AS _q
  FROM {source}),
{out}_r AS (
  SELECT * EXCLUDE (_q), CASE WHEN p IS NOT NULL THEN least(1.0::DOUBLE, min(_q) OVER
         ({by} ORDER BY p DESC NULLS LAST RANGE UNBOUNDED PRECEDING)) END AS p_adj
  FROM {out}_q),
{out} AS (
  SELECT *, CASE WHEN p_adj <= 0.0001 THEN '****' WHEN p_adj <= 0.001 THEN '***'
         WHEN p_adj <= 0.01 THEN '**' WHEN p_adj <= 0.05 THEN '*' WHEN p_adj <= 1 THEN 'ns' END
         AS p_adj_signif
  FROM {out}_r)"""


SPREAD = "10 * 2.220446049250313e-16"


def sql_one_sample(source: str, out: str, keys: str) -> str:
    return (
        f"""
{out}_m AS (
  SELECT {keys}, count(value) AS n, avg(value) AS estimate,
         CASE WHEN count(value) > 1 THEN stddev_samp(value) / sqrt(count(value)) END AS _se
  FROM {source} GROUP BY {keys}),
{out}_s AS (
  SELECT * EXCLUDE (_se),
         CASE WHEN _se > 0 AND _se >= {SPREAD} * abs(estimate) THEN estimate / _se END AS statistic,
         CASE WHEN _se > 0 AND _se >= {SPREAD} * abs(estimate) THEN (n - 1)::DOUBLE END AS df
  FROM {out}_m),"""
        + sql_p_t(f"{out}_s", out)
    )


def sql_welch(source: str, out: str, keys: str) -> str:
    """``source`` has keys, group1, group2 and per arm n, m (mean), v (sample variance)."""
    return (
        f"""
{out}_v AS (
  SELECT {keys}, group1, group2, n1, n2, m1 AS estimate1, m2 AS estimate2, m1 - m2 AS estimate,
         CASE WHEN n1 > 1 AND n2 > 1 THEN v1 / n1 END AS _v1,
         CASE WHEN n1 > 1 AND n2 > 1 THEN v2 / n2 END AS _v2
  FROM {source}),
{out}_s AS (
  SELECT *, sqrt(_v1 + _v2) AS _se,
         sqrt(_v1 + _v2) > 0
           AND sqrt(_v1 + _v2) >= {SPREAD} * greatest(abs(estimate1), abs(estimate2)) AS _ok
  FROM {out}_v),
{out}_t AS (
  SELECT * EXCLUDE (_ok), CASE WHEN _ok THEN estimate / _se END AS statistic,
         CASE WHEN _ok THEN (_v1 + _v2) ** 2 / (_v1 ** 2 / (n1 - 1) + _v2 ** 2 / (n2 - 1)) END AS df
  FROM {out}_s),"""
        + sql_p_t(f"{out}_t", out)
    )


def sql_arms(source: str, out: str, keys: str, arm: str, labels: tuple[str, str]) -> str:
    """Arm summaries of two text labels per keys."""
    a, b = (f"FILTER ({arm} = '{x}')" for x in labels)
    return f"""
{out} AS (
  SELECT {keys}, '{labels[0]}' AS group1, '{labels[1]}' AS group2,
         count(value) {a} AS n1, count(value) {b} AS n2,
         avg(value) {a} AS m1, avg(value) {b} AS m2,
         var_samp(value) {a} AS v1, var_samp(value) {b} AS v2
  FROM {source} GROUP BY {keys})"""


def sql_pairs(source: str, out: str, keys: str) -> str:
    """Summaries of time 0 against 30, 60 and 120."""
    return f"""
{out} AS (
  SELECT {keys}, '0' AS group1, pair.b::INT::VARCHAR AS group2,
         count(value) FILTER ("time" = 0) AS n1, count(value) FILTER ("time" = pair.b) AS n2,
         avg(value) FILTER ("time" = 0) AS m1, avg(value) FILTER ("time" = pair.b) AS m2,
         var_samp(value) FILTER ("time" = 0) AS v1, var_samp(value) FILTER ("time" = pair.b) AS v2
  FROM {source}, (VALUES (30), (60), (120)) AS pair(b)
  WHERE "time" IN (0, pair.b)
  GROUP BY {keys}, pair.b)"""


def sql_limits(source: str, out: str) -> str:
    """95 % limits: the t quantile by Newton steps on the series tail, from the left."""
    one = "one"
    density = (
        "exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi())"
        " * (1 + q * q / df) ** (-(df + 1) / 2)"
    )
    half = "df / 2"
    x, y = "(df / (df + q * q))", "(q * q / (df + q * q))"
    tail = (
        f"CASE WHEN {x} <= 0.5 THEN {_series(x, y, half, '0.5::DOUBLE')}"
        f" ELSE 1 - {_series(y, x, '0.5::DOUBLE', half)} END"
    )
    return f"""
{out}_d AS (SELECT DISTINCT df FROM {source} WHERE df IS NOT NULL),
{out}_n AS (
  SELECT df, 1.9::DOUBLE AS q, 0 AS {one} FROM {out}_d
  UNION ALL
  SELECT df, q + (({tail}) - 0.05) / (2 * {density}), {one} + 1 FROM {out}_n WHERE {one} < 14),
{out} AS (
  SELECT s.*, estimate - q * _se AS conf_low, estimate + q * _se AS conf_high
  FROM {source} s LEFT JOIN (SELECT df, q FROM {out}_n WHERE {one} = 14) USING (df))"""


def sql_f_table(source: str, out: str, keys: str) -> str:
    """``source`` has keys, effect, dfn, dfd, ss, sse, mean."""
    ok = (
        "dfn >= 1 AND dfd >= 1 AND sse > 0"
        f" AND sqrt(sse / dfd) >= {SPREAD} * abs(mean)"
    )
    return (
        f"""
{out}_s AS (
  SELECT {keys}, effect, CASE WHEN {ok} THEN dfn::DOUBLE END AS dfn,
         CASE WHEN {ok} THEN dfd::DOUBLE END AS dfd,
         CASE WHEN {ok} THEN (ss / dfn) / (sse / dfd) END AS f,
         CASE WHEN {ok} THEN ss / (ss + sse) END AS ges
  FROM {source}),"""
        + sql_p_f(f"{out}_s", out)
    )


def sql_oneway(source: str, out: str, keys: str, factor: str, effect: str) -> str:
    """One-way sums of squares straight from the deviations of the rows."""
    part = f"PARTITION BY {keys}"
    return (
        f"""
{out}_w AS (
  SELECT {keys}, {factor} AS _f, value, avg(value) OVER ({part}) AS _g,
         avg(value) OVER ({part}, {factor}) AS _m
  FROM {source} WHERE {factor} IS NOT NULL),
{out}_e AS (
  SELECT {keys}, '{effect}' AS effect, count(DISTINCT _f) FILTER (value IS NOT NULL) - 1 AS dfn,
         count(value) - count(DISTINCT _f) FILTER (value IS NOT NULL) AS dfd, sum((_m - _g) ** 2) FILTER (value IS NOT NULL) AS ss,
         sum((value - _m) ** 2) AS sse, any_value(_g) AS mean
  FROM {out}_w GROUP BY {keys}),"""
        + sql_f_table(f"{out}_e", out, keys)
    )


def sql_slope(source: str, out: str, keys: str) -> str:
    return (
        f"""
{out}_e AS (
  SELECT {keys}, 'time' AS effect,
         CASE WHEN regr_sxx(value, "time") > 0 THEN 1 END AS dfn,
         regr_count(value, "time")::BIGINT - 2 AS dfd,
         regr_r2(value, "time") * regr_syy(value, "time") AS ss,
         (1 - regr_r2(value, "time")) * regr_syy(value, "time") AS sse,
         avg(value) AS mean
  FROM {source} GROUP BY {keys}),"""
        + sql_f_table(f"{out}_e", out, keys)
    )


def sql_ancova(source: str, out: str, keys: str) -> str:
    """value ~ site + time: residual sums of squares of three nested regressions."""
    part = f"PARTITION BY {keys}"
    return (
        f"""
{out}_c AS (
  SELECT {keys}, site, value AS _v,
         value - avg(value) OVER ({part}, site) AS _y,
         _t - avg(_t) OVER ({part}, site) AS _x,
         value - avg(value) OVER ({part}) AS _ty, _t - avg(_t) OVER ({part}) AS _tx
  FROM (SELECT *, CASE WHEN value IS NOT NULL THEN "time" END AS _t FROM {source}
        WHERE "time" IS NOT NULL)),
{out}_b AS (
  SELECT {keys}, count(DISTINCT site) FILTER (_v IS NOT NULL) AS k, count(_v) AS nn, avg(_v) AS mean,
         sum(_y * _y) AS r_site, sum(_x * _y) ** 2 / sum(_x * _x) AS s_time,
         sum(_ty * _ty) - sum(_tx * _ty) ** 2 / sum(_tx * _tx) AS r_time
  FROM {out}_c GROUP BY {keys}),
{out}_e AS (
  SELECT {keys}, 'site' AS effect, k - 1 AS dfn, nn - k - 1 AS dfd,
         r_time - (r_site - s_time) AS ss, r_site - s_time AS sse, mean FROM {out}_b
  UNION ALL
  SELECT {keys}, 'time', 1, nn - k - 1, s_time, r_site - s_time, mean FROM {out}_b),"""
        + sql_f_table(f"{out}_e", out, keys)
    )


def sql_ancova_factors(source: str, out: str, keys: str) -> str:
    """value ~ site + time with four time levels as a factor.

    Sites are projected out by centring; the three remaining time contrasts are solved
    through the explicit inverse of their 3 x 3 cross products.
    """
    within = f"OVER (PARTITION BY {keys}, site)"
    contrasts = ", ".join(
        f"(_t = {m})::INT::DOUBLE - avg((_t = {m})::INT::DOUBLE) {within} AS x{i}"
        for i, m in enumerate((30, 60, 120), 1)
    )
    products = ", ".join(f"sum(x{i} * x{j}) AS a{i}{j}" for i in (1, 2, 3) for j in range(i, 4))
    return (
        f"""
{out}_c AS (
  SELECT {keys}, site, value AS _v, value - avg(value) {within} AS _y,
         value - avg(value) OVER (PARTITION BY {keys}, _t) AS _z, {contrasts}
  FROM (SELECT *, "time" AS _t FROM {source} WHERE value IS NOT NULL AND "time" IS NOT NULL)),
{out}_b AS (
  SELECT {keys}, count(DISTINCT site) AS k, count(*) AS nn, avg(_v) AS mean, sum(_y * _y) AS r_site,
         sum(_z * _z) AS r_time, {products},
         sum(x1 * _y) AS b1, sum(x2 * _y) AS b2, sum(x3 * _y) AS b3
  FROM {out}_c GROUP BY {keys}),
{out}_q AS (
  SELECT *, (b1 * b1 * (a22 * a33 - a23 * a23) + b2 * b2 * (a11 * a33 - a13 * a13)
             + b3 * b3 * (a11 * a22 - a12 * a12) + 2 * b1 * b2 * (a13 * a23 - a12 * a33)
             + 2 * b1 * b3 * (a12 * a23 - a13 * a22) + 2 * b2 * b3 * (a12 * a13 - a11 * a23))
         / (a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13)
            + a13 * (a12 * a23 - a22 * a13)) AS s_time
  FROM {out}_b),
{out}_e AS (
  SELECT {keys}, 'site' AS effect, k - 1 AS dfn, nn - k - 3 AS dfd,
         r_time - (r_site - s_time) AS ss, r_site - s_time AS sse, mean FROM {out}_q
  UNION ALL
  SELECT {keys}, 'time', 3, nn - k - 3, s_time, r_site - s_time, mean FROM {out}_q),"""
        + sql_f_table(f"{out}_e", out, keys)
    )
