"""Tail probabilities of the t and F distributions and the t quantile.

Spark has no such functions, so a NumPy kernel runs over Arrow batches. It is
applied to tables of finished test statistics, never to raw rows.

P(|T_v| >= t) = I_x(v/2, 1/2) with x = v / (v + t^2), and
P(F_{d1,d2} >= f) = I_x(d2/2, d1/2) with x = d2 / (d2 + d1 f), where I is the
regularised incomplete beta function. A continued fraction gives it up to some thousand degrees of
freedom; beyond, where the fraction's first step cancels, I is expanded around the incomplete gamma
function it tends to (DiDonato and Morris, 1992). The relative error stays below 1e-10 up to 1e12 degrees of freedom
in the denominator, as long as the numerator has far fewer. Logarithms of tails are found without the tail itself, so
they keep their digits where the tail is below the smallest double.
"""

from __future__ import annotations

import math
import sys
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Lanczos coefficients for g = 7, n = 9.
LANCZOS_G = 7.0
LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)

_LARGE = 20.0
_MAX_STEPS = 20_000


def _log_gamma(z: np.ndarray) -> np.ndarray:
    w = z - 1.0
    series = np.full_like(w, LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        series += c / (w + i)
    base = w + LANCZOS_G + 0.5
    return 0.5 * np.log(2 * np.pi) + (w + 0.5) * np.log(base) - base + np.log(series)


def _stirling_rest(z: np.ndarray) -> np.ndarray:
    """log Gamma(z) minus its leading Stirling terms, for large z."""
    r = 1.0 / (z * z)
    return (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / z


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log B(a, b) without the cancellation of three huge log-gammas."""
    big, small = np.maximum(a, b), np.minimum(a, b)
    plain = _log_gamma(a) + _log_gamma(b) - _log_gamma(a + b)
    safe = np.maximum(big, _LARGE)
    step = (
        (safe - 0.5) * np.log1p(small / safe)
        + small * np.log(safe + small)
        - small
        + _stirling_rest(safe + small)
        - _stirling_rest(safe)
    )
    return np.where(big >= _LARGE, _log_gamma(small) - step, plain)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of I_x(a, b), modified Lentz; finished rows drop out."""
    tiny = 1e-300
    out = np.ones_like(x)
    rows = np.arange(x.size)
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, _MAX_STEPS + 1):
        if rows.size == 0:
            break
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        out[rows] = h
        keep = np.abs(step - 1.0) > 1e-16
        rows, a, b, x, c, d, h = (v[keep] for v in (rows, a, b, x, c, d, h))
    out[rows] = np.nan  # not converged: no value rather than a partial one
    return out


#: The expansion is used from this first parameter on, while the second is small beside it and x near 1.
_EXPANDED_FROM = 5000.0


def _gamma_ratio(b: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Q(b, u) as j * exp(scale), and exp(-scale) times u^b e^-u / Gamma(b).

    Below b + 1 from the power series of its complement, above from its continued fraction.
    """
    log_h = b * np.log(u) - u - _log_gamma(b)
    low = u < b + 1.0
    j, unit, scale = np.empty_like(u), np.ones_like(u), np.where(low, 0.0, log_h)
    if low.any():
        bb, uu = b[low], u[low]
        term = total = 1.0 / bb
        for n in range(1, _MAX_STEPS):
            term = term * uu / (bb + n)
            total = total + term
            if (term <= 1e-17 * total).all():
                break
        unit[low] = np.exp(log_h[low])
        j[low] = 1.0 - unit[low] * total
    if not low.all():
        bb, uu = b[~low], u[~low]
        tiny = 1e-300
        f = uu + 1.0 - bb
        c, d = np.full_like(f, 1 / tiny), 1.0 / f
        h = d.copy()
        for n in range(1, _MAX_STEPS):
            num = n * (bb - n)
            f = f + 2.0
            d = f + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = f + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
            if (np.abs(step - 1.0) < 1e-16).all():
                break
        j[~low] = h
    return j, unit, scale


def _expanded(a: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """I_x(a, b) for large a as ``part`` * exp(``log_front``); y = 1 - x."""
    t = a + (b - 1.0) / 2
    log_x = np.log1p(-y)
    u = -t * log_x
    j, unit, scale = _gamma_ratio(b, u)
    # Gamma(a + b) / Gamma(a) / t^b
    log_front = (
        (a - 0.5) * np.log1p(b / a)
        + b * np.log1p((b + 1.0) / 2 / t)
        - b
        + _stirling_rest(a + b)
        - _stirling_rest(a)
    )
    total, p = j.copy(), [np.ones_like(a)]
    b2n, power, quarter = b.copy(), unit.copy(), (log_x / 2) ** 2
    for n in range(1, 16):
        nth = sum((m * b - n) * p[n - m] / math.factorial(2 * m + 1) for m in range(1, n)) / n
        p.append(nth + (b - 1.0) / math.factorial(2 * n + 1))
        j = (b2n * (b2n + 1.0) * j + (u + b2n + 1.0) * power) / (4 * t * t)
        power = power * quarter
        b2n = b2n + 2.0
        total = total + p[n] * j
    return log_front + scale, total


def _inc_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """I_x(a, b) and its logarithm for 0 < x < 1; ``y`` is 1 - x, passed in to keep its precision."""
    swap = x >= (a + 1.0) / (a + b + 2.0)
    p, q = np.where(swap, b, a), np.where(swap, a, b)
    u, v = np.where(swap, y, x), np.where(swap, x, y)
    log_front, part = np.empty_like(x), np.empty_like(x)
    with np.errstate(divide="ignore", invalid="ignore"):
        near = -np.log1p(-y) <= 1.0
        big = (a >= _EXPANDED_FROM) & (b**3 <= 0.05 * a * a) & near & (y > 0)
        if big.any():
            log_front[big], part[big] = _expanded(a[big], b[big], y[big])
        rest = ~big
        if rest.any():
            pp, qq, uu, vv = (w[rest] for w in (p, q, u, v))
            log_u = np.where(uu > 0.5, np.log1p(-vv), np.log(uu))
            log_v = np.where(vv > 0.5, np.log1p(-uu), np.log(vv))
            log_front[rest] = pp * log_u + qq * log_v - _log_beta(pp, qq) - np.log(pp)
            part[rest] = _beta_fraction(pp, qq, uu)
        swap &= rest
        direct = np.exp(log_front) * part
        value = np.clip(np.where(swap, 1.0 - direct, direct), 0.0, 1.0)
        log = np.where(swap, np.log1p(-np.minimum(direct, 1.0)), log_front + np.log(part))
    return value, np.minimum(log, 0.0)


def inc_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """I_x(a, b) for 0 < x < 1, with y = 1 - x."""
    return _inc_beta(a, b, x, y)[0]


def _tails(stat: np.ndarray, valid: np.ndarray, log10: bool, parameters) -> np.ndarray:
    """Tails (or their decimal logarithms) of statistics from 0 to infinity; NaN where not valid."""
    out = np.full(stat.shape, np.nan)
    out[valid & np.isinf(stat)] = -np.inf if log10 else 0.0
    out[valid & (stat == 0)] = 0.0 if log10 else 1.0
    core = valid & np.isfinite(stat) & (stat > 0)
    if core.any():
        value, log = _inc_beta(*parameters(core))
        out[core] = log / math.log(10) if log10 else value
    return out


def t_two_sided(t: np.ndarray, dof: np.ndarray, log10: bool = False) -> np.ndarray:
    t, dof = np.abs(np.asarray(t, float)), np.asarray(dof, float)

    def parameters(core):
        tt, v = t[core] ** 2, dof[core]
        return v / 2, np.full_like(v, 0.5), v / (v + tt), tt / (v + tt)

    return _tails(t, ~np.isnan(t) & (dof > 0) & np.isfinite(dof), log10, parameters)


def f_upper(f: np.ndarray, d1: np.ndarray, d2: np.ndarray, log10: bool = False) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))

    def parameters(core):
        g, a, b = f[core], d1[core], d2[core]
        return b / 2, a / 2, b / (b + a * g), a * g / (b + a * g)

    valid = ~np.isnan(f) & (f >= 0) & (d1 > 0) & (d2 > 0) & np.isfinite(d1) & np.isfinite(d2)
    return _tails(f, valid, log10, parameters)


def t_two_sided_quantile(alpha: float, dof: np.ndarray) -> np.ndarray:
    """t with P(|T| >= t) = alpha.

    The tail is convex in t > 0, so Newton steps from the normal quantile (which
    lies left of every t quantile) climb to the root without overshooting.
    """
    dof = np.asarray(dof, float)
    out = np.full(dof.shape, np.nan)
    rows = np.flatnonzero((dof > 0) & np.isfinite(dof))
    t = np.full(rows.size, NormalDist().inv_cdf(1 - alpha / 2))
    for _ in range(200):
        if rows.size == 0:
            break
        v = dof[rows]
        half = np.full_like(v, 0.5)
        log_density = -_log_beta(v / 2, half) - 0.5 * np.log(v) - (v + 1) / 2 * np.log1p(t * t / v)
        step = (t_two_sided(t, v) - alpha) / (2 * np.exp(log_density))
        t = t + step
        out[rows] = t
        keep = np.abs(step) > 1e-13 * t
        rows, t, step = rows[keep], t[keep], step[keep]
    if rows.size:  # still moving by more than rounding: no value
        out[rows[np.abs(step) > 1e-9 * t]] = np.nan
    return out


@F.pandas_udf(T.DoubleType())
def _p_t(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(float), dof.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def _p_f(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_upper(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def _log_p_t(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(float), dof.to_numpy(float), log10=True))


@F.pandas_udf(T.DoubleType())
def _log_p_f(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_upper(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float), log10=True))


@F.pandas_udf(T.DoubleType())
def _q_t(dof: pd.Series, alpha: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided_quantile(float(alpha.iloc[0]), dof.to_numpy(float)))


# The kernel travels inside the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def add_p_t(
    df: DataFrame, t: str = "statistic", dof: str = "df", out: str = "p", log10: bool = False
) -> DataFrame:
    """Add the two-sided t tail probability, or its decimal logarithm; NULL in, NULL out."""
    return df.withColumn(out, (_log_p_t if log10 else _p_t)(t, dof))


def add_p_f(
    df: DataFrame, f: str = "f", d1: str = "dfn", d2: str = "dfd", out: str = "p", log10: bool = False
) -> DataFrame:
    """Add the upper F tail probability, or its decimal logarithm; NULL in, NULL out."""
    return df.withColumn(out, (_log_p_f if log10 else _p_f)(f, d1, d2))


def add_t_quantile(
    df: DataFrame, dof: str = "df", conf: float = 0.95, out: str = "t_quantile"
) -> DataFrame:
    """Add the t value that leaves (1 - conf) / 2 in each tail."""
    return df.withColumn(out, _q_t(dof, F.lit(1.0 - conf)))


def add_t_ci(
    df: DataFrame, est: str = "estimate", se: str = "se", dof: str = "df", conf: float = 0.95
) -> DataFrame:
    """Add conf_low and conf_high around an estimate."""
    with_q = add_t_quantile(df, dof, conf, "_tq")
    return with_q.selectExpr(
        "*", f"{est} - _tq * {se} AS conf_low", f"{est} + _tq * {se} AS conf_high"
    ).drop("_tq")
