"""Grouped t tests, analysis of variance and covariance.

Every test is arithmetic on moments (count, mean, centred sum of squares). Moments
combine map-side and can be merged, so raw rows are read by one aggregate, a group
of any size reaches a task as a handful of partial results, and all tests over the
same data can share one moments table.

Degenerate groups (too few values, no spread, an arm or level missing) keep their
row with NULL statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteratio.functions.sqltext import exprs, ident, idents, number, over, present, text
from siteratio.functions.tails import add_p_f, add_p_t, add_t_ci
from siteratio.operators.joins import null_safe_join
from siteratio.schema import TERMS, TIME, VALUE, check_choice

#: Spread below this share of the mean counts as none (ten machine epsilons).
NO_SPREAD = 10 * 2.220446049250313e-16


# --------------------------------------------------------------------- moments


#: Columns of the tables below; a key of one of these names, or with an underscore first, would be ambiguous.
RESERVED = frozenset(
    "rows n mean css mx my sxx sxy syy group1 group2 n1 n2 m1 m2 s1 s2 estimate estimate1 estimate2 statistic"
    " df p conf_low conf_high effect dfn dfd ss sse f ges".split()
)


def _check_keys(keys: Sequence[str]) -> None:
    taken = sorted(k for k in keys if k.lower() in RESERVED or (k.startswith("_") and k != "_arm"))
    if taken:
        raise ValueError(f"rename the key columns {taken}: the tests use these names")


def cell_moments(df: DataFrame, keys: Sequence[str], value: str = VALUE) -> DataFrame:
    """keys, rows, n, mean, css: the sufficient statistics of a value per group."""
    _check_keys(keys)
    return (
        df.selectExpr(*idents(keys), f"{present(ident(value))} AS _v")
        .groupBy(*keys)
        .agg(
            *exprs(
                "count(1) AS rows",
                "count(_v) AS n",
                "avg(_v) AS mean",
                "coalesce(var_pop(_v) * count(_v), 0D) AS css",
            )
        )
    )


def merge_moments(m: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moments of coarser groups from finer ones.

    The window and the aggregate share one exchange, and its rows are finished cells
    (sites x times of an analyte), not measurements.
    """
    w = over(keys)
    grand = f"try_divide(sum(n * mean) {w}, sum(n) {w}) AS _g"
    return (
        m.selectExpr("*", grand)
        .groupBy(*keys)
        .agg(
            *exprs(
                "sum(rows) AS rows",
                "sum(n) AS n",
                "max(_g) AS mean",
                "sum(css + coalesce(n * (mean - _g) * (mean - _g), 0D)) AS css",
            )
        )
    )


def xy_moments(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """keys, n, mx, my, sxx, sxy, syy over rows where both x and y are present."""
    _check_keys(keys)
    return (
        df.selectExpr(
            *idents(keys), f"{present(ident(x))} AS _x", f"{present(ident(y))} AS _y"
        )
        .groupBy(*keys)
        .agg(
            *exprs(
                "regr_count(_y, _x) AS n",
                "regr_avgx(_y, _x) AS mx",
                "regr_avgy(_y, _x) AS my",
                "regr_sxx(_y, _x) AS sxx",
                "regr_sxy(_y, _x) AS sxy",
                "regr_syy(_y, _x) AS syy",
            )
        )
    )


def xy_from_cells(m: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """The same table when x is constant inside each moments cell."""
    return m.filter(f"{ident(x)} IS NOT NULL").selectExpr(
        *idents(keys),
        "n",
        f"cast({ident(x)} AS double) AS mx",
        "mean AS my",
        "0D AS sxx",
        "0D AS sxy",
        "css AS syy",
    )


def _centred(m: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the group means _gx, _gy and the offsets _dx, _dy of each row from them."""
    w = over(keys)
    return m.selectExpr(
        "*",
        f"try_divide(sum(n * mx) {w}, sum(n) {w}) AS _gx",
        f"try_divide(sum(n * my) {w}, sum(n) {w}) AS _gy",
    ).selectExpr("*", "mx - _gx AS _dx", "my - _gy AS _dy")


def merge_xy(m: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Joint moments of coarser groups from finer ones."""
    return (
        _centred(m, keys)
        .groupBy(*keys)
        .agg(
            *exprs(
                "sum(n) AS n",
                "max(_gx) AS mx",
                "max(_gy) AS my",
                "sum(sxx + n * _dx * _dx) AS sxx",
                "sum(sxy + n * _dx * _dy) AS sxy",
                "sum(syy + n * _dy * _dy) AS syy",
            )
        )
    )


# --------------------------------------------------------------------- t tests


def one_sample_from_moments(m: DataFrame, keys: Sequence[str], mu: float = 0.0) -> DataFrame:
    usable = f"_se > 0 AND _se >= {NO_SPREAD} * abs(mean)"
    tested = m.selectExpr(
        *idents(keys), "n", "mean", "CASE WHEN n > 1 THEN sqrt(css / (n - 1) / n) END AS _se"
    ).selectExpr(
        *idents(keys),
        "n",
        "mean AS estimate",
        f"CASE WHEN {usable} THEN (mean - {number(mu)}) / _se END AS statistic",
        f"CASE WHEN {usable} THEN cast(n - 1 AS double) END AS df",
    )
    return add_p_t(tested)


def ttest_one_sample(
    df: DataFrame, keys: Sequence[str], value: str = VALUE, mu: float = 0.0
) -> DataFrame:
    """Two-sided test of mean = mu per group."""
    return one_sample_from_moments(cell_moments(df, keys, value), keys, mu)


def _welch(arms: DataFrame, keys: Sequence[str], detailed: bool, conf: float) -> DataFrame:
    """Unequal-variance test from columns n1, m1, s1, n2, m2, s2 (s = centred squares)."""
    head = [*idents(keys), "group1", "group2"]
    numbers = ["n1", "n2", "estimate1", "estimate2", "estimate"]
    spread = arms.selectExpr(
        *head,
        "coalesce(n1, 0L) AS n1",
        "coalesce(n2, 0L) AS n2",
        "m1 AS estimate1",
        "m2 AS estimate2",
        "m1 - m2 AS estimate",
        "CASE WHEN n1 > 1 AND n2 > 1 THEN s1 / (n1 - 1) / n1 END AS _v1",
        "CASE WHEN n1 > 1 AND n2 > 1 THEN s2 / (n2 - 1) / n2 END AS _v2",
    ).selectExpr(*head, *numbers, "_v1", "_v2", "sqrt(_v1 + _v2) AS _se")
    usable = (
        f"_se > 0 AND _se >= {NO_SPREAD} * greatest(abs(estimate1), abs(estimate2))"
    )
    dof = "(_v1 + _v2) * (_v1 + _v2) / (_v1 * _v1 / (n1 - 1) + _v2 * _v2 / (n2 - 1))"
    tested = add_p_t(
        spread.selectExpr(
            *head,
            *numbers,
            "_se",
            f"CASE WHEN {usable} THEN estimate / _se END AS statistic",
            f"CASE WHEN {usable} THEN {dof} END AS df",
        )
    )
    plain = [*keys, "group1", "group2", "n1", "n2", "statistic", "df", "p"]
    if not detailed:
        return tested.select(*plain)
    return add_t_ci(tested, "estimate", "_se", "df", conf).select(
        *plain, "estimate", "estimate1", "estimate2", "conf_low", "conf_high"
    )


def welch_from_moments(
    m: DataFrame,
    keys: Sequence[str],
    group_col: str,
    detailed: bool = False,
    conf: float = 0.95,
    levels: Sequence[str] | None = None,
) -> DataFrame:
    """``m`` has one moments row per keys and level of ``group_col``.

    The two ``levels`` name the arms; without them they are the two labels of the whole column.
    A group that lacks one keeps both labels, with no values in that arm.
    """
    g = ident(group_col)
    if levels is None:
        found = m.filter(f"{g} IS NOT NULL").select(F.expr(f"cast({g} AS string)")).distinct()
        levels = sorted(r[0] for r in found.limit(3).collect())
    if len(levels) > 2:
        raise ValueError("a two-sample test needs two levels")
    labels = [text(str(v)) for v in levels] + ["cast(NULL AS string)"] * (2 - len(levels))
    picks = [
        f"max(CASE WHEN cast({g} AS string) = {label} THEN {c} END) AS {out}{k}"
        for k, label in enumerate(labels, start=1)
        for c, out in (("n", "n"), ("mean", "m"), ("css", "s"))
    ]
    other = "cast(raise_error('a two-sample test needs two levels') AS string)"
    strange = f"count_if(cast({g} AS string) NOT IN ({', '.join(labels)}))"
    arms = (
        m.filter(f"{g} IS NOT NULL")
        .groupBy(*keys)
        .agg(*exprs(*picks, f"CASE WHEN {strange} > 0 THEN {other} ELSE {labels[0]} END AS group1"))
        .selectExpr("*", f"{labels[1]} AS group2")
    )
    return _welch(arms, keys, detailed, conf)


def ttest_welch(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    group_col: str,
    detailed: bool = False,
    conf: float = 0.95,
    levels: Sequence[str] | None = None,
) -> DataFrame:
    """Two-sample test per group; group1 is the first label in sort order, or of ``levels``."""
    m = cell_moments(df, [*keys, group_col], value)
    return welch_from_moments(m, keys, group_col, detailed, conf, levels)


def pairs_from_moments(
    m: DataFrame,
    keys: Sequence[str],
    group_col: str,
    pairs: Sequence[tuple[float, float]],
    detailed: bool = False,
    conf: float = 0.95,
) -> DataFrame:
    """Each moments row is dealt to the pairs it takes part in; no self-join."""
    seats = [
        f"CASE WHEN {ident(group_col)} = {number(level)}"
        f" THEN named_struct('i', {i}, 'side', {side}) END"
        for i, pair in enumerate(pairs)
        for side, level in enumerate(pair, start=1)
    ]
    dealt = m.selectExpr(
        *idents(keys), "n", "mean", "css", f"explode(array_compact(array({', '.join(seats)}))) AS _s"
    ).selectExpr(*idents(keys), "n", "mean", "css", "_s.i AS _i", "_s.side AS _side")
    picks = [
        f"max(CASE WHEN _side = {k} THEN {c} END) AS {out}{k}"
        for k in (1, 2)
        for c, out in (("n", "n"), ("mean", "m"), ("css", "s"))
    ]
    labels = [
        f"element_at(array({', '.join(text(f'{p[k]:g}') for p in pairs)}), _i + 1) AS group{k + 1}"
        for k in (0, 1)
    ]
    arms = dealt.groupBy(*keys, "_i").agg(*exprs(*picks)).selectExpr("*", *labels)
    return _welch(arms, keys, detailed, conf)


def ttest_pairs(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    group_col: str,
    pairs: Sequence[tuple[float, float]],
    detailed: bool = False,
    conf: float = 0.95,
) -> DataFrame:
    """Welch tests of listed pairs of levels, one row per pair."""
    m = cell_moments(df, [*keys, group_col], value)
    return pairs_from_moments(m, keys, group_col, pairs, detailed, conf)


# ---------------------------------------------------------- analysis of variance


def _f_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns effect, dfn, dfd, ss, sse, mean -> the finished table of effects."""
    usable = (
        "dfn >= 1 AND dfd >= 1 AND sse > 0"
        f" AND sqrt(try_divide(sse, dfd)) >= {NO_SPREAD} * abs(mean)"
    )
    tested = df.selectExpr(
        *idents(keys),
        "effect",
        f"CASE WHEN {usable} THEN cast(dfn AS double) END AS dfn",
        f"CASE WHEN {usable} THEN cast(dfd AS double) END AS dfd",
        f"CASE WHEN {usable} THEN (ss / dfn) / (sse / dfd) END AS f",
        f"CASE WHEN {usable} THEN ss / (ss + sse) END AS ges",
    )
    return add_p_f(tested).select(*keys, "effect", "dfn", "dfd", "f", "p", "ges")


def oneway_from_moments(
    m: DataFrame, keys: Sequence[str], factor: str, effect: str | None = None
) -> DataFrame:
    """``m`` has one moments row per keys and level of ``factor``."""
    w = over(keys)
    summed = (
        m.filter(f"{ident(factor)} IS NOT NULL")
        .selectExpr("*", f"try_divide(sum(n * mean) {w}, sum(n) {w}) AS _g")
        .groupBy(*keys)
        .agg(
            *exprs(
                "count_if(n > 0) - 1 AS dfn",
                "sum(n) - count_if(n > 0) AS dfd",
                "max(_g) AS mean",
                "sum(n * (mean - _g) * (mean - _g)) AS ss",
                "sum(css) AS sse",
            )
        )
    )
    return _f_rows(summed.selectExpr("*", f"{text(effect or factor)} AS effect"), keys)


def anova_oneway(
    df: DataFrame, keys: Sequence[str], value: str, factor: str, effect: str | None = None
) -> DataFrame:
    """value ~ factor per group."""
    return oneway_from_moments(cell_moments(df, [*keys, factor], value), keys, factor, effect)


def slope_from_xy(xy: DataFrame, keys: Sequence[str], effect: str = TIME) -> DataFrame:
    """Regression of y on x from a joint-moments table."""
    fitted = xy.selectExpr(
        *idents(keys),
        f"{text(effect)} AS effect",
        "CASE WHEN sxx > 0 THEN 1L END AS dfn",
        "n - 2 AS dfd",
        "my AS mean",
        "syy",
        "try_divide(sxy * sxy, sxx) AS ss",
    )
    return _f_rows(fitted.selectExpr("*", "syy - ss AS sse"), keys)


def anova_time(
    df: DataFrame, keys: Sequence[str], value: str, time_col: str = TIME, term: str = "numeric"
) -> DataFrame:
    """value ~ time per group: a regression slope, or a one-way table under ``factor``."""
    check_choice("term", term, TERMS)
    if term == "factor":
        return anova_oneway(df, keys, value, time_col)
    return slope_from_xy(xy_moments(df, keys, time_col, value), keys, time_col)


def ancova_from_xy(
    within: DataFrame, keys: Sequence[str], factor: str, covariate: str
) -> DataFrame:
    """Both effects of value ~ factor + covariate with type II sums of squares.

    ``within`` has one joint-moments row per keys and level. Each effect is adjusted
    for the other: the covariate through the pooled within-level regression, the
    factor through the gain over the regression that ignores it.
    """
    solved = (
        _centred(within.filter(f"{ident(factor)} IS NOT NULL"), keys)
        .groupBy(*keys)
        .agg(
            *exprs(
                "count_if(n > 0) AS _k",
                "sum(n) AS _nn",
                "max(_gy) AS mean",
                "sum(syy) AS _wyy",
                "try_divide(sum(sxy) * sum(sxy), sum(sxx)) AS _ss_cov",
                "sum(syy + n * _dy * _dy) - try_divide("
                "sum(sxy + n * _dx * _dy) * sum(sxy + n * _dx * _dy), sum(sxx + n * _dx * _dx))"
                " AS _sse_cov_only",
            )
        )
    )
    effects = (
        f"explode(array(named_struct('effect', {text(factor)}, 'dfn', _k - 1,"
        " 'ss', _sse_cov_only - (_wyy - _ss_cov)),"
        f" named_struct('effect', {text(covariate)}, 'dfn', 1L, 'ss', _ss_cov))) AS _e"
    )
    rows = solved.selectExpr(
        *idents(keys), "_nn - _k - 1 AS dfd", "_wyy - _ss_cov AS sse", "mean", effects
    )
    return _f_rows(rows.selectExpr(*idents(keys), "_e.*", "dfd", "sse", "mean"), keys)


#: A pivot below this share of its level's values is rounding: the level is settled by the ones before it.
_NO_PIVOT = 1e-9


def _eliminated() -> str:
    """Forward elimination of the symmetric system ``a`` x = ``b``; a level without a pivot is left out.

    ``a`` is positive semidefinite, so where a pivot is zero its row is too, and no exchange of rows is needed.
    """
    state = "struct<a: array<array<double>>, b: array<double>, kept: array<boolean>>"
    pivot = "s.a[k][k]"
    ok = f"{pivot} > {_NO_PIVOT} * sizes[k]"
    rows = f"transform(s.a, (r, i) -> if(i > k AND {ok}, transform(r, (v, j) -> v - s.a[i][k] * s.a[k][j] / {pivot}), r))"
    right = f"transform(s.b, (v, i) -> if(i > k AND {ok}, v - s.a[i][k] * s.b[k] / {pivot}, v))"
    return (
        f"aggregate(sequence(0, size(b) - 1), cast(named_struct('a', a, 'b', b, 'kept', array()) AS {state}),"
        f" (s, k) -> cast(named_struct('a', {rows}, 'b', {right}, 'kept', concat(s.kept, array({ok}))) AS {state}))"
    )


def _substituted() -> str:
    """The solution of the eliminated system ``s``, last level first; levels left out are 0."""
    known = "aggregate(zip_with(slice(s.a[k], k + 2, size(x)), x, (v, w) -> v * w), 0D, (t, v) -> t + v)"
    value = f"if(s.kept[k], (s.b[k] - {known}) / s.a[k][k], 0D)"
    return (
        "aggregate(reverse(sequence(0, size(s.b) - 1)), cast(array() AS array<double>),"
        f" (x, k) -> cast(concat(array({value}), x) AS array<double>))"
    )


def ancova_factors_from_moments(
    m: DataFrame, keys: Sequence[str], factor: str, covariate: str
) -> DataFrame:
    """Both effects of two factors, type II, from cell moments.

    The levels of ``factor`` are projected out: centring each of them leaves one equation per level of
    ``covariate``, whose coefficients are sums over the levels of ``factor`` and combine map-side. That small
    system is solved in an expression. Residuals are then taken cell by cell, so a perfect fit leaves
    no rounding behind. Layouts that fall apart (levels that share no cell) have the rank they have.
    """
    inside, across = [*keys, "_f"], [*keys, "_c"]
    mean_of = lambda by: f"sum(n * mean) {over(by)} / sum(n) {over(by)}"
    cells = (
        m.filter(f"n > 0 AND {ident(factor)} IS NOT NULL AND {ident(covariate)} IS NOT NULL")
        .selectExpr(*idents(keys), f"{ident(factor)} AS _f", f"{ident(covariate)} AS _c", "cast(n AS double) AS n", "mean", "css")
        .selectExpr("*", f"{mean_of(across)} AS _mc")
        .selectExpr("*", f"{mean_of(inside)} AS _mf", f"sum(n) {over(inside)} AS _nf")
    )
    levels = cells.groupBy(*inside).agg(
        F.expr("max(_nf) AS _nf"), F.expr("collect_list(struct(_c, n, mean - _mf AS d)) AS cs")
    )
    # for a level of the covariate and each it shares a level of the factor with: its coefficient
    own = levels.selectExpr(*idents(keys), "_nf", "cs", "inline(cs)")
    terms = own.selectExpr(
        *idents(keys),
        "_c",
        "n * d AS _b",
        "n",
        "inline(transform(cs, e -> struct(e._c AS _k, if(e._c = _c, n, 0D) - n * e.n / _nf AS _v, e._c = _c AS _own)))",
    )
    entries = terms.groupBy(*keys, "_c", "_k").agg(
        *exprs("sum(_v) AS _v", "sum(if(_own, _b, 0D)) AS _b", "sum(if(_own, n, 0D)) AS _n")
    )
    rows = entries.groupBy(*keys, "_c").agg(
        *exprs("sum(_b) AS _b", "sum(_n) AS _n", "collect_list(struct(_k, _v)) AS _row")
    )
    system = rows.groupBy(*keys).agg(F.expr("sort_array(collect_list(struct(_c, _b, _n, _row))) AS _rows")).selectExpr(
        *idents(keys),
        "transform(_rows, r -> r._c) AS levels",
        "transform(_rows, r -> r._b) AS b",
        "transform(_rows, r -> r._n) AS sizes",
        "transform(_rows, r -> transform(_rows, q -> coalesce(get(filter(r._row, e -> e._k = q._c), 0)._v, 0D))) AS a",
    )
    solved = (
        system.selectExpr(*idents(keys), "levels", f"{_eliminated()} AS s")
        .selectExpr(*idents(keys), "levels", "size(filter(s.kept, x -> x)) AS _rank", f"{_substituted()} AS x")
        .selectExpr(*idents(keys), "size(levels) AS _levels", "_rank", "map_from_arrays(levels, x) AS _effects")
    )
    fitted = (
        null_safe_join(cells, solved, keys)
        .selectExpr("*", "element_at(_effects, _c) AS _e")
        .selectExpr("*", f"sum(n * _e) {over(inside)} / _nf AS _ef")
    )
    summed = fitted.groupBy(*keys).agg(
        *exprs(
            "sum(n) AS _nn",
            "cast(round(sum(n / _nf)) AS bigint) AS _sites",
            "max(_levels) AS _times",
            "max(_rank) AS _rank",
            "sum(n * mean) / sum(n) AS mean",
            "sum(css) AS _within",
            "sum(n * pow(mean - _mf - _e + _ef, 2)) AS _full",
            "sum(n * pow(mean - _mf, 2)) AS _only_f",
            "sum(n * pow(mean - _mc, 2)) AS _only_c",
        )
    )
    effects = (
        f"inline(array(named_struct('effect', {text(factor)}, 'dfn', _sites + _rank - _times, 'ss', _only_c - _full),"
        f" named_struct('effect', {text(covariate)}, 'dfn', cast(_rank AS bigint), 'ss', _only_f - _full)))"
    )
    told = summed.selectExpr(
        *idents(keys), "mean", "_within + _full AS sse", "cast(_nn AS bigint) - _sites - _rank AS dfd", effects
    )
    return _f_rows(told, keys)


def ancova(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    factor: str,
    covariate: str = TIME,
    term: str = "numeric",
) -> DataFrame:
    """value ~ factor + covariate per group, one row per effect, type II."""
    check_choice("term", term, TERMS)
    if term == "factor":
        m = cell_moments(df, [*keys, factor, covariate], value)
        return ancova_factors_from_moments(m, keys, factor, covariate)
    return ancova_from_xy(xy_moments(df, [*keys, factor], covariate, value), keys, factor, covariate)
