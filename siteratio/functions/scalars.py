"""Column expressions: text, numbers, labels. All stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteratio.functions.sqltext import ident, text
from siteratio.schema import NONFINITE, check_choice

#: Text that counts as a number. A bare cast would also take '1.5d' or '2f'.
NUMERIC_SHAPE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

#: Suffix of a re-acquired sample: year tag plus the rest of the date.
RERUN_SUFFIX = r"_2021[0-9]+"

INF = float("inf")
NAN = float("nan")


def null_double() -> Column:
    return F.lit(None).cast("double")


def to_double_text(expression: str) -> str:
    """The same rule as ``to_double`` for a text expression."""
    shape = text(NUMERIC_SHAPE)
    return f"CASE WHEN {expression} RLIKE {shape} THEN try_cast(trim({expression}) AS double) END"


def to_double(c: Column) -> Column:
    """Text to double; anything that is not a plain number becomes NULL."""
    text = c.cast("string")
    return F.when(text.rlike(NUMERIC_SHAPE), F.trim(text).try_cast("double"))


def clean(c: Column) -> Column:
    """NaN counts as missing."""
    return F.nanvl(c.cast("double"), null_double())


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF))


def divide_safe(a: Column, b: Column, nonfinite: str = "null") -> Column:
    """a / b that never raises; ``nonfinite`` picks NULL or IEEE results for x/0."""
    check_choice("nonfinite", nonfinite, NONFINITE)
    a, b = a.cast("double"), b.cast("double")
    if nonfinite == "null":
        q = F.try_divide(a, b)
        return F.when(is_finite(q), q)
    at_zero = (
        F.when(F.isnan(a) | (a == 0), F.lit(NAN))
        .when(a > 0, F.lit(INF))
        .when(a < 0, F.lit(-INF))
    )
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def log2_safe(c: Column, nonfinite: str = "null") -> Column:
    """log2 with NULL (or -Infinity / NaN under ``ieee``) outside the positive numbers."""
    check_choice("nonfinite", nonfinite, NONFINITE)
    c = c.cast("double")
    if nonfinite == "null":
        return F.when(is_finite(c) & (c > 0), F.log2(c))
    return (
        F.when(F.isnan(c) | (c < 0), F.lit(NAN))
        .when(c == 0, F.lit(-INF))
        .when(c > 0, F.log2(c))
    )


def quotient_text(a: str, b: str, nonfinite: str = "null") -> str:
    """a / b as text that never raises. Under ``null``, results that are not finite are left to ``all_there_text``."""
    check_choice("nonfinite", nonfinite, NONFINITE)
    q = f"try_divide({a}, {b})"
    if nonfinite == "null":
        return q
    at_zero = f"CASE WHEN isnan({a}) OR {a} = 0 THEN double('NaN') WHEN {a} > 0 THEN double('Infinity') WHEN {a} < 0 THEN double('-Infinity') END"
    return f"CASE WHEN {b} = 0 THEN {at_zero} ELSE {q} END"


def all_there_text(least: str, greatest: str, nonfinite: str = "null") -> str:
    """Whether no quotient of a sorted array is missing (nor, under ``null``, not finite), by its two ends.

    NULLs sort first and NaN last.
    """
    if nonfinite == "null":
        return f"{least} > double('-Infinity') AND {greatest} < double('Infinity')"
    return f"{least} IS NOT NULL AND NOT isnan({greatest})"


def log2_text(x: str, nonfinite: str = "null") -> str:
    """``log2_safe`` for an expression written as text (log2 itself is NULL from 0 down)."""
    check_choice("nonfinite", nonfinite, NONFINITE)
    if nonfinite == "null":
        return f"CASE WHEN {x} < double('Infinity') THEN log2({x}) END"
    below = f"WHEN isnan({x}) OR {x} < 0 THEN double('NaN') WHEN {x} = 0 THEN double('-Infinity')"
    return f"CASE {below} ELSE log2({x}) END"


def paste(*cols: Column, sep: str = "_") -> Column:
    """Join as text; a missing part is written 'NA'."""
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("NA")) for c in cols])


def number_label(c: Column) -> Column:
    """A number as a label: 30.0 reads '30', 2.5 stays '2.5'."""
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def strip_rerun(c: Column) -> Column:
    return F.regexp_replace(c, RERUN_SUFFIX, "")


def replace_seq(c: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Literal replacements applied one after the other, everywhere in the text."""
    return reduce(lambda acc, ab: F.replace(acc, F.lit(ab[0]), F.lit(ab[1])), pairs, c)


def recode_value(c: Column, mapping: Mapping[str, str]) -> Column:
    """Look the text up in a small fixed map; texts outside the map are kept."""
    flat = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*flat), c), c)


def cond_replace(c: Column, mapping: Mapping[str, str]) -> Column:
    """Overwrite exact matches, keep everything else (NULL included)."""
    out = c
    for old, new in mapping.items():
        out = F.when(c == F.lit(old), F.lit(new)).otherwise(out)
    return out


def map_timepoint(c: Column, labels: Mapping[str, float]) -> Column:
    """Time label to minutes; an unknown label is read as a number if it is one."""
    flat = [F.lit(x) for k, v in labels.items() for x in (k, float(v))]
    return F.coalesce(F.try_element_at(F.create_map(*flat), c), to_double(c))


def flag_fed(time: Column) -> Column:
    return F.when(time == 0, "Fast").when(time.isNotNull(), "Fed")


def flag_direction(median: Column) -> Column:
    m = clean(median)
    return F.when(m > 0, "release").when(m < 0, "uptake").when(m == 0, "none")


def abs_diff(a: Column, b: Column) -> Column:
    return F.abs(a - b)


# Upper ends of the significance classes, each end inside its class.
STARS = ((1e-4, "****"), (1e-3, "***"), (1e-2, "**"), (0.05, "*"), (1.0, "ns"))


def signif_stars_text(p_adj: str) -> str:
    cases = " ".join(f"WHEN {p_adj} <= {cut!r}D THEN '{label}'" for cut, label in STARS)
    return f"CASE {cases} END"


def signif_stars(p_adj: str) -> Column:
    """Star label of an adjusted p-value column."""
    return F.expr(signif_stars_text(ident(p_adj)))


def name_pattern(parts: int) -> str:
    return "_".join(["(.*)"] * parts)


def name_part(c: Column, parts: int, index: int) -> Column:
    """The index-th part (from 1) of an underscore name.

    Splitting is greedy: surplus underscores stay in the first part, and a name
    with too few parts comes back whole.
    """
    return F.regexp_replace(c, name_pattern(parts), f"${index}")


def name_parts_text(name: str, parts: int) -> list[str]:
    """The same split for a column name known on the driver."""
    m = re.fullmatch(name_pattern(parts), name)
    return list(m.groups()) if m else [name] * parts
