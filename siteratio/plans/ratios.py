"""Ion counts to log2 ratios, on the wide matrix.

All samples of an analyte sit in one row, and so do their references. The row's measures become
one array and its ratios an expression over places in that array: the job is a scan, a projection
and a write, with no shuffle of measurements, and samples that no output needs are
never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siteratio.functions.scalars import all_there_text, log2_text, name_parts_text, quotient_text
from siteratio.functions.sqltext import ident, number
from siteratio.operators.names import dup_label, supersede_columns
from siteratio.operators.reshape import drop_cols_like, measures
from siteratio.plans.cohorts import LIVER_INFLOW, SITE_LABELS, TIME_LABELS
from siteratio.schema import ANALYTE, ROW_ID


@dataclass(frozen=True)
class Sample:
    """One raw column and the keys its name spells."""

    column: str
    subject: str
    timepoint: str
    site: str
    replicate: str = "1"


@dataclass(frozen=True)
class Route:
    """How a sample is compared: its site label and its reference mixture."""

    label: str
    weights: Mapping[str, float]


def _cells(
    samples: Sequence[Sample], route: Callable[[Sample], Route | None]
) -> dict[tuple[str, str, str], tuple[Route, list[Sample]]]:
    """(label, timepoint, subject) -> route and the samples measured there."""
    cells: dict[tuple[str, str, str], tuple[Route, list[Sample]]] = {}
    for s in samples:
        r = route(s)
        if r is not None:
            cells.setdefault((r.label, s.timepoint, s.subject), (r, []))[1].append(s)
    return cells


def _unique_lookup(samples: Sequence[Sample]) -> dict[tuple[str, str, str, str], str]:
    found: dict[tuple[str, str, str, str], str] = {}
    for s in samples:
        key = (s.subject, s.timepoint, s.site, s.replicate)
        if key in found:
            raise ValueError(f"samples {found[key]} and {s.column} name the same measurement")
        found[key] = s.column
    return found


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for a value that is computed once.

    A column of a select below could be put in its place, inside a loop, and be computed for every element.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


class _Wide:
    """The output columns of a job, as places in one array of measures.

    A reference is a list of (place, weight), a cell a list of measured places and a list of references. They enter the
    plan as constant arrays, so a row's ratios are one expression however many samples there are.
    """

    def __init__(self, values: Mapping[str, str], columns: Mapping[tuple[str, str, str, str], str]) -> None:
        self.values, self.columns = values, columns
        self.places: dict[str, int] = {}
        self.refs: dict[tuple[tuple[int, float], ...], int] = {}
        self.cells: dict[str, tuple[list[int], list[int]]] = {}

    def _place(self, column: str) -> int:
        return self.places.setdefault(column, len(self.places))

    def reference(self, sample: Sample, weights: Mapping[str, float], replicate: str, on_missing_ref: str) -> int:
        """Number of the weighted sum of the reference columns of a sample's subject and timepoint; -1 without them."""
        terms = []
        for site, weight in weights.items():
            name = self.columns.get((sample.subject, sample.timepoint, site, replicate))
            if name is None:
                if on_missing_ref == "error":
                    raise ValueError(f"{sample.column} has no reference {site} {replicate}")
                return -1
            terms.append((self._place(name), float(weight)))
        return self.refs.setdefault(tuple(terms), len(self.refs))

    def put(self, name: str, measured: Sequence[Sample], refs: Sequence[int]) -> None:
        if name in self.cells:
            raise ValueError(f"more than one value for {name}")
        self.cells[name] = [self._place(s.column) for s in measured], list(refs)

    def log2(self, counts: DataFrame, analyte_col: str, nonfinite: str) -> DataFrame:
        """The analyte and, in name order, log2 of the median over all pairs of a cell's samples and references."""
        analyte = f"{ident(analyte_col)} AS {ANALYTE}"
        if not self.cells:
            return counts.selectExpr(analyte)
        names = sorted(self.cells)
        numbers = lambda xs: f"array({', '.join(map(str, xs))})"
        mixture = lambda terms: numbers(f"struct({i} AS i, {number(w)} AS w)" for i, w in terms)
        refs = f"transform({numbers(map(mixture, self.refs))}, r -> aggregate(r, 0D, (t, x) -> t + v[x.i] * x.w))"
        cells = numbers(f"struct({numbers(m)} AS m, {numbers(r)} AS r)" for m, r in (self.cells[n] for n in names))
        pair = quotient_text("v[i]", "if(k < 0, NULL, f[k])", nonfinite)
        pairs = f"transform({cells}, c -> sort_array(flatten(transform(c.m, i -> transform(c.r, k -> {pair})))))"
        there = all_there_text("p[0]", "p[size(p) - 1]", nonfinite)
        if nonfinite == "ieee":
            there = f"({there} OR isnan(p[0]) AND size(p) = 1)"  # a single ratio may be undefined, a median not
        low, high = "p[(size(p) - 1) div 2]", "p[size(p) div 2]"
        middle = f"CASE WHEN {there} THEN if(size(p) % 2 = 1, {low}, ({low} + {high}) / 2) END"
        row = f"array({', '.join(self.values[c] for c in self.places)})"
        medians = _let("v", row, _let("f", refs if self.refs else "array(cast(NULL AS double))", f"transform({pairs}, p -> {middle})"))
        return counts.selectExpr(analyte, f"transform({medians}, x -> {log2_text('x', nonfinite)}) AS l").selectExpr(
            ANALYTE, *[f"l[{i}] AS {ident(n)}" for i, n in enumerate(names)]
        )


def _require_unique(df: DataFrame, analyte_col: str) -> None:
    again = df.groupBy(analyte_col).count().filter("count > 1").limit(5).collect()
    if again:
        names = ", ".join(str(r[0]) for r in again)
        raise ValueError(f"{analyte_col} repeats ({names}): a row per analyte is needed")


def single_route(s: Sample) -> Route | None:
    """Lung against the right ventricle, liver against its inflow, the rest against FA."""
    if s.site == "LV":
        return Route("Lung", {"RV": 1.0})
    if s.site == "H":
        return Route("Liver", LIVER_INFLOW)
    if s.site == "RV" or "FA" in s.site or "qc" in s.subject:
        return None
    return Route(s.site, {"FA": 1.0})


def job_ratio_single(
    wide: DataFrame,
    analyte_col: str = ANALYTE,
    min_samples: int = 3,
    on_missing_ref: str = "null",
    nonfinite: str = "null",
) -> dict[str, DataFrame]:
    """One value per sample: cleaned counts and the log2 ratio matrix.

    A site and time with fewer than ``min_samples`` samples is left out. Every analyte
    has a (possibly empty) cell for every sample, so this is a property of the columns.
    """
    counts = dup_label(wide, analyte_col, ROW_ID)
    _require_unique(counts, analyte_col)
    values = measures(counts, [ROW_ID, analyte_col])
    samples = [
        Sample(column, *name_parts_text(name, 3))
        for column, name in supersede_columns(list(values)).items()
    ]
    columns = _unique_lookup(samples)
    cells = _cells(samples, single_route)
    size = Counter((label, timepoint) for label, timepoint, _ in cells)
    out = _Wide(values, columns)
    for (label, timepoint, subject), (route, measured) in cells.items():
        if size[(label, timepoint)] < min_samples:
            continue
        (sample,) = measured
        time_label = reduce(lambda t, ab: t.replace(*ab), TIME_LABELS.items(), timepoint)
        name = "_".join([SITE_LABELS.get(label, label), time_label, subject.replace("FP", "Ct")])
        out.put(name, measured, [out.reference(sample, route.weights, "1", on_missing_ref)])
    return {"ion_counts": counts, "log2va": out.log2(counts, analyte_col, nonfinite)}


def replicate_route(s: Sample) -> Route | None:
    """As above, but subject 1 has its lung outflow sampled at A instead of LV."""
    if s.site == ("A" if s.subject == "1" else "LV"):
        return Route("lung", {"RV": 1.0})
    if s.site == "H":
        return Route("liver", LIVER_INFLOW)
    if "LV" in s.site or "RV" in s.site or "A" in s.site:
        return None
    return Route(s.site, {"FA": 1.0})


def job_ratio_replicate(
    wide: DataFrame,
    analyte_col: str = ANALYTE,
    replicates: Sequence[str] = ("1", "2", "3"),
    secondary: Sequence[str] = ("1.2", "2.2", "3.2"),
    on_missing_ref: str = "null",
    nonfinite: str = "null",
) -> dict[str, DataFrame]:
    """Replicated samples: log2 of the median over all pairs of sample and reference replicate.

    Numeric columns are samples. A source of text columns only (CSV without a schema) is
    parsed instead.
    """
    counts = drop_cols_like(wide, "_U_")
    _require_unique(counts, analyte_col)
    numeric = {f.name for f in counts.schema if isinstance(f.dataType, T.NumericType)}
    values = measures(counts, [analyte_col])
    samples = []
    for column in values:
        if numeric and column not in numeric:
            continue
        subject, timepoint, site, replicate = name_parts_text(column, 4)
        subject = subject.replace("HF", "")
        if replicate not in secondary and "qc" not in subject:
            samples.append(Sample(column, subject, timepoint, site, replicate))
    columns = _unique_lookup(samples)
    out = _Wide(values, columns)
    for (label, timepoint, subject), (route, measured) in _cells(samples, replicate_route).items():
        refs = [out.reference(measured[0], route.weights, k, on_missing_ref) for k in replicates]
        out.put(f"{label}_{timepoint}_{subject}".lower(), measured, refs)
    return {"ion_counts": counts, "log2va": out.log2(counts, analyte_col, nonfinite)}
