"""The statistics tables of a cohort from its log2 ratio matrix.

The matrix is read by one aggregate into a moments table (analyte, site, time), which
is frozen. Every test of every output is computed from that table; only the medians
go back to the measurements.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteratio.functions.scalars import flag_direction, flag_fed, number_label, paste
from siteratio.functions.sqltext import idents, over, text
from siteratio.operators import stattests as st
from siteratio.operators.fdr import add_stars, bh_adjust
from siteratio.operators.joins import natural_join, null_safe_join
from siteratio.operators.reshape import grid, to_analysis
from siteratio.operators.selection import group_median
from siteratio.operators.summarise import baseline_delta
from siteratio.plans.cohorts import (
    BASELINE_PAIRS,
    EXCLUDED_SITE,
    MORE_ROWS_THAN,
    REPEATED_OUTPUTS,
    Cohort,
)
from siteratio.runtime import freeze
from siteratio.schema import ANALYTE, SITE, TIME, VALUE

BY_SITE = [ANALYTE, SITE]
BY_TIME = [ANALYTE, SITE, TIME]


def _expected(moments: DataFrame, samples: DataFrame, analytes: DataFrame) -> DataFrame:
    """Moments of every analyte in every site and time, with as many rows as there are samples."""
    sizes = samples.groupBy(SITE, TIME).agg(F.count(F.lit(1)).alias("rows"))
    cells = grid(analytes.select(ANALYTE).distinct(), sizes.select(SITE, TIME, F.col("rows").alias("_samples")))
    joined = null_safe_join(cells, moments, BY_TIME, "left")
    return joined.selectExpr(
        *idents(BY_TIME), "_samples AS rows", "coalesce(n, 0L) AS n", "mean", "coalesce(css, 0D) AS css"
    )


class StatisticsJob:
    """Builds outputs on demand over one shared moments table.

    Instead of the log2 matrix a long ``analysis`` table (analyte, site, time, value) may
    be given, for studies with more samples than a table can have columns. It should hold
    a row for every missing value that is to count; or it may leave them out if ``samples``
    (site, time: one row per sample) says how many values each site and time should have for
    every analyte of ``analytes``. The grid is then made of finished cells, one per
    analyte, site and time, and never of measurements.
    """

    def __init__(
        self,
        log2: DataFrame | None,
        cohort: Cohort,
        analysis: DataFrame | None = None,
        p_digits: int | None = None,
        term: str = "numeric",
        bh_mode: str = "auto",
        samples: DataFrame | None = None,
        analytes: DataFrame | None = None,
    ) -> None:
        self.analysis = to_analysis(log2, cohort.minutes) if analysis is None else analysis
        self.cohort = cohort
        self.p_digits = p_digits
        self.term = term
        self.bh_mode = bh_mode
        self._medians: DataFrame | None = None
        moments = st.cell_moments(self.analysis, BY_TIME)
        if samples is not None:
            moments = _expected(moments, samples, self.analysis if analytes is None else analytes)
        self.moments = freeze(moments)

    # -- shared pieces

    def _adjust(self, tests: DataFrame, family: Sequence[str]) -> DataFrame:
        return add_stars(
            bh_adjust(
                tests,
                family=family,
                mode=self.bh_mode,
                p_digits=self.p_digits,
            )
        )

    def _sites_over_time(self) -> DataFrame:
        """Cells of sites with enough rows; missing values count as rows."""
        counted = self.moments.selectExpr("*", f"sum(rows) {over(BY_SITE)} AS _rows")
        return counted.filter(f"_rows > {MORE_ROWS_THAN}").drop("_rows")

    def _median(self, keys: list[str], strict: bool) -> DataFrame:
        """Of every group that has a row in the moments; strict if values are missing there."""
        cells = self.moments.groupBy(*keys).agg(F.sum("n").alias("_have"), F.sum("rows").alias("_rows"))
        found = group_median(self.analysis, keys, VALUE, "median", strict=False)
        median = "CASE WHEN _have = _rows THEN median END" if strict else "median"
        return null_safe_join(cells, found, keys, "left").selectExpr(*idents(keys), f"{median} AS median")

    def _time_medians(self) -> DataFrame:
        """Computed once: two outputs need them."""
        if self._medians is None:
            self._medians = freeze(self._median(BY_TIME, strict=True))
        return self._medians

    def _site_tests(self, fed_only: bool = False) -> DataFrame:
        cells = self.moments.filter(f"{TIME} != 0") if fed_only else self.moments
        return st.one_sample_from_moments(st.merge_moments(cells, BY_SITE), BY_SITE)

    def _time_tests(self) -> DataFrame:
        return st.one_sample_from_moments(self.moments, BY_TIME)

    def _anova_time(self) -> DataFrame:
        cells = self._sites_over_time()
        if self.term == "factor":
            return st.oneway_from_moments(cells, BY_SITE, TIME)
        xy = st.merge_xy(st.xy_from_cells(cells, BY_SITE, TIME), BY_SITE)
        return st.slope_from_xy(xy, BY_SITE, TIME)

    def _fast_fed(self) -> DataFrame:
        arms = self._sites_over_time().withColumn("_arm", flag_fed(F.col(TIME)))
        merged = st.merge_moments(arms.filter("_arm IS NOT NULL"), [*BY_SITE, "_arm"])
        return st.welch_from_moments(merged, BY_SITE, "_arm", levels=("Fast", "Fed"))

    def _pairs(self, detailed: bool) -> DataFrame:
        cells = self._sites_over_time()
        return st.pairs_from_moments(cells, BY_SITE, TIME, BASELINE_PAIRS, detailed)

    # -- outputs

    def o1_site(self) -> DataFrame:
        return self._adjust(self._site_tests(), [])

    def o1_site_fam(self) -> DataFrame:
        tests = self._adjust(self._site_tests(), [SITE])
        return natural_join(self._median(BY_SITE, strict=False), tests)

    def o1_fed(self) -> DataFrame:
        return self._adjust(self._site_tests(fed_only=True), [])

    def o1_fed_fam(self) -> DataFrame:
        return self._adjust(self._site_tests(fed_only=True), [SITE])

    def o1_time(self) -> DataFrame:
        return self._adjust(self._time_tests(), [])

    def o2_time_fam(self) -> DataFrame:
        told = self._time_medians().withColumn("direction", flag_direction(F.col("median")))
        return natural_join(self.o8_time_fam(), told)

    def o8_time_fam(self) -> DataFrame:
        return self._adjust(self._time_tests(), [SITE])

    def o3_anova_time(self) -> DataFrame:
        return self._adjust(self._anova_time(), [])

    def o4_anova_time_fam(self) -> DataFrame:
        return self._adjust(self._anova_time(), [SITE])

    def o3_2_anova_site(self) -> DataFrame:
        by_site = st.merge_moments(self.moments, BY_SITE)
        return self._adjust(st.oneway_from_moments(by_site, [ANALYTE], SITE), [])

    def o3_2_ancova(self) -> DataFrame:
        if self.term == "factor":
            tests = st.ancova_factors_from_moments(self.moments, [ANALYTE], SITE, TIME)
        else:
            within = st.merge_xy(st.xy_from_cells(self.moments, BY_SITE, TIME), BY_SITE)
            tests = st.ancova_from_xy(within, [ANALYTE], SITE, TIME)
        return self._adjust(tests, [])

    def o4_2_anova_combo(self) -> DataFrame:
        label = paste(F.col(SITE), number_label(F.col(TIME)))
        cells = self.moments.filter(f"{SITE} != {text(EXCLUDED_SITE)}").withColumn("site_time", label)
        return self._adjust(st.oneway_from_moments(cells, [ANALYTE], "site_time"), [])

    def o5_fast_fed(self) -> DataFrame:
        return self._adjust(self._fast_fed(), [])

    def o6_fast_fed_fam(self) -> DataFrame:
        return self._adjust(self._fast_fed(), [SITE])

    def o5_2_pairs(self) -> DataFrame:
        return self._adjust(self._pairs(detailed=False), [])

    def o6_2_pairs_fam(self) -> DataFrame:
        return self._adjust(self._pairs(detailed=True), [SITE])

    def o6_2_fold(self) -> DataFrame:
        # Strict means come from the moments: complete cells have n = rows.
        means = self._sites_over_time().select(
            *BY_TIME, F.when(F.col("n") == F.col("rows"), F.col("mean")).alias("mean")
        )
        summary = natural_join(means, self._time_medians())
        change = baseline_delta(
            summary, BY_SITE, TIME, {"median": "median_change", "mean": "mean_change"}
        ).select(
            *BY_SITE,
            number_label(F.col(TIME)).alias("group2"),
            "median_change",
            "mean_change",
            "median",
            flag_direction(F.col("median")).alias("direction"),
        )
        return natural_join(self.o6_2_pairs_fam(), change)

    def output(self, name: str) -> DataFrame:
        name = REPEATED_OUTPUTS.get(name, name)
        if name not in self.cohort.outputs:
            raise ValueError(f"{name} is not an output of the {self.cohort.name} cohort")
        build: Callable[[], DataFrame] = getattr(self, name)
        return build()


def job_statistics(
    log2: DataFrame | None,
    cohort: Cohort,
    only: Sequence[str] | None = None,
    **options,
) -> dict[str, DataFrame]:
    """All statistics tables of a cohort (or those in ``only``), lazily built."""
    job = StatisticsJob(log2, cohort, **options)
    names = only or [*cohort.outputs, *REPEATED_OUTPUTS]
    tables: dict[str, DataFrame] = {}
    for name in names:  # a table delivered under two names is one table
        same = REPEATED_OUTPUTS.get(name)
        tables[name] = tables[same] if same in tables else job.output(name)
    return tables
