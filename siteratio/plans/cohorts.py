"""What differs between the two study designs."""

from __future__ import annotations

from dataclasses import dataclass, field

# Site codes and their printed names.
SITE_LABELS = {
    "FA": "Femoral artery",
    "P": "Intestine",
    "C": "Colon",
    "H": "Liver",
    "S": "Spleen",
    "J": "Head (Brain)",
    "FV": "Leg (Muscle)",
    "CS": "Heart",
    "R": "Kidney",
    "E": "Ear (Skin)",
    "A": "Aorta",
    "LV": "Left Ventricle",
    "RV": "Right Ventricle",
}

# Time labels of the raw samples and of the log2 matrix.
TIME_LABELS = {"000m": "0min", "030m": "30min", "060m": "60min", "120m": "120min"}
SINGLE_MINUTES = {"0min": 0.0, "30min": 30.0, "60min": 60.0, "120min": 120.0}
REPLICATE_MINUTES = {"000m": 0.0, "030m": 30.0, "060m": 60.0, "120m": 120.0}

# Inflow of the liver, portal vein and artery.
LIVER_INFLOW = {"P": 0.8, "FA": 0.2}

# Pairs of times compared with the fasted state.
BASELINE_PAIRS = [(0.0, 30.0), (0.0, 60.0), (0.0, 120.0)]

# A site needs more rows than this for tests across time.
MORE_ROWS_THAN = 5

# Fixed value: the site left out of the site x time analysis.
EXCLUDED_SITE = "Aorta"


@dataclass(frozen=True)
class Cohort:
    """Settings of one study design."""

    name: str
    minutes: dict[str, float]
    outputs: list[str] = field(default_factory=list)


_SHARED = [
    "o1_site_fam",
    "o1_time",
    "o2_time_fam",
    "o8_time_fam",
    "o3_anova_time",
    "o4_anova_time_fam",
    "o3_2_anova_site",
    "o3_2_ancova",
    "o4_2_anova_combo",
    "o5_fast_fed",
    "o6_fast_fed_fam",
    "o5_2_pairs",
    "o6_2_pairs_fam",
    "o6_2_fold",
]

SINGLE = Cohort("single", SINGLE_MINUTES, [*_SHARED, "o1_fed", "o1_fed_fam"])
REPLICATED = Cohort("replicate", REPLICATE_MINUTES, [*_SHARED, "o1_site"])

#: The by-time test table is delivered twice, under both names.
REPEATED_OUTPUTS = {"o7_time": "o1_time"}
