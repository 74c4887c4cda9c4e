"""Column names and behaviour switches shared by the whole package."""

from __future__ import annotations

ANALYTE = "analyte"
SUBJECT = "subject"
TIMEPOINT = "timepoint"
SITE = "site"
REPLICATE = "replicate"
SAMPLE = "sample"
VALUE = "value"
TIME = "time"
RATIO = "ratio"
ROW_ID = "row_id"

#: The group inside which a site is compared with its reference site.
CELL_KEYS = [SUBJECT, TIMEPOINT, ANALYTE]

NONFINITE = ("null", "ieee")
ON_MISSING_REF = ("null", "error")
ON_MULTI_REF = ("error", "mean", "median")
ON_DUPLICATE = ("error", "count")
BH_MODES = ("auto", "window", "scaled")
TERMS = ("numeric", "factor")


def check_choice(name: str, value: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {allowed}, got {value!r}")
    return value
