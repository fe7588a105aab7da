"""Parameters of every operator, as small frozen dataclasses.

The defaults are fixed values that results depend on.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class WeightType(str, Enum):
    SAMPLE = "sample"
    VALUE = "value"
    UNIT = "unit"
    UPB = "upb"
    COLLEGE = "college"
    NON_WHITE = "non_white"


DEMOGRAPHIC_TYPES = ("value", "unit", "upb", "college", "non_white")


@dataclass(frozen=True)
class ValidationRules:
    """Flagging rules for pairs; the gap counts calendar months."""

    min_months: int = 12
    max_cagr: float = 0.30
    min_ratio: float = 0.75
    max_ratio: float = 10.0


@dataclass(frozen=True)
class ScreenRules:
    """The second, stricter filter; its months are days / 30.44."""

    min_price: float = 10000.0
    min_months: float = 12.0
    max_cagr: float = 0.30
    min_ratio: float = 0.75
    max_ratio: float = 10.0


@dataclass(frozen=True)
class FitOptions:
    period: str = "month"
    min_pairs: int = 0
    ridge: float = 1e-10
    base_value: float = 100.0


# Tuning constants of the M-estimators.
TUNING = {"huber": 1.345, "bisquare": 4.685, "cauchy": 2.385, "welsch": 2.985}


@dataclass(frozen=True)
class RobustOptions:
    method: str = "huber"
    tuning: float | None = None
    max_iterations: int = 50
    tolerance: float = 1e-4
    mad_factor: float = 1.4826
    scale_floor: float = 1e-10
    remove_outliers: bool = False

    def __post_init__(self):
        if self.method != "ols" and self.method not in TUNING:
            raise ValueError(f"unknown robust method: {self.method}")

    @property
    def constant(self) -> float:
        return self.tuning or TUNING.get(self.method, 0.0)


@dataclass(frozen=True)
class OutlierRules:
    cooks: float = 4.0
    leverage: float = 3.0
    residual: float = 3.0
    cagr: float = 0.5
    gap_years: float = 30.0
    epsilon: float = 1e-8


@dataclass(frozen=True)
class QualityRules:
    min_pairs: int = 100
    min_geographic_coverage: float = 0.8
    max_price_cv: float = 2.0
    min_geography_pairs: int = 10
    max_skew: float = 3.0


# Share of each aspect in the overall quality score.
QUALITY_SHARES = {
    "volume": 0.2,
    "validation": 0.3,
    "temporal_coverage": 0.2,
    "geographic_coverage": 0.2,
    "price_quality": 0.1,
}


@dataclass(frozen=True)
class WeightRules:
    tolerance: float = 1e-6
    dominance: float = 0.5
    change: float = 0.5


@dataclass(frozen=True)
class SupertractOptions:
    min_half_pairs: int = 40
    touch_distance: float = 0.001
    require_prior_year: bool = False
    strategy: str = "adjacent"  # or "nearest_centroid"
