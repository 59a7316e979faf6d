"""Small declarative specs shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

# Fixed values matching the reference application's defaults.
# Default scenario plan: brine and steam flow decline 3 % a year
# (exponential), ambient temperature rises 1 unit a year (linear),
# heat-exchanger pressure differential stays constant without seasonality.
# Unlisted features: constant with seasonality.
# Intervention defaults: threshold 40, extra flow 400, steam share 10 %.
DEFAULT_GROWTH_RATE = -0.03
DEFAULT_AMBIENT_SLOPE = 1.0
DEFAULT_THRESHOLD = 40.0
DEFAULT_EXTRA_FLOW = 400.0
DEFAULT_STEAM_PCT = 10.0
DEFAULT_YEARS = 20
DAYS_PER_YEAR = 365.25

TREND_TYPES = ("constant", "linear", "exponential", "polynomial")


@dataclass(frozen=True)
class SeriesSpec:
    """Column roles of a keyed time-series frame.

    keys     -- series identity columns (one constant column for one series)
    ts       -- TIMESTAMP_NTZ column
    features -- numeric input columns, in model order
    target   -- numeric column to forecast (may be None)
    """

    keys: Sequence[str]
    ts: str = "ts"
    features: Sequence[str] = ()
    target: str | None = None

    @property
    def key_list(self) -> list[str]:
        return list(self.keys)

    @property
    def value_columns(self) -> list[str]:
        cols = list(self.features)
        if self.target and self.target not in cols:
            cols.append(self.target)
        return cols

    def validate(self, df) -> None:
        missing = [c for c in [*self.keys, self.ts, *self.features] +
                   ([self.target] if self.target else []) if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")


@dataclass(frozen=True)
class TrendRule:
    """Per-feature projection rule (one row of the trend table)."""

    feature: str
    type: str = "constant"
    slope: float = 0.0
    growth_rate: float = 0.0
    coeffs: tuple[float, ...] = ()
    add_seasonality: bool = True
    scenario: str = "base"

    def __post_init__(self):
        t = self.type.lower()
        if t not in TREND_TYPES:
            raise ValueError(f"unknown trend type {self.type!r}")
        if t == "exponential" and self.growth_rate <= -1.0:
            raise ValueError("growth rate must be above -100 %")
        if t == "polynomial" and not self.coeffs:
            raise ValueError("polynomial needs at least one coefficient")


@dataclass(frozen=True)
class InterventionRule:
    """Threshold-triggered capacity addition (one row of the rule table)."""

    scenario: str = "base"
    threshold: float = DEFAULT_THRESHOLD
    flow: float = DEFAULT_EXTRA_FLOW
    steam_pct: float = DEFAULT_STEAM_PCT

    @property
    def delta_steam(self) -> float:
        return self.flow * self.steam_pct / 100.0

    @property
    def delta_brine(self) -> float:
        return self.flow * (1.0 - self.steam_pct / 100.0)


def default_trend_rules(brine: str, steam: str, ambient: str, hx_dp: str | None = None,
                        scenario: str = "base") -> list[TrendRule]:
    rules = [
        TrendRule(brine, "exponential", growth_rate=DEFAULT_GROWTH_RATE, scenario=scenario),
        TrendRule(steam, "exponential", growth_rate=DEFAULT_GROWTH_RATE, scenario=scenario),
        TrendRule(ambient, "linear", slope=DEFAULT_AMBIENT_SLOPE, scenario=scenario),
    ]
    if hx_dp:
        rules.append(TrendRule(hx_dp, "constant", add_seasonality=False, scenario=scenario))
    return rules
