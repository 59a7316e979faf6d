"""Scalar building blocks shared by the operators.

All helpers return Column expressions so that Catalyst can fold them into
whole-stage codegen; nothing here evaluates data on the driver.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = datetime(1970, 1, 1)

_UNIT_SECONDS = {
    "s": 1, "sec": 1, "second": 1, "seconds": 1,
    "min": 60, "t": 60, "minute": 60, "minutes": 60,
    "h": 3600, "hour": 3600, "hours": 3600,
    "d": 86400, "day": 86400, "days": 86400,
    "w": 604800, "week": 604800, "weeks": 604800,
}


def freq_seconds(freq) -> int:
    """Fixed-length frequency ('h', '1h', '15min', 'D', 3600) → seconds."""
    if isinstance(freq, (int, float)):
        if freq <= 0:
            raise ValueError("frequency must be positive")
        return int(freq)
    m = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", str(freq))
    if not m or m.group(2).lower() not in _UNIT_SECONDS:
        raise ValueError(f"unsupported frequency {freq!r}; use a fixed-length step")
    n = int(m.group(1) or 1)
    if n <= 0:
        raise ValueError("frequency must be positive")
    return n * _UNIT_SECONDS[m.group(2).lower()]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """pandas treats NaN as missing; Spark aggregates do not.  Map NaN → NULL."""
    return F.nanvl(_c(c), F.lit(None).cast("double"))


def epoch_us(ts) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ (zone-free)."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), _c(ts))


def ts_plus_seconds(ts, seconds) -> Column:
    """ts + seconds (seconds may be a column), staying TIMESTAMP_NTZ."""
    secs = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return _c(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs.cast("decimal(18,6)"))


def floor_ts(ts, step_seconds: int) -> Column:
    """Floor a TIMESTAMP_NTZ to a fixed step anchored at the epoch (hour, day…)."""
    return F.window(_c(ts), f"{int(step_seconds)} seconds").start


def horner(coeffs, t) -> Column:
    """Σ coeffs[i]·t^i, evaluated with Horner's rule on an ARRAY<DOUBLE>."""
    return F.aggregate(F.reverse(_c(coeffs)), F.lit(0.0), lambda acc, c: acc * _c(t) + c)


def safe_corr(a, b) -> Column:
    """Pairwise-complete Pearson correlation that yields NULL (not an ANSI
    error) when either side is constant.  Rows where either value is NULL
    are ignored on both sides."""
    a, b = _c(a), _c(b)
    both = a.isNotNull() & b.isNotNull()
    a2 = F.when(both, a)
    b2 = F.when(both, b)
    return F.try_divide(F.covar_pop(a2, b2), F.stddev_pop(a2) * F.stddev_pop(b2))
