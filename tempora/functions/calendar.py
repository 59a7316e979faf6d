"""Calendar arithmetic that mirrors pandas' anchoring rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whole_days(start, end) -> Column:
    """Whole days elapsed (Timedelta.days; floors for positive spans)."""
    return F.timestamp_diff("DAY", _c(start), _c(end))


def month_index(ts) -> Column:
    return F.year(_c(ts)) * 12 + F.month(_c(ts)) - 1


def anchored_quarter_end(ts, first_ts) -> Column:
    """Right label of pandas' resample('3M') anchored on the first month.

    The first bin is the first month on its own, then bins of three months:
    label = last day of (first month + 3·ceil(m/3) months), m = months since
    the first month.
    """
    m = month_index(ts) - month_index(first_ts)
    b = F.ceil(m / F.lit(3)).cast("int")
    first_month = F.make_date(F.year(_c(first_ts)), F.month(_c(first_ts)), F.lit(1))
    return F.last_day(F.add_months(first_month, b * 3))
