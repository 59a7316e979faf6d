"""tempora: keyed time-series repair, profiling, forecasting and scenario
operators expressed as Spark DataFrame transformations.

Every operator takes a DataFrame plus the names of its series key columns and
returns a DataFrame; nothing is collected to the driver except explicit
validation counts and model fits.
"""

from tempora.spec import SeriesSpec, TrendRule, InterventionRule  # noqa: F401
from tempora.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["SeriesSpec", "TrendRule", "InterventionRule", "get_spark", "checkpoint_dir"]
