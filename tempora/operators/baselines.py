"""Naive next-day baselines as a rolling back-test over every day of
every series, and their comparison with the actual values.

For each series and calendar day D the "today" rows are D's rows; the
forecast targets are the rows of D+1 (horizon h = hours since D+1 00:00).
All statistics are window expressions over partitions of the series key,
so the whole back-test runs after a single shuffle on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.expressions import floor_ts

# Baseline method names and the hours in a forecast day.
METHODS = ("last_value", "daily_average", "same_pattern", "trend_last3")
HORIZON = 24


def _keys(keys):
    return [keys] if isinstance(keys, str) else list(keys)


def naive_forecasts(df: DataFrame, keys, target: str, ts: str = "ts", passthrough=()) -> DataFrame:
    """Long table ``(keys…, ts, day, horizon, method, yhat, y)``.

    last_value     y at the last row of the previous day           (B1)
    daily_average  mean of the previous day                         (B2)
    same_pattern   y 24 h earlier, only if the previous day has 24 rows (B3)
    trend_last3    max(0, last + slope·(h+1)), slope of the OLS line
                   through the previous day's last three values,
                   = (y₃ − y₁)/2; fewer than 3 rows → last value  (B4)
    A series without the target yields no rows (B5).
    """
    keys = _keys(keys)
    if target not in df.columns:
        # No target, no baselines — an empty result with the usual schema
        return df.select(*keys, ts, F.lit(None).cast("timestamp_ntz").alias("day"),
                         F.lit(None).cast("int").alias("horizon"), F.lit(None).cast("string").alias("method"),
                         F.lit(None).cast("double").alias("yhat"), F.lit(None).cast("double").alias("y")) \
                 .filter(F.lit(False))
    y = F.col(target)
    day = floor_ts(ts, 86400)
    extra = list(passthrough)
    base = df.select(*keys, ts, y.alias("__y"), day.alias("day"), *extra)
    w_day = Window.partitionBy(*keys, "day")
    w_day_desc = Window.partitionBy(*keys, "day").orderBy(F.col(ts).desc())
    staged = base.select(
        "*",
        F.count(F.lit(1)).over(w_day).alias("__n"),
        F.avg("__y").over(w_day).alias("__mean"),
        F.row_number().over(w_day_desc).alias("__rd"),
    )
    staged = staged.select(
        "*", F.max(F.when(F.col("__rd") == 3, F.col("__y"))).over(w_day).alias("__y3"))
    is_last = F.col("__rd") == 1
    w_prev = Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    w_lag = Window.partitionBy(*keys).orderBy(ts)

    # one struct of all statistics of a day, set exactly on its last row: a
    # missing last value stays missing and never falls back to an older day
    stats = F.when(is_last, F.struct("day", F.col("__y").alias("last"), F.col("__n").alias("n"),
                                     F.col("__mean").alias("mean"), F.col("__y3").alias("y3")))
    carried = staged.select(*keys, ts, "day", "__y", *extra, F.last(stats, True).over(w_prev).alias("__p"),
                            F.lag("__y", HORIZON).over(w_lag).alias("__y24"),
                            F.lag(ts, HORIZON).over(w_lag).alias("__ts24"))
    carried = carried.select(
        *keys, ts, "day", "__y", *extra, "__y24", "__ts24",
        F.col("__p.day").alias("__pday"), F.col("__p.last").alias("__plast"), F.col("__p.n").alias("__pn"),
        F.col("__p.mean").alias("__pmean"), F.col("__p.y3").alias("__py3"),
    ).filter(F.col("__pday") == F.col("day") - F.expr("INTERVAL 1 DAY"))
    h = F.timestamp_diff("HOUR", F.col("day"), F.col(ts)).cast("int")
    slope = (F.col("__plast") - F.col("__py3")) / F.lit(2.0)
    line = F.col("__plast") + slope * (h + 1).cast("double")
    # greatest() skips NULL, so a missing line must not become 0
    trend = F.when(F.col("__pn") >= 3, F.when(line.isNotNull(), F.greatest(F.lit(0.0), line))) \
             .otherwise(F.col("__plast"))
    same = F.when((F.col("__pn") == HORIZON) &
                  (F.col("__ts24") == F.col(ts) - F.expr("INTERVAL 24 HOURS")), F.col("__y24"))
    preds = F.array(
        F.struct(F.lit(METHODS[0]).alias("method"), F.col("__plast").alias("yhat")),
        F.struct(F.lit(METHODS[1]).alias("method"), F.col("__pmean").alias("yhat")),
        F.struct(F.lit(METHODS[2]).alias("method"), same.alias("yhat")),
        F.struct(F.lit(METHODS[3]).alias("method"), trend.alias("yhat")),
    )
    out = carried.select(*keys, ts, "day", h.alias("horizon"), F.col("__y").alias("y"), *extra,
                         F.inline(preds))
    return out.filter(F.col("yhat").isNotNull()) \
              .select(*keys, ts, "day", "horizon", "method", "yhat", "y", *extra)


def naive_forecasts_chunked(df: DataFrame, keys, target: str, ts: str = "ts", step="h",
                            chunk="7D") -> DataFrame:
    """``naive_forecasts`` with windows over (series, time chunk) instead of
    whole series, for long series on a regular, gap-free grid.  Chunks
    start at midnight (whole days from the epoch) and carry a halo of the
    previous day, which is all a day's forecasts read, so a dominant series
    is spread over many tasks.  Same rows as the per-series version."""
    from tempora.functions.expressions import freq_seconds
    from tempora.operators.windows import with_halo
    keys = _keys(keys)
    if freq_seconds(chunk) % 86400:
        raise ValueError("chunk must be a whole number of days")
    per_day = 86400 // freq_seconds(step)
    h = with_halo(df.select(*keys, ts, target), keys, ts, chunk, step, per_day, 0)
    res = naive_forecasts(h, [*keys, "__chunk"], target, ts, passthrough=["__home"])
    return res.filter("__home").drop("__home", "__chunk")


def compare_methods(forecasts: DataFrame, keys, method: str = "method",
                    yhat: str = "yhat", y: str = "y") -> DataFrame:
    """B6 + W9: RMSE, MAE and sample count per series and method, with the
    true rank of each method by RMSE within its series."""
    keys = _keys(keys)
    e = F.col(yhat) - F.col(y)
    agg = forecasts.filter(F.col(y).isNotNull()).groupBy(*keys, method).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.count(F.lit(1)).alias("n"))
    return agg.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy("rmse")).cast("int"))
