"""Profiling aggregates.

Per-column operators unpivot to ``(keys…, feature, ts, v)`` so that a
single aggregation (one shuffle) serves every feature.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.calendar import anchored_quarter_end
from tempora.functions.expressions import epoch_us, floor_ts, safe_corr
from tempora.operators.repair import _keys, _numeric_cols


def _stack(wide: DataFrame, keys: list[str], columns: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """Turn ``<stat>__<i>`` columns of a per-group row into one row per feature."""
    return wide.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{s}__{i}").alias(s) for s in stats])
        for i, c in enumerate(columns)])))


def column_stats(df: DataFrame, keys, ts: str = "ts", columns: Sequence[str] | None = None) -> DataFrame:
    """A1/A3: min, max, mean, sample std and non-null count per feature.
    All features are aggregated in one wide pass (reusing the input's
    partitioning); only the small result is stacked per feature."""
    keys = _keys(keys)
    columns = list(columns) if columns is not None else _numeric_cols(df, [*keys, ts])
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.min(c).alias(f"min__{i}"), F.max(c).alias(f"max__{i}"), F.avg(c).alias(f"mean__{i}"),
                 F.stddev_samp(c).alias(f"std__{i}"), F.count(c).alias(f"n__{i}")]
    return _stack(df.groupBy(*keys).agg(*aggs), keys, columns, ["min", "max", "mean", "std", "n"])


def overview(df: DataFrame, keys, ts: str = "ts", n_features: int | None = None) -> DataFrame:
    """A2: rows, first/last stamp, whole-day span and the step when it is
    constant (NULL = irregular)."""
    keys = _keys(keys)
    w = Window.partitionBy(*keys).orderBy(ts)
    us = epoch_us(ts)
    d = df.select(*keys, ts, (us - F.lag(us).over(w)).alias("delta"))
    nf = n_features if n_features is not None else len(_numeric_cols(df, [*keys, ts]))
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.count_distinct("delta").alias("_nd"), F.min("delta").alias("_d")) \
        .select(*keys, "rows", F.lit(nf).alias("features"), "first_ts", "last_ts",
                F.timestamp_diff("DAY", F.col("first_ts"), F.col("last_ts")).alias("span_days"),
                F.when(F.col("_nd") == 1, (F.col("_d") / F.lit(1_000_000)).cast("long")).alias("step_seconds"))


def correlation_matrix(df: DataFrame, keys, ts: str = "ts", columns: Sequence[str] | None = None) -> DataFrame:
    """A4: pairwise-complete Pearson correlation of every pair, in one
    aggregate; constant columns give NULL."""
    keys = _keys(keys)
    columns = list(columns) if columns is not None else _numeric_cols(df, [*keys, ts])
    aggs, pairs = [], []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            if j < i:
                continue
            aggs.append(safe_corr(a, b).alias(f"c_{i}_{j}"))
    wide = df.groupBy(*keys).agg(*aggs)
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            lo, hi = min(i, j), max(i, j)
            pairs.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"c_{lo}_{hi}").alias("corr")))
    return wide.select(*keys, F.inline(F.array(*pairs)))


def correlation_with(df: DataFrame, keys, target: str, ts: str = "ts",
                     columns: Sequence[str] | None = None) -> DataFrame:
    """A5: correlation of every column with ``target`` (e.g. a prediction),
    with its rank in descending order."""
    keys = _keys(keys)
    columns = list(columns) if columns is not None else [c for c in _numeric_cols(df, [*keys, ts]) if c != target]
    wide = df.groupBy(*keys).agg(*[safe_corr(c, target).alias(f"c_{i}") for i, c in enumerate(columns)])
    lg = wide.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"c_{i}").alias("corr"))
                                               for i, c in enumerate(columns)])))
    return lg.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.col("corr").desc_nulls_last())).cast("int"))


def histogram(df: DataFrame, keys, ts: str = "ts", columns: Sequence[str] | None = None,
              bins: int = 30) -> DataFrame:
    """Equal-width histogram per feature; the maximum falls in the last
    bin.  Bounds are one aggregate per series, joined back; every row is
    binned for all features at once, and the (bin, feature) pairs are counted
    with partial aggregation, so no series is gathered in one task."""
    keys = _keys(keys)
    columns = list(columns) if columns is not None else _numeric_cols(df, [*keys, ts])
    bounds = df.groupBy(*keys).agg(*[e for i, c in enumerate(columns) for e in (
        F.min(c).alias(f"mn__{i}"), ((F.max(c) - F.min(c)) / F.lit(bins)).alias(f"wd__{i}"))])
    staged = df.select(*keys, *[F.col(c).alias(f"v__{i}") for i, c in enumerate(columns)]).join(bounds, keys)
    cells = []
    for i, c in enumerate(columns):
        v, mn, wd = F.col(f"v__{i}"), F.col(f"mn__{i}"), F.col(f"wd__{i}")
        b = F.when(wd == 0, F.lit(0)).otherwise(F.least(F.floor((v - mn) / wd), F.lit(bins - 1))).cast("int")
        cells.append(F.when(v.isNotNull(), F.struct(F.lit(c).alias("feature"), b.alias("bin"),
                                                    mn.alias("_mn"), wd.alias("_w"))))
    lg = staged.select(*keys, F.inline(F.array_compact(F.array(*cells))))
    return lg.groupBy(*keys, "feature", "bin").agg(
        F.count(F.lit(1)).alias("count"),
        (F.first("_mn") + F.col("bin") * F.first("_w")).alias("bin_start"),
        (F.first("_mn") + (F.col("bin") + 1) * F.first("_w")).alias("bin_end"))


def box_summary(df: DataFrame, keys, ts: str = "ts", columns: Sequence[str] | None = None,
                whisker: float = 1.5, approx: bool = False, select: bool = False) -> DataFrame:
    """Quartiles, whiskers (extreme values within 1.5·IQR) and outlier
    count.  Quartiles are one aggregate per series, joined back, the rest one
    wide aggregate.  The exact quartiles keep a series' distinct values in one
    buffer; ``select`` finds the same values by distributed selection
    (``large.quantiles``), ``approx`` uses a sketch of bounded size."""
    keys = _keys(keys)
    columns = list(columns) if columns is not None else _numeric_cols(df, [*keys, ts])
    cut = (lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000)) if approx else (
        lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    if select:
        from tempora.operators import large
        quartiles = large.quantiles(df, keys, columns, [0.25, 0.5, 0.75]).select(
            *keys, *[F.col(f"q_{i}").alias(f"q__{i}") for i in range(len(columns))])
    else:
        quartiles = df.groupBy(*keys).agg(*[cut(c).alias(f"q__{i}") for i, c in enumerate(columns)])
    staged = df.select(*keys, *[F.col(c).alias(f"v__{i}") for i, c in enumerate(columns)]).join(quartiles, keys)
    aggs = []
    for i, _ in enumerate(columns):
        v, q = F.col(f"v__{i}"), F.col(f"q__{i}")
        iqr = q[2] - q[0]
        inside = (v >= q[0] - F.lit(whisker) * iqr) & (v <= q[2] + F.lit(whisker) * iqr)
        aggs += [F.first(q[0]).alias(f"q1__{i}"), F.first(q[1]).alias(f"median__{i}"), F.first(q[2]).alias(f"q3__{i}"),
                 F.min(F.when(inside, v)).alias(f"whisker_low__{i}"), F.max(F.when(inside, v)).alias(f"whisker_high__{i}"),
                 F.count_if(v.isNotNull() & ~inside).alias(f"outliers__{i}")]
    return _stack(staged.groupBy(*keys).agg(*aggs), keys, columns,
                  ["q1", "median", "q3", "whisker_low", "whisker_high", "outliers"])


def _trend_aggs(df: DataFrame, keys: list[str], ts: str, columns: Sequence[str]) -> DataFrame:
    """One wide aggregate of the OLS moments of every column on position."""
    pos = (F.row_number().over(Window.partitionBy(*keys).orderBy(ts)) - 1).cast("double")
    staged = df.select(*keys, *columns, pos.alias("__pos"))
    aggs = []
    for i, c in enumerate(columns):
        x = F.when(F.col(c).isNotNull(), F.col("__pos"))
        aggs += [F.regr_slope(c, "__pos").alias(f"slope__{i}"), F.regr_intercept(c, "__pos").alias(f"intercept__{i}"),
                 F.regr_r2(c, "__pos").alias(f"r2__{i}"), F.var_pop(c).alias(f"vy__{i}"),
                 F.var_pop(x).alias(f"vx__{i}"), F.count(c).alias(f"n__{i}")]
    return _stack(staged.groupBy(*keys).agg(*aggs), keys, columns, ["slope", "intercept", "r2", "vy", "vx", "n"])


def linear_trend(df: DataFrame, keys, ts: str = "ts", columns: Sequence[str] | None = None) -> DataFrame:
    """OLS of each column on its row position 0..n−1 (slope, intercept,
    r², direction).  A constant column has r² 0 and 'No trend'."""
    keys = _keys(keys)
    columns = list(columns) if columns is not None else _numeric_cols(df, [*keys, ts])
    agg = _trend_aggs(df, keys, ts, columns)
    direction = F.when(F.col("slope") > 0, "Increasing").when(F.col("slope") < 0, "Decreasing").otherwise("No trend")
    return agg.select(*keys, "feature", "slope", "intercept",
                      F.when(F.col("vy") == 0, F.lit(0.0)).otherwise(F.col("r2")).alias("r_squared"),
                      direction.alias("trend_direction"), "n")


def linear_trend_pvalues(df: DataFrame, keys, ts: str = "ts", columns: Sequence[str] | None = None) -> DataFrame:
    """A8 p-value: two-sided test of the slope against 0 (Student t with
    n − 2 degrees of freedom), from the same single aggregate; only the
    final per-(series, feature) rows go through a vectorised UDF."""
    from tempora.functions.stats import slope_t_stat, t_pvalue
    keys = _keys(keys)
    columns = list(columns) if columns is not None else _numeric_cols(df, [*keys, ts])
    agg = _trend_aggs(df, keys, ts, columns)
    r2 = F.when(F.col("vy") == 0, F.lit(0.0)).otherwise(F.col("r2"))
    t = slope_t_stat(F.col("slope"), r2, F.col("vy"), F.col("vx"), F.col("n").cast("double"))
    staged = agg.select(*keys, "feature", "slope", r2.alias("r_squared"), "n", t.alias("t_stat"))
    # constant column: t = 0, p = 1; perfect fit: p = 0
    return staged.withColumn("p_value", F.when(F.col("slope") == 0, F.lit(1.0))
                             .when(F.col("r_squared") >= 1.0, F.lit(0.0))
                             .otherwise(t_pvalue(F.col("t_stat"), (F.col("n") - 2).cast("double"))))


def month_profile(df: DataFrame, keys, target: str, ts: str = "ts", min_rows: int = 24) -> DataFrame:
    """Mean of the target per month of year (series with > 24 rows)."""
    keys = _keys(keys)
    sums = df.groupBy(*keys, F.month(ts).alias("month")).agg(F.avg(target).alias("mean"), F.count(F.lit(1)).alias("_m"))
    n = F.sum("_m").over(Window.partitionBy(*keys))             # at most 12 rows a series
    return sums.withColumn("_n", n).filter(F.col("_n") > min_rows).select(*keys, "month", "mean")


def hour_profile(df: DataFrame, keys, target: str, ts: str = "ts") -> DataFrame:
    """A10: mean of the target per hour of day."""
    keys = _keys(keys)
    return df.groupBy(*keys, F.hour(ts).alias("hour")).agg(F.avg(target).alias("mean"))


def daily_mean(df: DataFrame, keys, ts: str = "ts", columns: Sequence[str] | None = None) -> DataFrame:
    """Daily mean down-sample."""
    keys = _keys(keys)
    columns = list(columns) if columns is not None else _numeric_cols(df, [*keys, ts])
    return df.groupBy(*keys, floor_ts(ts, 86400).alias(ts)).agg(*[F.avg(c).alias(c) for c in columns])


def yearly_mean(df: DataFrame, keys, ts: str = "ts", columns: Sequence[str] | None = None) -> DataFrame:
    """Calendar-year mean labelled at Dec 31 of the year."""
    keys = _keys(keys)
    columns = list(columns) if columns is not None else _numeric_cols(df, [*keys, ts])
    return df.groupBy(*keys, F.make_date(F.year(ts), F.lit(12), F.lit(31)).alias("period_end")) \
             .agg(*[F.avg(c).alias(c) for c in columns])


def quarter_mean(df: DataFrame, keys, ts: str = "ts", columns: Sequence[str] | None = None) -> DataFrame:
    """3-month mean anchored on the first month of each series,
    right-labelled (first bin = first month alone)."""
    keys = _keys(keys)
    columns = list(columns) if columns is not None else _numeric_cols(df, [*keys, ts])
    firsts = df.groupBy(*keys).agg(F.min(ts).alias("__first"))
    staged = df.select(*keys, ts, *columns).join(firsts, keys).select(
        *keys, *columns, anchored_quarter_end(F.col(ts), F.col("__first")).alias("period_end"))
    return staged.groupBy(*keys, "period_end").agg(*[F.avg(c).alias(c) for c in columns])
