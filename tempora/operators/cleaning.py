"""Outlier removal, gap fill, centred smoothing and the report.

Order is fixed (outliers → fill → smooth) and every numeric column is
treated independently.  Bounds are partial aggregates per series, joined back
(one row per series, so the join is a broadcast where that is small and a
splittable shuffle join otherwise).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.repair import _keys, _numeric_cols


def _bounds(df: DataFrame, keys: list[str], columns: Sequence[str], method: str, k: float, approx: bool,
            select: bool = False) -> DataFrame:
    """One row per series: ``__lo_<i>`` and ``__hi_<i>`` per column."""
    if method not in ("iqr", "std"):
        raise ValueError("outlier method must be 'iqr' or 'std'")
    aggs = []
    for i, c in enumerate(columns):
        if method == "iqr":
            q = (F.percentile_approx(c, [0.25, 0.75], 10000) if approx
                 else F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))))
            aggs.append(q.alias(f"__q_{i}"))
        else:
            aggs.append(F.array(F.avg(c), F.stddev_samp(c)).alias(f"__q_{i}"))
    out = []
    for i, _ in enumerate(columns):
        q = F.col(f"__q_{i}")
        if method == "iqr":
            out += [(q[0] - F.lit(k) * (q[1] - q[0])).alias(f"__lo_{i}"), (q[1] + F.lit(k) * (q[1] - q[0])).alias(f"__hi_{i}")]
        else:
            out += [(q[0] - F.lit(k) * q[1]).alias(f"__lo_{i}"), (q[0] + F.lit(k) * q[1]).alias(f"__hi_{i}")]
    if method == "iqr" and select:
        from tempora.operators import large
        found = large.quantiles(df, keys, columns, [0.25, 0.75])
        found = found.select(*keys, *[F.col(f"q_{i}").alias(f"__q_{i}") for i in range(len(columns))])
    else:
        found = df.groupBy(*keys).agg(*aggs)
    return found.select(*keys, *out)


def mark_outliers(df: DataFrame, keys, ts: str = "ts", columns: Sequence[str] | None = None,
                  method: str = "iqr", threshold: float = 1.5, approx: bool = False, select: bool = False) -> DataFrame:
    """Values strictly outside the bounds become NULL; adds one
    boolean ``__out_<col>`` per column for the report.  Bounds are aggregates
    per series, joined back; ``select`` finds the exact quartiles of the IQR
    method without holding a series' values (``large.quantiles``)."""
    keys = _keys(keys)
    columns = list(columns) if columns is not None else _numeric_cols(df, [*keys, ts])
    joined = df.join(_bounds(df, keys, columns, method, threshold, approx, select), keys)
    sel = []
    for c in df.columns:
        if c in columns:
            i = columns.index(c)
            out = (F.col(c) < F.col(f"__lo_{i}")) | (F.col(c) > F.col(f"__hi_{i}"))
            sel += [F.when(out, None).otherwise(F.col(c)).alias(c), F.coalesce(out, F.lit(False)).alias(f"__out_{c}")]
        else:
            sel.append(F.col(c))
    return joined.select(*sel)


def clean(df: DataFrame, keys, ts: str = "ts", columns: Sequence[str] | None = None,
          method: str = "iqr", threshold: float = 1.5, rolling_window: int = 3,
          approx: bool = False, with_flags: bool = False) -> DataFrame:
    """T9–T12 on every numeric column: outliers → NULL, forward then
    backward fill, centred rolling mean (``min_periods=1``; window ≤ 1
    disables smoothing; even windows cover i−w/2 … i+w/2−1)."""
    keys = _keys(keys)
    columns = list(columns) if columns is not None else _numeric_cols(df, [*keys, ts])
    marked = mark_outliers(df, keys, ts, columns, method, threshold, approx)
    w_f = Window.partitionBy(*keys).orderBy(F.col(ts).asc()).rowsBetween(Window.unboundedPreceding, 0)
    w_b = Window.partitionBy(*keys).orderBy(F.col(ts).desc()).rowsBetween(Window.unboundedPreceding, 0)
    filled = marked.select(*[F.coalesce(F.col(c), F.last(c, True).over(w_f), F.last(c, True).over(w_b)).alias(c)
                             if c in columns else F.col(c) for c in marked.columns])
    if rolling_window and rolling_window > 1:
        w_r = Window.partitionBy(*keys).orderBy(ts).rowsBetween(-(rolling_window // 2), (rolling_window - 1) // 2)
        filled = filled.select(*[F.avg(c).over(w_r).alias(c) if c in columns else F.col(c)
                                 for c in filled.columns])
    if not with_flags:
        filled = filled.drop(*[f"__out_{c}" for c in columns])
    return filled


def cleaning_report(df: DataFrame, keys, ts: str = "ts", columns: Sequence[str] | None = None,
                    method: str = "iqr", threshold: float = 1.5, rolling_window: int = 3,
                    approx: bool = False) -> DataFrame:
    """Long table ``(keys…, column, step, n)``.

    outliers_removed is always reported (also 0); missing_filled only when
    there was something to fill (original NULLs + removed outliers);
    smoothed carries the window when smoothing is on.
    """
    keys = _keys(keys)
    columns = list(columns) if columns is not None else _numeric_cols(df, [*keys, ts])
    marked = mark_outliers(df, keys, ts, columns, method, threshold, approx)
    aggs = []
    for c in columns:
        aggs += [F.count_if(F.col(f"__out_{c}")).alias(f"o_{c}"), F.count_if(F.col(c).isNull()).alias(f"m_{c}")]
    per = marked.groupBy(*keys).agg(*aggs)
    rows = []
    for i, c in enumerate(columns):
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(i * 3).alias("ord"), F.lit("outliers_removed").alias("step"),
                             F.col(f"o_{c}").alias("n")))
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(i * 3 + 1).alias("ord"), F.lit("missing_filled").alias("step"),
                             F.col(f"m_{c}").alias("n")))
        if rolling_window and rolling_window > 1:
            rows.append(F.struct(F.lit(c).alias("column"), F.lit(i * 3 + 2).alias("ord"), F.lit("smoothed").alias("step"),
                                 F.lit(rolling_window).cast("long").alias("n")))
    out = per.select(*keys, F.inline(F.array(*rows)))
    return out.filter((F.col("step") != "missing_filled") | (F.col("n") > 0)) \
              .select(*keys, "column", "step", "n")
