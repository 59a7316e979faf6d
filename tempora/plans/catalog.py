"""Registered queries: each reads the driver tables at ``sf_dir`` and
returns a DataFrame; ``SQL`` holds the DuckDB statement that must return the
same rows (column names aligned)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.operators import baselines, repair
from tempora.plans import sqlparts as S
from tempora.sources.tables import EVENT_TYPES, HOURLY_TARGET, hourly_frame, table_version

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

K = ["series_id"]
EVC = list(EVENT_TYPES)


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def repaired_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX2 → T1 grid → T2 linear fill both directions."""
    return repair.enforce_frequency(hourly_frame(spark, sf_dir), K, "ts", "h")


_H = S.hourly_sql()
_GRID = S.with_ctes({"h": _H}, S.grid_sql("h", EVC))
_LIN = S.with_ctes({"h": _H, "g": S.grid_sql("h", EVC)}, S.interp_sql("SELECT * FROM g", EVC))


@register("hourly_mean_pivot", _H)
def q_hourly(spark, sf_dir):
    """FX2/T7 first half: NaN-safe hourly mean per series, pivoted by type."""
    return hourly_frame(spark, sf_dir)


@register("grid_reindex", _GRID)
def q_grid(spark, sf_dir):
    """Exact-match reindex onto the hourly calendar of each series."""
    return repair.regularize(hourly_frame(spark, sf_dir), K, "ts", "h")


@register("interpolate_linear", _LIN)
def q_linear(spark, sf_dir):
    """T1 + T2: linear (by position) fill, both directions."""
    return repaired_hourly(spark, sf_dir)


_BT_CTES = {
    "h": _H, "g": S.grid_sql("h", EVC), "r": S.interp_sql("SELECT * FROM g", EVC),
    "d": f"SELECT series_id, ts, {HOURLY_TARGET} AS y, date_trunc('day', ts) AS day FROM r",
    "st": """SELECT series_id, day, count(*) AS n, avg(y) AS mean,
  max_by(y, ts) AS last,
  max(CASE WHEN rd = 3 THEN y END) AS y3
FROM (SELECT *, row_number() OVER (PARTITION BY series_id, day ORDER BY ts DESC) AS rd FROM d)
GROUP BY series_id, day""",
    "j": """SELECT d.series_id, d.ts, d.day, CAST(date_diff('hour', d.day, d.ts) AS INTEGER) AS horizon, d.y,
  st.n, st.mean, st.last, st.y3, p.y AS y24
FROM d JOIN st ON st.series_id = d.series_id AND st.day = d.day - INTERVAL 1 DAY
LEFT JOIN d p ON p.series_id = d.series_id AND p.ts = d.ts - INTERVAL 24 HOUR""",
    "f": """SELECT series_id, ts, day, horizon, 'last_value' AS method, last AS yhat, y FROM j
UNION ALL SELECT series_id, ts, day, horizon, 'daily_average', mean, y FROM j
UNION ALL SELECT series_id, ts, day, horizon, 'same_pattern', y24, y FROM j WHERE n = 24
UNION ALL SELECT series_id, ts, day, horizon, 'trend_last3',
  CASE WHEN n >= 3 THEN greatest(0.0, last + (last - y3) / 2.0 * (horizon + 1)) ELSE last END, y FROM j""",
}
_BT_SQL = S.with_ctes(_BT_CTES, "SELECT * FROM f WHERE yhat IS NOT NULL")


@register("naive_backtest", _BT_SQL)
def q_backtest(spark, sf_dir):
    """B1–B4 rolling back-test over every day of every series."""
    return baselines.naive_forecasts(repaired_hourly(spark, sf_dir), K, HOURLY_TARGET)


_BT_RAW = {**_BT_CTES,
           "d": f"SELECT series_id, ts, {HOURLY_TARGET} AS y, date_trunc('day', ts) AS day FROM g",
           "st": _BT_CTES["st"].replace("max_by(y, ts) AS last", "max(CASE WHEN rd = 1 THEN y END) AS last"),
           "f": _BT_CTES["f"].replace("CASE WHEN n >= 3 THEN", "CASE WHEN n >= 3 AND (last IS NULL OR y3 IS NULL) THEN NULL "
                                                               "WHEN n >= 3 THEN")}


@register("naive_backtest_raw_grid", S.with_ctes(_BT_RAW, "SELECT * FROM f WHERE yhat IS NOT NULL"))
def q_backtest_raw(spark, sf_dir):
    """B1–B4 on the un-repaired grid: a missing value of yesterday gives no
    forecast, never an older day's value."""
    return baselines.naive_forecasts(q_grid(spark, sf_dir), K, HOURLY_TARGET)


_CMP_SQL = S.with_ctes(_BT_CTES, """SELECT series_id, method,
  sqrt(avg((yhat - y) * (yhat - y))) AS rmse, avg(abs(yhat - y)) AS mae, count(*) AS n,
  CAST(rank() OVER (PARTITION BY series_id ORDER BY sqrt(avg((yhat - y) * (yhat - y)))) AS INTEGER) AS rank
FROM f WHERE yhat IS NOT NULL AND y IS NOT NULL GROUP BY series_id, method""")


@register("baseline_comparison", _CMP_SQL)
def q_compare(spark, sf_dir):
    """B6 + W9: RMSE / MAE per method and series, with the true rank."""
    return baselines.compare_methods(q_backtest(spark, sf_dir), K)


# ---------------------------------------------------------------------------
# repair variants, cleaning
# ---------------------------------------------------------------------------
from tempora.operators import cleaning, profile  # noqa: E402
from tempora.sources.tables import (  # noqa: E402
    DAILY_FEATURES, DAILY_TARGET, daily_frame, table,
)
from tempora.functions.expressions import floor_ts  # noqa: E402

_G = S.grid_sql("h", EVC)
_HG = {"h": _H, "g": _G}
_HR = {"h": _H, "g": _G, "r": S.interp_sql("SELECT * FROM g", EVC)}
DC = list(DAILY_FEATURES) + [DAILY_TARGET]
_D = S.daily_sql()


def _limit_sql(limit: int) -> str:
    parts, fills = [], []
    for c in EVC:
        parts.append(
            f"last_value({c} IGNORE NULLS) OVER wf AS pv_{c}, "
            f"last_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER wf AS pp_{c}, "
            f"first_value({c} IGNORE NULLS) OVER wb AS nv_{c}, "
            f"first_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER wb AS np_{c}")
        inner = f"pv_{c} + (nv_{c} - pv_{c}) * (pos - pp_{c}) / (np_{c} - pp_{c})"
        fills.append(f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN pos - pp_{c} <= {limit} OR np_{c} - pos <= {limit} "
                     f"THEN coalesce({inner}, pv_{c}, nv_{c}) END AS {c}")
    return (f"SELECT series_id, ts, {', '.join(fills)} FROM (\n"
            f"  SELECT *, {', '.join(parts)} FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS pos FROM g)\n"
            f"  WINDOW wf AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),\n"
            f"         wb AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")


@register("interpolate_limit", S.with_ctes(_HG, _limit_sql(2)))
def q_limit(spark, sf_dir):
    """Linear fill with at most 2 fills from each side of a gap."""
    g = repair.regularize(hourly_frame(spark, sf_dir), K, "ts", "h")
    return repair.interpolate(g, K, "ts", EVC, method="linear", limit=2)


_TIME_SQL = S.with_ctes({"h": _H}, S.interp_sql(
    "SELECT * FROM h", EVC,
    pos="CAST(epoch_us(ts) AS DOUBLE)"))


@register("interpolate_time", _TIME_SQL)
def q_time(spark, sf_dir):
    """Time-weighted interpolation on the observed (irregular) hours,
    then back-fill of leading gaps."""
    return repair.interpolate(hourly_frame(spark, sf_dir), K, "ts", EVC, method="time")


@register("resample_forward", S.with_ctes(_HG, S.interp_sql("SELECT * FROM g", EVC, both=False)))
def q_resample(spark, sf_dir):
    """Hourly mean → full calendar → forward-direction linear fill."""
    ev = table(spark, sf_dir, "events")
    piv = ev.select((F.col("user_id") % 8).alias("series_id"), "ts",
                    *[F.when(F.col("event_type") == t, F.col("value")).alias(t) for t in EVC])
    return repair.resample_interpolate(piv, K, "ts", "h", EVC)


_OD = ("SELECT o_orderstatus AS series_id, date_trunc('day', o_orderdate) AS ts,\n"
       "  sum(o_totalprice) AS total, min(o_orderpriority) AS top_priority\n"
       "FROM orders GROUP BY 1, 2")


def orders_daily(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("series_id"), floor_ts("o_orderdate", 86400).alias("ts")) \
            .agg(F.sum("o_totalprice").alias("total"), F.min("o_orderpriority").alias("top_priority"))


_FFILL_SQL = S.with_ctes({
    "o": _OD,
    "g": S.grid_sql("o", ["total", "top_priority"], "INTERVAL 1 DAY"),
    "r": S.interp_sql("SELECT * FROM g", ["total"], keep=["top_priority"]),
}, """SELECT series_id, ts, total,
  last_value(top_priority IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top_priority FROM r""")


@register("enforce_daily_ffill", _FFILL_SQL)
def q_ffill(spark, sf_dir):
    """T1 + T2 + T4 on a daily orders frame: numbers interpolated, the
    string column forward-filled."""
    return repair.enforce_frequency(orders_daily(spark, sf_dir), K, "ts", "D")


@register("gap_report", S.with_ctes(_HG, f"""SELECT series_id,
  CAST(count_if({' OR '.join(f'{c} IS NULL' for c in EVC)}) AS BIGINT) AS gap_rows, count(*) AS rows
FROM g GROUP BY series_id"""))
def q_gaps(spark, sf_dir):
    """T5: rows with any gap after reindexing, per series."""
    g = repair.regularize(hourly_frame(spark, sf_dir), K, "ts", "h")
    return repair.gap_report(g, K)


@register("sanity_checks", S.with_ctes({"h": _H}, """SELECT series_id, count(*) AS rows,
  TRUE AS is_monotonic, count_if(d = 0) = 0 AS is_unique,
  count(DISTINCT CASE WHEN d > 0 THEN d END) = 1 AND count(*) >= 3 AS is_regular,
  CAST(0 AS BIGINT) AS backward_steps, CAST(count_if(d = 0) AS BIGINT) AS duplicate_stamps,
  CAST(count(DISTINCT CASE WHEN d > 0 THEN d END) AS BIGINT) AS distinct_steps,
  min(CASE WHEN d > 0 THEN d END) AS min_step_us
FROM (SELECT series_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY series_id ORDER BY ts) AS d FROM h)
GROUP BY series_id"""))
def q_sanity(spark, sf_dir):
    """Monotonic / unique / regular step checks per series."""
    return repair.sanity_checks(hourly_frame(spark, sf_dir), K)


_STEPS = "epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY {})"


@register("sanity_checks_events", S.with_ctes({"e": """SELECT user_id, event_id, ts FROM events
  UNION ALL SELECT user_id, event_id + 1000000000, CASE WHEN event_id % 3 = 0 THEN ts ELSE ts - INTERVAL 1 HOUR END
  FROM events WHERE user_id % 3 = 0"""}, f"""SELECT user_id, count(*) AS rows,
  count_if(b < 0) = 0 AS is_monotonic, count_if(d = 0) = 0 AS is_unique,
  count(DISTINCT CASE WHEN d > 0 THEN d END) = 1 AND count(*) >= 3 AS is_regular,
  CAST(count_if(b < 0) AS BIGINT) AS backward_steps, CAST(count_if(d = 0) AS BIGINT) AS duplicate_stamps,
  CAST(count(DISTINCT CASE WHEN d > 0 THEN d END) AS BIGINT) AS distinct_steps,
  min(CASE WHEN d > 0 THEN d END) AS min_step_us
FROM (SELECT user_id, {_STEPS.format("ts")} AS d, {_STEPS.format("event_id")} AS b FROM e) GROUP BY user_id"""))
def q_sanity_events(spark, sf_dir):
    """T8 on raw rows in ingest order, with repeated and backward stamps."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    late = e.filter(F.col("user_id") % 3 == 0).select(
        "user_id", (F.col("event_id") + 1_000_000_000).alias("event_id"),
        F.when(F.col("event_id") % 3 == 0, F.col("ts")).otherwise(F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("ts"))
    return repair.sanity_checks(e.unionByName(late), ["user_id"], order_col="event_id")


def _clean_sql(method: str, k: float, w: int) -> str:
    """Outliers → NULL, ffill/bfill, centred rolling mean, per column."""
    bounds = []
    for c in EVC:
        if method == "iqr":
            bounds.append(f"quantile_cont({c}, 0.25) OVER s AS q1_{c}, quantile_cont({c}, 0.75) OVER s AS q3_{c}")
        else:
            bounds.append(f"avg({c}) OVER s AS m_{c}, stddev_samp({c}) OVER s AS sd_{c}")
    masked = []
    for c in EVC:
        if method == "iqr":
            lo = f"q1_{c} - {k} * (q3_{c} - q1_{c})"
            hi = f"q3_{c} + {k} * (q3_{c} - q1_{c})"
        else:
            lo, hi = f"m_{c} - {k} * sd_{c}", f"m_{c} + {k} * sd_{c}"
        masked.append(f"CASE WHEN {c} < {lo} OR {c} > {hi} THEN NULL ELSE {c} END AS {c}")
    fills = [f"coalesce({c}, last_value({c} IGNORE NULLS) OVER wf, first_value({c} IGNORE NULLS) OVER wb) AS {c}" for c in EVC]
    lo_off, hi_off = w // 2, (w - 1) // 2
    smooth = [f"avg({c}) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {lo_off} PRECEDING AND {hi_off} FOLLOWING) AS {c}"
              for c in EVC]
    return S.with_ctes({**_HG,
                        "b": f"SELECT *, {', '.join(bounds)} FROM g WINDOW s AS (PARTITION BY series_id)",
                        "m": f"SELECT series_id, ts, {', '.join(masked)} FROM b",
                        "f": f"""SELECT series_id, ts, {', '.join(fills)} FROM m
  WINDOW wf AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         wb AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""},
                       f"SELECT series_id, ts, {', '.join(smooth)} FROM f")


@register("clean_iqr", _clean_sql("iqr", 1.5, 3))
def q_clean_iqr(spark, sf_dir):
    """T9 + T11 + T12: IQR outliers → NULL, ffill/bfill, centred mean (3)."""
    g = repair.regularize(hourly_frame(spark, sf_dir), K, "ts", "h")
    return cleaning.clean(g, K, "ts", EVC, method="iqr", threshold=1.5, rolling_window=3)


@register("clean_std_even_window", _clean_sql("std", 2.0, 4))
def q_clean_std(spark, sf_dir):
    """T10 + T11 + T12: mean ± 2·std outliers, fill, even window 4."""
    g = repair.regularize(hourly_frame(spark, sf_dir), K, "ts", "h")
    return cleaning.clean(g, K, "ts", EVC, method="std", threshold=2.0, rolling_window=4)


def _report_sql() -> str:
    q = []
    for c in EVC:
        q.append(f"quantile_cont({c}, 0.25) OVER s AS q1_{c}, quantile_cont({c}, 0.75) OVER s AS q3_{c}")
    per = []
    for c in EVC:
        out = f"({c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) OR {c} > q3_{c} + 1.5 * (q3_{c} - q1_{c}))"
        per.append(f"CAST(count_if(coalesce({out}, FALSE)) AS BIGINT) AS o_{c}, CAST(count_if({c} IS NULL OR coalesce({out}, FALSE)) AS BIGINT) AS m_{c}")
    rows = []
    for c in EVC:
        rows.append(f"SELECT series_id, '{c}' AS \"column\", 'outliers_removed' AS step, o_{c} AS n FROM p")
        rows.append(f"SELECT series_id, '{c}', 'missing_filled', m_{c} FROM p WHERE m_{c} > 0")
        rows.append(f"SELECT series_id, '{c}', 'smoothed', CAST(3 AS BIGINT) FROM p")
    return S.with_ctes({**_HG, "b": f"SELECT *, {', '.join(q)} FROM g WINDOW s AS (PARTITION BY series_id)",
                        "p": f"SELECT series_id, {', '.join(per)} FROM b GROUP BY series_id"},
                       "\nUNION ALL ".join(rows))


@register("cleaning_report", _report_sql())
def q_clean_report(spark, sf_dir):
    """Outliers removed, values filled and smoothing per column."""
    g = repair.regularize(hourly_frame(spark, sf_dir), K, "ts", "h")
    return cleaning.cleaning_report(g, K, "ts", EVC, method="iqr", threshold=1.5, rolling_window=3)


# ---------------------------------------------------------------------------
# profiling (A1–A14), split (M1)
# ---------------------------------------------------------------------------
from tempora.operators import evaluation  # noqa: E402

_SPLIT_SQL = ("CASE WHEN CAST(('0x' || substr(md5(CAST(series_id AS VARCHAR) || '|' || "
              "strftime(ts, '%Y-%m-%d %H:%M:%S')), 1, 8)) AS BIGINT) % 100 < 20 THEN 'test' ELSE 'train' END")


def _long_sql(src: str, cols, extra: str = "") -> str:
    return "\nUNION ALL ".join(f"SELECT series_id{extra}, ts, '{c}' AS feature, {c} AS v FROM {src}" for c in cols)


@register("split_column_stats", S.with_ctes({**_HR,
    "s": f"SELECT *, {_SPLIT_SQL} AS split FROM r",
    "l": _long_sql("s", EVC, ", split")},
    """SELECT series_id, split, feature, min(v) AS min, max(v) AS max, avg(v) AS mean,
  stddev_samp(v) AS std, count(v) AS n FROM l GROUP BY series_id, split, feature"""))
def q_split_stats(spark, sf_dir):
    """M1 + A1/A3: hash split 80/20, then min/max/mean/std per feature and split."""
    r = evaluation.with_split(repaired_hourly(spark, sf_dir), K)
    return profile.column_stats(r, ["series_id", "split"], "ts", EVC)


@register("overview", S.with_ctes({"h": _H}, """SELECT series_id, count(*) AS rows, CAST(5 AS INTEGER) AS features,
  min(ts) AS first_ts, max(ts) AS last_ts, (epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 AS span_days,
  CASE WHEN count(DISTINCT d) = 1 THEN CAST(min(d) / 1000000 AS BIGINT) END AS step_seconds
FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY series_id ORDER BY ts) AS d FROM h)
GROUP BY series_id"""))
def q_overview(spark, sf_dir):
    """A2: rows, features, first/last stamp, span in days, constant step."""
    return profile.overview(hourly_frame(spark, sf_dir), K)


def _corr_sql() -> str:
    sel = []
    for a in EVC:
        for b in EVC:
            sel.append(f"SELECT series_id, '{a}' AS col_a, '{b}' AS col_b, "
                       f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END AS corr FROM r GROUP BY series_id")
    return S.with_ctes(_HR, "\nUNION ALL ".join(sel))


@register("correlation_matrix", _corr_sql())
def q_corr(spark, sf_dir):
    """A4: pairwise-complete Pearson matrix per series, one aggregate."""
    return profile.correlation_matrix(repaired_hourly(spark, sf_dir), K, "ts", EVC)


_FEATS = [c for c in EVC if c != HOURLY_TARGET]


@register("correlation_with_target", S.with_ctes({**_HR, "c": "\nUNION ALL ".join(
    f"SELECT series_id, '{c}' AS feature, corr({c}, {HOURLY_TARGET}) AS corr FROM r GROUP BY series_id" for c in _FEATS)},
    "SELECT *, CAST(rank() OVER (PARTITION BY series_id ORDER BY corr DESC NULLS LAST) AS INTEGER) AS rank FROM c"))
def q_corr_target(spark, sf_dir):
    """A5: correlation of every feature with the target, ranked."""
    return profile.correlation_with(repaired_hourly(spark, sf_dir), K, HOURLY_TARGET, "ts", _FEATS)


@register("histogram", S.with_ctes({**_HR, "l": _long_sql("r", EVC),
    "b": """SELECT series_id, feature, v, min(v) OVER w AS mn, (max(v) OVER w - min(v) OVER w) / 30 AS wd
FROM l WHERE v IS NOT NULL WINDOW w AS (PARTITION BY series_id, feature)"""},
    """SELECT series_id, feature, bin, count(*) AS count, any_value(mn) + bin * any_value(wd) AS bin_start,
  any_value(mn) + (bin + 1) * any_value(wd) AS bin_end
FROM (SELECT *, CAST(CASE WHEN wd = 0 THEN 0 ELSE least(floor((v - mn) / wd), 29) END AS INTEGER) AS bin FROM b)
GROUP BY series_id, feature, bin"""))
def q_hist(spark, sf_dir):
    """30-bin equal-width histogram per feature and series."""
    return profile.histogram(repaired_hourly(spark, sf_dir), K, "ts", EVC, bins=30)


@register("box_summary", S.with_ctes({**_HR, "l": _long_sql("r", EVC),
    "q": """SELECT series_id, feature, v, quantile_cont(v, 0.25) OVER w AS q1, quantile_cont(v, 0.5) OVER w AS med,
  quantile_cont(v, 0.75) OVER w AS q3 FROM l WHERE v IS NOT NULL WINDOW w AS (PARTITION BY series_id, feature)"""},
    """SELECT series_id, feature, any_value(q1) AS q1, any_value(med) AS median, any_value(q3) AS q3,
  min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_low,
  max(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_high,
  CAST(count_if(NOT (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))) AS BIGINT) AS outliers
FROM q GROUP BY series_id, feature"""))
def q_box(spark, sf_dir):
    """Quartiles, whiskers and outlier count per feature."""
    return profile.box_summary(repaired_hourly(spark, sf_dir), K, "ts", EVC)


_DAILY_LONG = S.with_ctes({"d": _D, "p": "SELECT *, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS DOUBLE) AS pos FROM d",
                           "l": "\nUNION ALL ".join(f"SELECT series_id, ts, pos, '{c}' AS feature, {c} AS v FROM p" for c in DC)},
                          """SELECT series_id, feature, regr_slope(v, pos) AS slope, regr_intercept(v, pos) AS intercept,
  CASE WHEN var_pop(v) = 0 THEN 0.0 ELSE regr_r2(v, pos) END AS r_squared,
  CASE WHEN regr_slope(v, pos) > 0 THEN 'Increasing' WHEN regr_slope(v, pos) < 0 THEN 'Decreasing' ELSE 'No trend' END AS trend_direction,
  count(v) AS n FROM l GROUP BY series_id, feature""")


@register("linear_trend", _DAILY_LONG)
def q_trend(spark, sf_dir):
    """OLS slope / intercept / r² of each daily column on position."""
    return profile.linear_trend(daily_frame(spark, sf_dir), K, "ts", DC)


@register("month_profile", S.with_ctes({"d": _D}, f"""SELECT series_id, CAST(month(ts) AS INTEGER) AS month, avg({DAILY_TARGET}) AS mean
FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM d) WHERE n > 24 GROUP BY 1, 2"""))
def q_month(spark, sf_dir):
    """Month-of-year mean of the daily target."""
    return profile.month_profile(daily_frame(spark, sf_dir), K, DAILY_TARGET)


@register("hour_profile", S.with_ctes(_HR, f"""SELECT series_id, CAST(hour(ts) AS INTEGER) AS hour, avg({HOURLY_TARGET}) AS mean
FROM r GROUP BY 1, 2"""))
def q_hour(spark, sf_dir):
    """A10: hour-of-day mean of the hourly target."""
    return profile.hour_profile(repaired_hourly(spark, sf_dir), K, HOURLY_TARGET)


@register("daily_mean", S.with_ctes(_HR, f"""SELECT series_id, date_trunc('day', ts) AS ts, {', '.join(f'avg({c}) AS {c}' for c in EVC)}
FROM r GROUP BY 1, 2"""))
def q_daily(spark, sf_dir):
    """Daily mean down-sample of the repaired hourly series."""
    return profile.daily_mean(repaired_hourly(spark, sf_dir), K, "ts", EVC)


@register("yearly_mean", S.with_ctes({"d": _D}, f"""SELECT series_id, make_date(year(ts), 12, 31) AS period_end,
  {', '.join(f'avg({c}) AS {c}' for c in DC)} FROM d GROUP BY 1, 2"""))
def q_yearly(spark, sf_dir):
    """Calendar-year mean labelled at Dec 31."""
    return profile.yearly_mean(daily_frame(spark, sf_dir), K, "ts", DC)


@register("quarter_mean", S.with_ctes({"d": _D, "b": """SELECT *, last_day(CAST(date_trunc('month', f) AS DATE)
    + to_months(CAST(3 * ceil(((year(ts) * 12 + month(ts)) - (year(f) * 12 + month(f))) / 3) AS INTEGER))) AS period_end
  FROM (SELECT *, min(ts) OVER (PARTITION BY series_id) AS f FROM d)"""},
    f"SELECT series_id, period_end, {', '.join(f'avg({c}) AS {c}' for c in DC)} FROM b GROUP BY 1, 2"))
def q_quarter(spark, sf_dir):
    """3-month means anchored on each series' first month."""
    return profile.quarter_mean(daily_frame(spark, sf_dir), K, "ts", DC)


# ---------------------------------------------------------------------------
# windows (W1–W8), metrics (M2, M5, M11, M12), quality
# ---------------------------------------------------------------------------
from tempora.operators import quality, windows  # noqa: E402

WIN = 24
NEXTDAY_DROP = ("view",)   # configured column dropped from next-day inputs (P3)
ND_FEATS = [c for c in EVC if c != HOURLY_TARGET and c not in NEXTDAY_DROP]


def _samples_full_sql() -> str:
    cols = ["lag(ts, 24) OVER w AS sample_ts", "ts AS anchor_ts"]
    for h in range(WIN):
        for f in ND_FEATS:
            cols.append(f"lag({f}, {WIN - h}) OVER w AS {f}_hour_{h}")
    for f in ND_FEATS:
        cols += [f"avg({f}) OVER fr AS {f}_daily_mean", f"min({f}) OVER fr AS {f}_daily_min",
                 f"max({f}) OVER fr AS {f}_daily_max", f"lag({f}, 1) OVER w AS {f}_daily_last",
                 f"stddev_samp({f}) OVER fr AS {f}_daily_std"]
    for h in range(24):
        cols.append(f"lead({HOURLY_TARGET}, {h}) OVER w AS y_{h}")
    sm = f"""SELECT series_id, {', '.join(cols)},
  lag(ts, {WIN}) OVER w IS NOT NULL AND lead(ts, 24) OVER w IS NOT NULL AS valid
FROM r WINDOW w AS (PARTITION BY series_id ORDER BY ts),
  fr AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {WIN} PRECEDING AND 1 PRECEDING)"""
    return S.with_ctes({**_HR, "sm": sm}, "SELECT * EXCLUDE (valid) FROM sm WHERE valid")


@register("nextday_samples", _samples_full_sql())
def q_samples(spark, sf_dir):
    """W1–W4 + P1/P3: 24 h flattened inputs, window aggregates, 24 targets; all
    columns but the configured one (P3) and the target are inputs."""
    return windows.nextday_samples(repaired_hourly(spark, sf_dir), K, HOURLY_TARGET, None, "ts", WIN, exclude=NEXTDAY_DROP)


def _latest_sql() -> str:
    aggs = ["min(ts) AS sample_ts", "max(ts) AS last_ts"]
    for h in range(WIN):
        for f in ND_FEATS:
            aggs.append(f"max(CASE WHEN rd = {WIN - h} THEN {f} END) AS {f}_hour_{h}")
    for f in ND_FEATS:
        aggs += [f"avg({f}) AS {f}_daily_mean", f"min({f}) AS {f}_daily_min", f"max({f}) AS {f}_daily_max",
                 f"max(CASE WHEN rd = 1 THEN {f} END) AS {f}_daily_last", f"stddev_samp({f}) AS {f}_daily_std"]
    return S.with_ctes({**_HR, "l": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rd FROM r) WHERE rd <= {WIN}"},
                       f"SELECT series_id, {', '.join(aggs)} FROM l GROUP BY series_id")


@register("latest_window_inputs", _latest_sql())
def q_latest(spark, sf_dir):
    """Next-day model input from the last 24 rows of every series."""
    return windows.latest_window(repaired_hourly(spark, sf_dir), K, ND_FEATS, "ts", WIN)


@register("head_per_series", S.with_ctes(_HR, f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) AS INTEGER) AS row FROM r)
WHERE row <= 5"""))
def q_head(spark, sf_dir):
    """Preview, the first 5 rows of every series in time order."""
    return windows.head_per_key(repaired_hourly(spark, sf_dir), K, [F.col("ts")], 5)


def _on_backtest(final: str) -> str:
    return S.with_ctes({**_BT_CTES, "fc": "SELECT *, yhat - y AS error FROM f WHERE yhat IS NOT NULL"}, final)


@register("forecast_errors", _on_backtest("SELECT * FROM fc"))
def q_errors(spark, sf_dir):
    """Error column = prediction − actual on the back-test."""
    return q_backtest(spark, sf_dir).withColumn("error", F.col("yhat") - F.col("y"))


_METRIC_SQL = """SELECT {keys}, avg(error * error) AS mse, sqrt(avg(error * error)) AS rmse,
  1 - sum(error * error) / (count(y) * var_pop(y)) AS r2, count(*) AS n FROM fc GROUP BY {keys}"""


@register("horizon_metrics", _on_backtest(_METRIC_SQL.format(keys="method, horizon")))
def q_hmetrics(spark, sf_dir):
    """MSE / RMSE / r² per method and horizon hour."""
    return evaluation.regression_metrics(q_backtest(spark, sf_dir), ["method", "horizon"])


@register("overall_metrics", _on_backtest(_METRIC_SQL.format(keys="method")))
def q_ometrics(spark, sf_dir):
    """Overall metrics flattened over samples × horizons."""
    return evaluation.regression_metrics(q_backtest(spark, sf_dir), ["method"])


@register("sample_rmse", _on_backtest("SELECT series_id, day, method, sqrt(avg(error * error)) AS rmse, count(*) AS n FROM fc GROUP BY 1, 2, 3"))
def q_srmse(spark, sf_dir):
    """RMSE over the forecast day of every sample."""
    return evaluation.sample_rmse(q_backtest(spark, sf_dir), ["series_id", "day", "method"])


@register("median_examples", _on_backtest("""SELECT series_id, day, method, rmse, n, CAST(rn - 1 AS INTEGER) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id, method ORDER BY rmse, day) AS rn,
    greatest(0, CAST(floor(count(*) OVER (PARTITION BY series_id, method) / 2) AS BIGINT) - 2) AS st
  FROM (SELECT series_id, day, method, sqrt(avg(error * error)) AS rmse, count(*) AS n FROM fc GROUP BY 1, 2, 3))
WHERE rn > st AND rn <= st + 5"""))
def q_median(spark, sf_dir):
    """Five samples around the median RMSE per series and method."""
    return windows.median_centred(q_srmse(spark, sf_dir), ["series_id", "method"], "rmse", "day", 5)


@register("standardize", S.with_ctes({**_HR, "s": f"SELECT *, {_SPLIT_SQL} AS split FROM r",
    "st": "SELECT " + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}"
                                for c in EVC) + " FROM s WHERE split = 'train'"},
    "SELECT series_id, ts, " + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in EVC) + ", split FROM s CROSS JOIN st"))
def q_standardize(spark, sf_dir):
    """M2: fit mean / population std on the train split, scale every row."""
    from tempora.session import materialize
    r = materialize(evaluation.with_split(repaired_hourly(spark, sf_dir), K), "split")
    st = evaluation.scaler_stats(r.filter(F.col("split") == "train"), EVC)
    return evaluation.standardize(r, st, EVC)


_PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("one_hot_priority", "SELECT o_orderkey, o_totalprice, " + ", ".join(
    f"coalesce(CAST(o_orderpriority = '{p}' AS INTEGER), 0) AS \"o_orderpriority_{p}\"" for p in _PRIOS[1:])
    + " FROM orders")
def q_onehot(spark, sf_dir):
    """P5: one-hot encoding with the first sorted category dropped."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return quality.one_hot_drop_first(o, "o_orderpriority", _PRIOS)


@register("one_hot_priority_long", """SELECT o_orderkey, o_orderpriority AS category FROM orders
WHERE o_orderpriority <> (SELECT min(o_orderpriority) FROM orders)""")
def q_onehot_long(spark, sf_dir):
    """P5 for an open set of categories: the ones of the encoding as rows."""
    return quality.one_hot_long(table(spark, sf_dir, "orders"), ["o_orderkey"], "o_orderpriority")


RANGE_FEATS = ["price", "cust"]
_FX4_SQL = """SELECT o_orderkey, o_orderdate,
  CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice * 1.5 ELSE o_totalprice END AS price,
  CAST(o_custkey AS DOUBLE) AS cust FROM orders"""


def fx4(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_orderdate",
                    F.when(F.col("o_orderkey") % 50 == 0, F.col("o_totalprice") * 1.5)
                     .otherwise(F.col("o_totalprice")).alias("price"),
                    F.col("o_custkey").cast("double").alias("cust"))


def _flags(spark, sf_dir):
    x = fx4(spark, sf_dir)
    train = x.filter(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    check = x.filter(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz"))
    st = quality.training_ranges(train, RANGE_FEATS)
    return quality.range_flags(check, st, RANGE_FEATS), st


_RANGE_CTES = {"x": _FX4_SQL,
               "st": "SELECT min(price) AS pmin, max(price) AS pmax, min(cust) AS cmin, max(cust) AS cmax FROM x WHERE o_orderdate < TIMESTAMP '1999-01-01'",
               "fl": """SELECT x.*, coalesce(price < pmin OR price > pmax, FALSE) AS red_price,
  coalesce(cust < cmin OR cust > cmax, FALSE) AS red_cust, pmin, pmax, cmin, cmax
FROM x CROSS JOIN st WHERE o_orderdate >= TIMESTAMP '1999-01-01'"""}


@register("range_flags", S.with_ctes(_RANGE_CTES, """SELECT o_orderkey, o_orderdate, price, cust, red_price, red_cust,
  red_price OR red_cust AS has_red_warning, FALSE AS has_yellow_warning,
  concat_ws(',', CASE WHEN red_price THEN 'price' END, CASE WHEN red_cust THEN 'cust' END) AS red_warning_features,
  '' AS yellow_warning_features FROM fl"""))
def q_flags(spark, sf_dir):
    """P7/P8 + J3: out-of-training-range flags per row and feature (the name
    lists joined for the comparison)."""
    return _flags(spark, sf_dir)[0].withColumns(
        {c: F.array_join(c, ",") for c in ("red_warning_features", "yellow_warning_features")})


@register("range_summary", S.with_ctes(_RANGE_CTES, """SELECT 'price' AS feature, CAST(count_if(red_price) AS BIGINT) AS flagged_rows, count(*) AS rows,
  any_value(pmin) AS train_min, any_value(pmax) AS train_max FROM fl
UNION ALL SELECT 'cust', CAST(count_if(red_cust) AS BIGINT), count(*), any_value(cmin), any_value(cmax) FROM fl"""))
def q_rsummary(spark, sf_dir):
    """Flagged-row counts and training ranges per feature."""
    fl, st = _flags(spark, sf_dir)
    return quality.range_summary(fl, st, RANGE_FEATS)


@register("calendar_parts", S.with_ctes(_HR, f"""SELECT series_id, ts, CAST(month(ts) AS INTEGER) AS month, CAST(hour(ts) AS INTEGER) AS hour,
  (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY series_id))) // 86400000000 AS days_elapsed,
  CAST(ts AS DATE) AS day, CAST(CAST(ts AS DATE) + INTERVAL 1 DAY AS DATE) AS next_day FROM r"""))
def q_calendar(spark, sf_dir):
    """Month, hour, whole days elapsed, day and next-day labels."""
    r = repaired_hourly(spark, sf_dir)
    first = F.min("ts").over(Window.partitionBy("series_id"))
    return r.select("series_id", "ts", F.month("ts").alias("month"), F.hour("ts").alias("hour"),
                    F.timestamp_diff("DAY", first, F.col("ts")).alias("days_elapsed"),
                    F.to_date("ts").alias("day"), F.date_add(F.to_date("ts"), 1).alias("next_day"))


@register("time_range_filter", """SELECT user_id % 8 AS series_id, date_trunc('hour', ts) AS ts, count(*) AS events, avg(value) AS value
FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2""")
def q_range(spark, sf_dir):
    """Half-open time range filter (pushed into the Parquet scan)."""
    ev = table(spark, sf_dir, "events")
    lo, hi = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return ev.filter((F.col("ts") >= lo) & (F.col("ts") < hi)) \
             .groupBy((F.col("user_id") % 8).alias("series_id"), floor_ts("ts", 3600).alias("ts")) \
             .agg(F.count(F.lit(1)).alias("events"), F.avg("value").alias("value"))


# ---------------------------------------------------------------------------
# scenario projection
# ---------------------------------------------------------------------------
from tempora.operators import scenario  # noqa: E402
from tempora.spec import TrendRule, default_trend_rules  # noqa: E402

SCEN_YEARS = 20
DF = list(DAILY_FEATURES)
SCEN_RULES = default_trend_rules("qty", "disc", "tax", scenario="base") + [
    TrendRule("qty", "polynomial", coeffs=(0.5, -0.2, 0.01), scenario="alt"),
    TrendRule("disc", "linear", slope=-0.5, add_seasonality=False, scenario="alt"),
]
P_DAILY = 365


def repaired_daily(spark, sf_dir):
    """FX3 → T1 daily grid → T2 linear fill."""
    return repair.enforce_frequency(daily_frame(spark, sf_dir), K, "ts", "D")


_DR = {"d": _D, "dg": S.grid_sql("d", DC, "INTERVAL 1 DAY"), "rd": S.interp_sql("SELECT * FROM dg", DC)}


def _season_sql(cols) -> dict:
    h = P_DAILY // 2
    det = ", ".join(
        f"CASE WHEN pos >= {h} AND pos < n - {h} THEN {c} - avg({c}) OVER (PARTITION BY series_id ORDER BY ts "
        f"ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) END AS d_{c}" for c in cols)
    return {
        "p": "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos, "
             "count(*) OVER (PARTITION BY series_id) AS n FROM rd",
        "dt": f"SELECT series_id, n, pos % {P_DAILY} AS phase, {det} FROM p WHERE n > {2 * P_DAILY}",
        "pm": f"SELECT series_id, phase, any_value(n) AS n, {', '.join(f'avg(d_{c}) AS m_{c}' for c in cols)} FROM dt GROUP BY 1, 2",
        "se": f"SELECT series_id, phase, n, {', '.join(f'm_{c} - avg(m_{c}) OVER (PARTITION BY series_id) AS {c}' for c in cols)} FROM pm",
    }


@register("seasonal_profile", S.with_ctes({**_DR, **_season_sql(DF)}, "SELECT * FROM se"))
def q_season(spark, sf_dir):
    """Additive seasonal component (period 365) per series and phase."""
    return scenario.seasonal_profile(repaired_daily(spark, sf_dir), K, DF, P_DAILY)


def _rule_sql(r, c):
    last = f"l_{c}"
    if r is None or r.type == "constant":
        e = last
    elif r.type == "linear":
        e = f"{last} + t * {float(r.slope)!r}"
    elif r.type == "exponential":
        e = f"{last} * pow({1.0 + float(r.growth_rate)!r}, t)"
    else:
        e = f"{last} + (" + " + ".join(f"{float(co)!r} * pow(t, {i})" for i, co in enumerate(r.coeffs)) + ")"
    if r is None or r.add_seasonality:
        e = f"{e} + coalesce(s_{c}, 0.0)"
    return e


def _project_ctes(cols, rules, years, scen) -> dict:
    by = {(r.scenario, r.feature): r for r in rules}
    vals = []
    for c in cols:
        vals.append("CASE " + " ".join(f"WHEN scenario = '{s}' THEN {_rule_sql(by.get((s, c)), c)}" for s in scen) + f" END AS {c}")
    ctes = {**_DR, **_season_sql(cols),
            "ks": f"""SELECT series_id, count(*) AS n, max(ts) + INTERVAL 1 DAY AS st,
  {', '.join(f'max_by({c}, ts) AS l_{c}' for c in cols)} FROM rd GROUP BY series_id""",
            "ks2": f"SELECT *, date_diff('day', st, st + INTERVAL {years} YEAR - INTERVAL 1 DAY) + 1 AS periods FROM ks",
            "fk": "SELECT *, unnest(generate_series(0, periods - 1)) AS k FROM ks2",
            "fs": f"""SELECT fk.*, {', '.join(f'se.{c} AS s_{c}' for c in cols)},
  CASE WHEN periods > 1 THEN k * {float(years)!r} / (periods - 1) ELSE 0.0 END AS t
FROM fk LEFT JOIN se ON se.series_id = fk.series_id AND se.phase = (fk.n + fk.k) % {P_DAILY}""",
            "sc": "SELECT * FROM (VALUES " + ", ".join(f"('{s}')" for s in scen) + ") v(scenario)",
            "fut": f"SELECT series_id, scenario, st + k * INTERVAL 1 DAY AS ts, {', '.join(vals)}, TRUE AS is_projected FROM fs CROSS JOIN sc",
            "past": f"SELECT series_id, scenario, ts, {', '.join(cols)}, FALSE AS is_projected FROM rd CROSS JOIN sc"}
    return ctes


SCENARIOS = ["alt", "base"]
_PROJ_CTES = _project_ctes(DF, SCEN_RULES, SCEN_YEARS, SCENARIOS)
_PROJ_SQL = S.with_ctes(_PROJ_CTES, "SELECT * FROM past UNION ALL SELECT * FROM fut")


@register("scenario_projection", _PROJ_SQL)
def q_project(spark, sf_dir):
    """X1–X9 + U1 + P12/P15: history + 20 projected years, two scenarios
    (exponential / linear / polynomial / constant rules, seasonality)."""
    return scenario.project(repaired_daily(spark, sf_dir), K, DF, SCEN_YEARS, SCEN_RULES, "D", scenarios=SCENARIOS)


_SCORE_SQL = S.with_ctes(_PROJ_CTES, f"""SELECT pr.*, cf.a + cf.b * pr.qty AS {DAILY_TARGET}
FROM (SELECT * FROM past UNION ALL SELECT * FROM fut) pr
CROSS JOIN (SELECT regr_intercept({DAILY_TARGET}, qty) AS a, regr_slope({DAILY_TARGET}, qty) AS b FROM rd) cf""")


@register("scenario_scored", _SCORE_SQL)
def q_scored(spark, sf_dir):
    """Score history and projection; the target is the model output."""
    _, sc, proj, _, _ = prepared(spark, sf_dir)
    return sc.transform(proj)


# ---------------------------------------------------------------------------
# interventions
# ---------------------------------------------------------------------------
from tempora.operators import intervention  # noqa: E402
from tempora.spec import InterventionRule  # noqa: E402

# the threshold of a scenario is the mean of its yearly means without
# interventions, so that windows fall on both sides at every scale
INTERVENTIONS = [InterventionRule("alt", flow=1.0, steam_pct=50.0), InterventionRule("base", flow=2.0, steam_pct=10.0)]
BRINE, STEAM = "qty", "disc"
_PREPARED: dict[tuple, tuple] = {}


def _daily_version(spark, sf_dir):
    """Session and content of the tables that the daily frame reads."""
    return spark.sparkContext.applicationId, sf_dir, table_version(spark, sf_dir, "lineitem")


def prepared(spark, sf_dir):
    """(history, scorer, projected rows, yearly means, rules): read and written
    once per session and version of the tables, shared by the scenario queries."""
    from dataclasses import replace

    from tempora.session import materialize
    key = _daily_version(spark, sf_dir)
    if key not in _PREPARED:
        hist = materialize(repaired_daily(spark, sf_dir), "daily")
        sc = scenario.LinearScorer.fit(hist, DAILY_TARGET, "qty")
        proj = materialize(scenario.project(hist, K, DF, SCEN_YEARS, SCEN_RULES, "D", scenarios=SCENARIOS,
                                            materialize_history=False), "projection")
        future = proj.filter("is_projected").drop("is_projected")
        fy = intervention.year_windows(sc.transform(future), [*K, "scenario"], "ts")
        means = materialize(fy.filter(F.col("__year").isNotNull()).groupBy(*K, "scenario", F.col("__year").alias("year")).agg(
            F.first("window_start").alias("window_start"), F.avg(DAILY_TARGET).alias("mean"),
            F.count(F.lit(1)).alias("n")), "year-means")
        level = {r["scenario"]: r["t"] for r in means.groupBy("scenario").agg(F.avg("mean").alias("t")).collect()}
        rules = [replace(r, threshold=float(level.get(r.scenario) or 0.0)) for r in INTERVENTIONS]
        _PREPARED[key] = hist, sc, proj, means, rules
    return _PREPARED[key]


_ROLLED: dict[tuple, tuple] = {}


def _rollout(spark, sf_dir):
    """(adjusted rows, events), rolled out once per session and version of the tables."""
    from tempora.session import materialize
    key = _daily_version(spark, sf_dir)
    if key not in _ROLLED:
        _, sc, proj, _, rules = prepared(spark, sf_dir)
        adjusted, events = intervention.rollout(
            proj.filter("is_projected").drop("is_projected"), K, sc.transform, DAILY_TARGET, BRINE, STEAM,
            SCEN_RULES, rules)
        _ROLLED[key] = materialize(adjusted, "adjusted"), events
    return _ROLLED[key]


def _thr_sql(scen: str = "scenario"):
    return f"(SELECT t FROM thr WHERE thr.scenario = {scen})"


_YEAR_CTES = {
    **_PROJ_CTES,
    "cf": f"SELECT regr_intercept({DAILY_TARGET}, qty) AS a, regr_slope({DAILY_TARGET}, qty) AS b FROM rd",
    "sfu": f"SELECT fut.series_id, fut.scenario, fut.ts, fut.qty, fut.disc, fut.tax, cf.a + cf.b * fut.qty AS {DAILY_TARGET} "
           "FROM fut CROSS JOIN cf",
    "fy": """SELECT *, CASE WHEN ws >= fst THEN year(ts - (fst - date_trunc('day', fst))) END AS yr,
  CASE WHEN ws >= fst THEN ws END AS window_start
  FROM (SELECT *, make_timestamp(year(ts - (fst - date_trunc('day', fst))), 1, 1, 0, 0, 0) + (fst - date_trunc('day', fst)) AS ws
        FROM (SELECT *, min(ts) OVER (PARTITION BY series_id, scenario) AS fst FROM sfu))""",
    "ym": f"""SELECT series_id, scenario, yr, any_value(window_start) AS window_start, avg({DAILY_TARGET}) AS mean, count(*) AS n
  FROM fy WHERE yr IS NOT NULL GROUP BY series_id, scenario, yr""",
    "thr": "SELECT scenario, avg(mean) AS t FROM ym GROUP BY scenario",
}


@register("year_window_means", S.with_ctes(_YEAR_CTES, """SELECT series_id, ym.scenario, CAST(yr AS INTEGER) AS year, window_start,
  mean, n, mean < t AS below_threshold FROM ym JOIN thr ON thr.scenario = ym.scenario"""))
def q_year_windows(spark, sf_dir):
    """X11: yearly windows (Jan 1 at the first row's time of day; leading
    partial year excluded) and the threshold test, before interventions."""
    _, _, _, means, rules = prepared(spark, sf_dir)
    level = {r.scenario: r.threshold for r in rules}
    thr = intervention._by_scenario(list(level), lambda s: F.lit(level[s]))
    return means.withColumn("below_threshold", F.col("mean") < thr)


@register("intervention_events")
def q_events(spark, sf_dir):
    """Iterated rollout — one event per triggering year window."""
    return _rollout(spark, sf_dir)[1]


@register("intervention_adjusted")
def q_adjusted(spark, sf_dir):
    """Adjusted flow features and re-predicted target."""
    return _rollout(spark, sf_dir)[0]


@register("intervention_result")
def q_result(spark, sf_dir):
    """History + future, target without and with interventions."""
    adjusted, _ = _rollout(spark, sf_dir)
    return intervention.result_table(q_scored(spark, sf_dir), adjusted, K, "ts", DF, DAILY_TARGET)


@register("intervention_summary")
def q_isummary(spark, sf_dir):
    """Daily, yearly and 3-month means of the adjusted
    target plus the event count per series and scenario."""
    adjusted, events = _rollout(spark, sf_dir)
    gk = [*K, "scenario"]
    daily = profile.daily_mean(adjusted, gk, "ts", [DAILY_TARGET]).withColumn("period", F.lit("day")) \
        .withColumn("period_end", F.to_date("ts")).drop("ts")
    yearly = profile.yearly_mean(adjusted, gk, "ts", [DAILY_TARGET]).withColumn("period", F.lit("year"))
    quarterly = profile.quarter_mean(adjusted, gk, "ts", [DAILY_TARGET]).withColumn("period", F.lit("quarter"))
    counts = intervention.event_counts(events, K)
    return daily.unionByName(yearly).unionByName(quarterly).join(counts, gk, "left") \
                 .select(*gk, "period", "period_end", F.col(DAILY_TARGET).alias("mean"),
                         F.coalesce("interventions", F.lit(0)).alias("interventions"))


# ---------------------------------------------------------------------------
# models (M3–M10, M13, X10 with trees, S12) — rows-only checks
# ---------------------------------------------------------------------------
from tempora.operators import model as M  # noqa: E402

HOUR_CATEGORY = ["Fri", "Mon", "Sat", "Sun", "Thu", "Tue", "Wed"]
GBT_FEATS = [c for c in EVC if c != HOURLY_TARGET] + [f"weekday_{d}" for d in HOUR_CATEGORY[1:]]


def _split_hourly(spark, sf_dir):
    """T1 grid, T6 time interpolation, P5 one-hot (weekday), split."""
    grid = repair.regularize(hourly_frame(spark, sf_dir), K, "ts", "h")
    filled = repair.interpolate(grid, K, "ts", EVC, method="time").withColumn("weekday", F.date_format("ts", "E"))
    return evaluation.with_split(quality.one_hot_drop_first(filled, "weekday", HOUR_CATEGORY), K)


def _stored_regressor(rows, name, features, target):
    """The regressor of ``rows``, fitted once for these rows and settings."""
    settings = dict(params=M.REGRESSOR_PARAMS, seed=M.REGRESSOR_SEED, features=features, target=target)
    [m] = M.stored(rows, name, settings, lambda: [M.train_regressor(rows, features, target)])
    return m


def _fit_hourly(spark, sf_dir):
    from tempora.session import materialize
    r = materialize(_split_hourly(spark, sf_dir), "hourly-split")
    return r, _stored_regressor(r.filter(F.col("split") == "train"), "hourly", GBT_FEATS, HOURLY_TARGET)


@register("gbt_test_metrics")
def q_gbt_metrics(spark, sf_dir):
    """M3 + M5: GBT on the train split, MSE / RMSE / r² on the test split."""
    r, m = _fit_hourly(spark, sf_dir)
    scored = m.transform(r.filter(F.col("split") == "test"))
    return evaluation.regression_metrics(scored, (), y=HOURLY_TARGET, yhat="prediction")


@register("gbt_actual_vs_predicted")
def q_gbt_pairs(spark, sf_dir):
    """M9 + P13: actual, prediction and residual for every test row."""
    r, m = _fit_hourly(spark, sf_dir)
    scored = m.transform(r.filter(F.col("split") == "test"))
    return scored.select("series_id", "ts", F.col(HOURLY_TARGET).alias("actual"), "prediction",
                         (F.col("prediction") - F.col(HOURLY_TARGET)).alias("residual"))


@register("gbt_cross_validation")
def q_gbt_cv(spark, sf_dir):
    """M4: 5-fold CV on the train split, r² and RMSE mean / std."""
    r = _split_hourly(spark, sf_dir).filter(F.col("split") == "train")
    return M.cross_validate(r, K, GBT_FEATS, HOURLY_TARGET, 5)


@register("gbt_loss_curve")
def q_gbt_curve(spark, sf_dir):
    """M6: train / test RMSE after every boosting round."""
    r, m = _fit_hourly(spark, sf_dir)
    return M.loss_curve(m, r.filter(F.col("split") == "train"), r.filter(F.col("split") == "test"))


@register("gbt_feature_importance")
def q_gbt_importance(spark, sf_dir):
    """M7: feature importances, ranked."""
    return M.feature_importance(_fit_hourly(spark, sf_dir)[1])


@register("gbt_batch_scoring")
def q_gbt_batch(spark, sf_dir):
    """M8: validate columns → range flags vs training → scale → predict →
    clamp at 0, appended to every row (a single row is a batch of one)."""
    r, m = _fit_hourly(spark, sf_dir)
    train = r.filter(F.col("split") == "train")
    rows = quality.validate_columns(r.filter(F.col("split") == "test"), GBT_FEATS, keep=K + ["ts"])
    flagged = quality.range_flags(rows, quality.training_ranges(train, GBT_FEATS), GBT_FEATS)
    return m.transform(flagged, clamp=True)


def _nextday(spark, sf_dir):
    s = windows.nextday_samples(repaired_hourly(spark, sf_dir), K, HOURLY_TARGET, ND_FEATS, "ts", WIN)
    s = evaluation.with_split(s, K, "sample_ts")
    # validation rows for early stopping come from the train side only
    s = s.withColumn("is_validation", (F.col("split") == "train") &
                     (evaluation.hash_bucket(evaluation.split_key(K, "sample_ts"), 1000) % 10 == 0))
    from tempora.session import materialize
    s = materialize(s, "nextday")
    feats = windows.feature_names(ND_FEATS, WIN)
    train = s.filter(F.col("split") == "train")
    settings = dict(params=M.NEXTDAY_PARAMS, seed=M.NEXTDAY_SEED, features=feats, horizon=24)
    path = M.store_path(train, "nextday", settings)
    models = M.NextDayModels.of(M.kept_at(spark, path,
                                          lambda: M.train_nextday(train, feats, 24, store=path).regressors()))
    return s, models


def _nextday_long(spark, sf_dir):
    s, models = _nextday(spark, sf_dir)
    test = s.filter(F.col("split") == "test")
    pred = models.predict_long(test, K)
    truth = windows.targets_long(test, K)
    return pred.join(truth, [*K, "sample_ts", "horizon"]), models


@register("nextday_model_metrics")
def q_nd_metrics(spark, sf_dir):
    """M10 + M11: 24 direct models; metrics per horizon hour and overall
    (flattened over samples × hours; horizon −1 is the overall row)."""
    long, _ = _nextday_long(spark, sf_dir)
    per = evaluation.regression_metrics(long, ["horizon"])
    overall = evaluation.regression_metrics(long, ()).withColumn("horizon", F.lit(-1))
    return per.unionByName(overall)


@register("nextday_median_examples")
def q_nd_examples(spark, sf_dir):
    """M12 + W8: per-sample RMSE over 24 h and the five around the median."""
    long, _ = _nextday_long(spark, sf_dir)
    per = evaluation.sample_rmse(long, [*K, "sample_ts"])
    return windows.median_centred(per, K, "rmse", "sample_ts", 5)


_NAIVE_HOURS = {**_HR, "l": f"""SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rd FROM r
  QUALIFY rd <= {WIN}""", "t": f"""SELECT series_id, max(ts) AS last_ts, avg({HOURLY_TARGET}) AS mean,
  max(CASE WHEN rd = 1 THEN {HOURLY_TARGET} END) AS last, max(CASE WHEN rd = 3 THEN {HOURLY_TARGET} END) AS y3
  FROM l GROUP BY 1""", "f": f"""SELECT t.*, l.{HOURLY_TARGET} AS same, CAST({WIN} - l.rd AS INTEGER) AS horizon,
  date_trunc('day', last_ts) + INTERVAL 1 DAY + ({WIN} - l.rd) * INTERVAL 1 HOUR AS ts
  FROM t JOIN l ON l.series_id = t.series_id"""}


@register("nextday_naive_hours", S.with_ctes(_NAIVE_HOURS, """SELECT series_id, ts, horizon, 'last_value' AS method, last AS yhat FROM f
UNION ALL SELECT series_id, ts, horizon, 'daily_average', mean FROM f
UNION ALL SELECT series_id, ts, horizon, 'same_pattern', same FROM f
UNION ALL SELECT series_id, ts, horizon, 'trend_last3', greatest(0.0, last + (last - y3) / 2.0 * (horizon + 1)) FROM f"""))
def q_naive_hours(spark, sf_dir):
    """B1–B4 for the coming day: 24 labelled hours per series and method."""
    y = HOURLY_TARGET
    today = windows.latest_window(repaired_hourly(spark, sf_dir), K, [y], "ts", WIN)
    slope = (F.col(f"{y}_hour_{WIN - 1}") - F.col(f"{y}_hour_{WIN - 3}")) / F.lit(2.0)
    h = F.col("horizon")
    naive = M.forecast_labels(today, K).join(today.drop("sample_ts"), K).select(
        *K, "ts", "horizon", F.inline(F.array(
            F.struct(F.lit("last_value").alias("method"), F.col(f"{y}_daily_last").alias("yhat")),
            F.struct(F.lit("daily_average").alias("method"), F.col(f"{y}_daily_mean").alias("yhat")),
            F.struct(F.lit("trend_last3").alias("method"),
                     F.greatest(F.lit(0.0), F.col(f"{y}_daily_last") + slope * (h + 1)).alias("yhat")))))
    same = today.select(*K, F.inline(F.array(*[F.struct(F.lit(i).alias("horizon"), F.col(f"{y}_hour_{i}").alias("yhat"))
                                               for i in range(WIN)]))).withColumn("method", F.lit("same_pattern"))
    same = M.forecast_labels(today, K).join(same, [*K, "horizon"]).select(*K, "ts", "horizon", "method", "yhat")
    return naive.unionByName(same)


@register("nextday_forecast_hours")
def q_nd_hours(spark, sf_dir):
    """M13 + W9: the 24 labelled hours of the coming day per series, from the
    24 models and the naive methods."""
    _, models = _nextday(spark, sf_dir)
    latest = windows.latest_window(repaired_hourly(spark, sf_dir), K, ND_FEATS, "ts", WIN)
    pred = models.predict_long(latest, K)
    rows = M.forecast_labels(latest, K).join(pred, [*K, "sample_ts", "horizon"]).select(
        *K, "ts", "horizon", F.lit("model").alias("method"), "yhat")
    return rows.unionByName(q_naive_hours(spark, sf_dir))


@register("method_comparison_with_model")
def q_methods(spark, sf_dir):
    """B6 + W9: the next-day models ranked with the naive methods on the same
    hours: test samples whose window is one calendar day."""
    long, _ = _nextday_long(spark, sf_dir)
    day = F.expr(f"INTERVAL {WIN} HOURS")
    model = long.filter(F.hour("sample_ts") == 0).select(
        *K, (F.col("sample_ts") + day + F.make_dt_interval(F.lit(0), F.col("horizon"))).alias("ts"),
        F.lit("model").alias("method"), "yhat", "y")
    naive = q_backtest(spark, sf_dir).join(model.select(*K, "ts").distinct(), [*K, "ts"]).select(
        *K, "ts", "method", "yhat", "y")
    return baselines.compare_methods(model.unionByName(naive), K)


@register("nextday_forecast")
def q_nd_forecast(spark, sf_dir):
    """Mean / peak / minimum per method of the coming day, beside today's
    actuals."""
    y = HOURLY_TARGET
    today = windows.latest_window(repaired_hourly(spark, sf_dir), K, [y], "ts", WIN)
    actual = today.select(*K, F.lit("today").alias("method"), F.inline(F.array(
        *[F.struct(F.col(f"{y}_hour_{i}").alias("yhat")) for i in range(WIN)])))
    rows = q_nd_hours(spark, sf_dir).drop("ts", "horizon").unionByName(actual)
    return rows.groupBy(*K, "method").agg(F.avg("yhat").alias("mean"), F.max("yhat").alias("peak"),
                                          F.min("yhat").alias("minimum"), F.count(F.lit(1)).alias("hours"))


@register("scenario_gbt")
def q_scenario_gbt(spark, sf_dir):
    """X10 with trees: project the daily features, score history and
    future with a GBT fitted on the daily history."""
    _, _, proj, _, _ = prepared(spark, sf_dir)
    return _daily_model(spark, sf_dir).transform(proj, out=DAILY_TARGET)


def _daily_model(spark, sf_dir):
    hist = prepared(spark, sf_dir)[0]
    return _stored_regressor(hist, "daily", DF, DAILY_TARGET)


@register("intervention_events_gbt")
def q_events_gbt(spark, sf_dir):
    """X14 with trees: the rollout under the boosted-tree scorer; thresholds
    are the mean prediction per scenario."""
    from dataclasses import replace
    _, _, proj, _, _ = prepared(spark, sf_dir)
    m = _daily_model(spark, sf_dir)
    future = proj.filter("is_projected").drop("is_projected")
    score = lambda df: m.transform(df, out=DAILY_TARGET)
    level = {r["scenario"]: r["t"] for r in score(future).groupBy("scenario").agg(F.avg(DAILY_TARGET).alias("t")).collect()}
    rules = [replace(r, threshold=float(level.get(r.scenario) or 0.0)) for r in INTERVENTIONS]
    return intervention.rollout(future, K, score, DAILY_TARGET, BRINE, STEAM, SCEN_RULES, rules)[1]


# ---------------------------------------------------------------------------
# sinks (S10–S12)
# ---------------------------------------------------------------------------
from tempora.sources import sinks  # noqa: E402


@register("metrics_runs_latest")
def q_runs(spark, sf_dir):
    """Write two runs of back-test metrics to the runs table (the first
    over the first half of the days, the second over all), read the latest run
    of every method back, flattened to per-hour rows."""
    import uuid
    from datetime import datetime as _dt

    from tempora.session import checkpoint_dir
    path = f"{checkpoint_dir(spark).rstrip('/')}/tempora-runs-{uuid.uuid4().hex}"
    from tempora.session import materialize
    every = materialize(q_backtest(spark, sf_dir), "backtest")
    middle = every.agg(F.percentile_approx(F.unix_micros(F.col("day").cast("timestamp")), 0.5)).first()[0]
    early = every.filter(F.unix_micros(F.col("day").cast("timestamp")) <= F.lit(middle))
    for ts, bt in ((_dt(2025, 6, 20, 14, 44, 54), early), (_dt(2025, 6, 21, 9, 0, 0), every)):
        per = evaluation.sample_rmse(bt, ["series_id", "day", "method"])
        sinks.append_run(sinks.metrics_record(
            ts, WIN, evaluation.regression_metrics(bt, ["method"]), evaluation.regression_metrics(bt, ["method", "horizon"]),
            windows.median_centred(per, ["method"], "rmse", "day", 5), by="method"), path)
    latest = sinks.latest_run(spark, path)
    return latest.select("run_ts", "model_type", "window_hours", F.col("overall.rmse").alias("overall_rmse"),
                         F.inline("hourly"))


SQL["metrics_runs_latest"] = _on_backtest("""SELECT TIMESTAMP '2025-06-21 09:00:00' AS run_ts, o.method AS model_type,
  24 AS window_hours, o.rmse AS overall_rmse, h.horizon AS hour, h.mse, h.rmse, h.r2
FROM (SELECT method, sqrt(avg(error * error)) AS rmse FROM fc GROUP BY 1) o
JOIN (SELECT method, horizon, avg(error * error) AS mse, sqrt(avg(error * error)) AS rmse,
  1 - sum(error * error) / (count(y) * var_pop(y)) AS r2 FROM fc GROUP BY 1, 2) h ON h.method = o.method""")


@register("model_persistence_roundtrip")
def q_persist(spark, sf_dir):
    """Save the fitted pipeline (scaler + feature order + trees), load
    it back and score the test split with both; the difference must be 0."""
    import uuid

    from tempora.session import checkpoint_dir
    r, m = _fit_hourly(spark, sf_dir)
    path = f"{checkpoint_dir(spark).rstrip('/')}/tempora-model-{uuid.uuid4().hex}"
    m.save(path)
    m2 = M.Regressor.load(path, m.features, m.target)
    test = r.filter(F.col("split") == "test").select("series_id", "ts", *GBT_FEATS)
    a = m.transform(test, out="p1")
    b = m2.transform(test, out="p2").select("series_id", "ts", "p2")
    return a.join(b, ["series_id", "ts"]).select("series_id", "ts", "p1", "p2", (F.col("p1") - F.col("p2")).alias("diff"))


# ---------------------------------------------------------------------------
# readers (S2, S4, S5, S6)
# ---------------------------------------------------------------------------
from tempora.sources import readers  # noqa: E402


@register("read_series_events", "SELECT event_id, user_id, event_type, value, props, ts FROM events")
def q_read(spark, sf_dir):
    """S2 + S4 + S5: Parquet scan, timestamp check, first-of-duplicates per
    (user, stamp) in file order, NaN → NULL."""
    return readers.read_series(spark, f"{sf_dir.rstrip('/')}/events.parquet", datetime_col="ts", keys=["user_id"])


@register("dedupe_repeated_events", """SELECT event_id, user_id, event_type, value, ts, ingest FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY ingest) AS rn FROM (
    SELECT event_id, user_id, event_type, value, ts, event_id * 2 + 1 AS ingest FROM events
    UNION ALL SELECT event_id, user_id, event_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value + 1 END, ts, event_id * 2
    FROM events WHERE event_id % 2 = 0)) WHERE rn = 1""")
def q_dedupe(spark, sf_dir):
    """S4 + S5 on rows that repeat: stamps written as text and parsed back, the
    first of every (user, stamp) in ingest order, NaN → NULL."""
    e = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), (F.col("event_id") * 2 + 1).alias("ingest"))
    again = e.filter(F.col("event_id") % 2 == 0).withColumn("ingest", F.col("event_id") * 2).withColumn(
        "value", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value") + 1))
    both = readers.parse_timestamps(e.unionByName(again), "ts", out="ts")
    first = readers.dedupe_first(both, ["user_id"], "ts", order_col="ingest")
    return first.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


@register("csv_roundtrip_daily", S.with_ctes({"d": _D}, "SELECT ts, series_id, qty, disc, tax, price FROM d"))
def q_csv(spark, sf_dir):
    """S10 + S1: export the daily table as CSV with a header, read it back."""
    import uuid

    from tempora.session import checkpoint_dir
    path = f"{checkpoint_dir(spark).rstrip('/')}/tempora-csv-{uuid.uuid4().hex}"
    sinks.export(daily_frame(spark, sf_dir).select("ts", "series_id", *DC), path, "csv")
    return readers.read_series(spark, path, datetime_col="ts", drop_duplicates=False)


@register("display_rounded_quantity", """SELECT l_orderkey, l_linenumber, round_even(l_quantity / 8, 2) AS eighths,
  round_even(-l_quantity / 8, 2) AS negative FROM lineitem""")
def q_rounded(spark, sf_dir):
    """P10: half-even rounding for display, on eighths (exact ties at two
    decimals)."""
    li = table(spark, sf_dir, "lineitem")
    return quality.display_round(li.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 8).alias("eighths"),
                                           (-F.col("l_quantity") / 8).alias("negative")), 2)


@register("prediction_correlation", S.with_ctes({**_DR, "cf": f"""SELECT regr_intercept({DAILY_TARGET}, qty) AS a,
  regr_slope({DAILY_TARGET}, qty) AS b FROM rd""", "p": "SELECT rd.*, cf.a + cf.b * rd.qty AS pred FROM rd CROSS JOIN cf",
    "c": " UNION ALL ".join(f"SELECT series_id, '{c}' AS feature, corr({c}, pred) AS corr FROM p GROUP BY 1" for c in DF)},
    "SELECT *, CAST(rank() OVER (PARTITION BY series_id ORDER BY corr DESC NULLS LAST) AS INTEGER) AS rank FROM c"))
def q_pred_corr(spark, sf_dir):
    """A5: correlation of every feature with the prediction, ranked."""
    hist, sc, _, _, _ = prepared(spark, sf_dir)
    scored = sc.transform(hist).withColumnRenamed(DAILY_TARGET, "pred")
    return profile.correlation_with(scored, K, "pred", "ts", DF)


# one series without a day, one with a missing value
_HOLES = {**{k: v for k, v in _DR.items() if k != "rd"}, "rd0": _DR["rd"],
          "rd": """SELECT series_id, ts, CASE WHEN series_id = 'A' AND ts = TIMESTAMP '1998-03-05' THEN NULL ELSE qty END AS qty,
  disc, tax, price FROM rd0 WHERE NOT (series_id = 'N' AND ts = TIMESTAMP '1998-03-05')"""}
_WHOLE = f"""SELECT series_id, count(*) AS n, count(*) > {2 * P_DAILY} AS long,
  count(*) = date_diff('day', min(ts), max(ts)) + 1 AS whole, {', '.join(f'count({c}) = count(*) AS w_{c}' for c in DF)}
FROM rd GROUP BY 1"""


def _with_holes(spark, sf_dir):
    at = F.lit("1998-03-05").cast("timestamp_ntz")
    hist = prepared(spark, sf_dir)[0].select(*K, "ts", *DF)
    return hist.filter(~((F.col("series_id") == "N") & (F.col("ts") == at))).withColumn(
        "qty", F.when(~((F.col("series_id") == "A") & (F.col("ts") == at)), F.col("qty")))


@register("seasonal_profile_incomplete", S.with_ctes({**_HOLES, **_season_sql(DF), "wh": _WHOLE}, "SELECT se.series_id, phase, se.n, "
    + ", ".join(f"CASE WHEN w_{c} THEN {c} END AS {c}" for c in DF) + " FROM se JOIN wh ON wh.series_id = se.series_id AND whole"))
def q_season_holes(spark, sf_dir):
    """X8 on an incomplete history: a series without a day has no profile, a
    feature with a NULL has no component."""
    return scenario.seasonal_profile(_with_holes(spark, sf_dir), K, DF, P_DAILY)


@register("seasonality_notices", S.with_ctes({**_HOLES, "wh": _WHOLE}, " UNION ALL ".join(
    f"""SELECT series_id, '{c}' AS feature, CASE WHEN NOT long THEN 'short history' WHEN NOT whole THEN 'missing stamps'
  ELSE 'missing values' END AS reason FROM wh WHERE NOT (long AND whole AND w_{c})""" for c in DF)))
def q_notices(spark, sf_dir):
    """Series and features that go on without seasonality, and why."""
    return scenario.seasonality_notices(_with_holes(spark, sf_dir), K, DF, P_DAILY)


@register("generated_index_orders", """SELECT *, TIMESTAMP '2020-01-01' + (row_number() OVER () - 1) * INTERVAL 1 HOUR AS ts
FROM orders""")
def q_genindex(spark, sf_dir):
    """Stamps start + i·1h from the row position in file order."""
    return readers.read_series(spark, f"{sf_dir.rstrip('/')}/orders.parquet", start_date="2020-01-01",
                               freq="h", drop_duplicates=False)


# ---------------------------------------------------------------------------
# SQL oracle for the iterated rollout: a recursive CTE carries the event
# list per series and scenario, one year window per step.
# ---------------------------------------------------------------------------
def _lift_sql(feat: str, evs: str, ts: str, first: str, scen: str = "scenario") -> str:
    by_rule = {(r.scenario, r.feature): r for r in SCEN_RULES}
    parts = []
    for ir in INTERVENTIONS:
        delta = ir.delta_brine if feat == BRINE else ir.delta_steam
        r = by_rule.get((ir.scenario, feat))
        yrs = f"CAST((epoch_us({ts}) - epoch_us(e)) // 86400000000 AS DOUBLE) / 365.25"
        kind = r.type if r else "constant"
        if kind == "exponential":
            fac = f"pow({1.0 + r.growth_rate!r}, {yrs})"
        elif kind == "linear":
            fac = f"pow(1.0 + CASE WHEN {first} <> 0 THEN {float(r.slope)!r} / {first} ELSE 0.0 END, {yrs})"
        else:
            fac = "1.0"
        parts.append(f"WHEN {scen} = '{ir.scenario}' THEN coalesce(list_sum(list_transform("
                     f"list_filter({evs}, lambda e: e <= {ts}), lambda e: greatest(0.0, {delta!r} * {fac}))), 0.0)")
    return "(CASE " + " ".join(parts) + " END)"


def _rollout_ctes() -> dict:
    lift_q = _lift_sql(BRINE, "r.evs", "f.ts", "f.fq", "f.scenario")
    return {
        **_YEAR_CTES,
        "fr": """SELECT *, first_value(qty) OVER (PARTITION BY series_id, scenario ORDER BY ts) AS fq,
  first_value(disc) OVER (PARTITION BY series_id, scenario ORDER BY ts) AS fd FROM fy""",
        "yj": """SELECT series_id, scenario, yr, any_value(window_start) AS ws,
  row_number() OVER (PARTITION BY series_id, scenario ORDER BY yr) AS j FROM fy WHERE yr IS NOT NULL GROUP BY 1, 2, 3""",
        "fj": "SELECT fr.*, yj.j FROM fr JOIN yj USING (series_id, scenario, yr)",
        "mx": "SELECT series_id, scenario, max(j) AS mj FROM yj GROUP BY 1, 2",
        # one step per year window, carrying the event list
        "roll(series_id, scenario, j, evs)": f"""SELECT series_id, scenario, 0, CAST([] AS TIMESTAMP[]) FROM mx
  UNION ALL
  SELECT r.series_id, r.scenario, r.j + 1,
    CASE WHEN (SELECT avg(cf.a + cf.b * (f.qty + {lift_q}))
               FROM fj f, cf WHERE f.series_id = r.series_id AND f.scenario = r.scenario AND f.j = r.j + 1)
              < {_thr_sql("r.scenario")}
         THEN list_append(r.evs, (SELECT ws FROM yj WHERE yj.series_id = r.series_id AND yj.scenario = r.scenario AND yj.j = r.j + 1))
         ELSE r.evs END
  FROM roll r JOIN mx ON mx.series_id = r.series_id AND mx.scenario = r.scenario WHERE r.j < mx.mj""",
        "ev": """SELECT series_id, scenario, evs FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id, scenario ORDER BY j DESC) AS rn FROM roll) WHERE rn = 1""",
        "adj": f"""SELECT f.series_id, f.scenario, f.ts,
  f.qty + {_lift_sql(BRINE, 'ev.evs', 'f.ts', 'f.fq', 'f.scenario')} AS qty,
  f.disc + {_lift_sql(STEAM, 'ev.evs', 'f.ts', 'f.fd', 'f.scenario')} AS disc,
  f.tax FROM fr f JOIN ev ON ev.series_id = f.series_id AND ev.scenario = f.scenario""",
        "adjp": f"SELECT adj.*, cf.a + cf.b * adj.qty AS {DAILY_TARGET} FROM adj CROSS JOIN cf",
    }


def _rollout_sql(extra: dict, final: str) -> str:
    return S.with_ctes({**_rollout_ctes(), **extra}, final, recursive=True)


SQL["intervention_events"] = _rollout_sql({}, """SELECT series_id, scenario, drill_ts, CAST(year(drill_ts) AS INTEGER) AS year
FROM (SELECT series_id, scenario, unnest(evs) AS drill_ts FROM ev)""")

SQL["intervention_adjusted"] = _rollout_sql({}, "SELECT * FROM adjp")

SQL["intervention_result"] = _rollout_sql({"hist": """SELECT series_id, scenario, ts, qty, disc, tax, is_projected FROM past
  UNION ALL SELECT series_id, scenario, ts, qty, disc, tax, is_projected FROM fut"""}, f"""SELECT h.series_id, h.scenario, h.ts, h.qty, h.disc, h.tax,
  coalesce(a.qty, h.qty) AS qty_adjusted, coalesce(a.disc, h.disc) AS disc_adjusted, coalesce(a.tax, h.tax) AS tax_adjusted,
  cf.a + cf.b * h.qty AS {DAILY_TARGET}_no_intervention,
  coalesce(a.{DAILY_TARGET}, cf.a + cf.b * h.qty) AS {DAILY_TARGET}_with_intervention, h.is_projected
FROM hist h CROSS JOIN cf LEFT JOIN adjp a ON a.series_id = h.series_id AND a.scenario = h.scenario AND a.ts = h.ts""")

SQL["intervention_summary"] = _rollout_sql({
    "cnt": "SELECT series_id, scenario, CAST(len(evs) AS BIGINT) AS interventions FROM ev",
    "yq": f"""SELECT series_id, scenario, 'day' AS period, CAST(ts AS DATE) AS period_end, avg({DAILY_TARGET}) AS mean
  FROM adjp GROUP BY 1, 2, 4
  UNION ALL
  SELECT series_id, scenario, 'year', make_date(year(ts), 12, 31), avg({DAILY_TARGET})
  FROM adjp GROUP BY 1, 2, 4
  UNION ALL
  SELECT series_id, scenario, 'quarter', period_end, avg({DAILY_TARGET}) FROM (
    SELECT *, last_day(CAST(date_trunc('month', f) AS DATE)
      + to_months(CAST(3 * ceil(((year(ts) * 12 + month(ts)) - (year(f) * 12 + month(f))) / 3) AS INTEGER))) AS period_end
    FROM (SELECT *, min(ts) OVER (PARTITION BY series_id, scenario) AS f FROM adjp)) GROUP BY 1, 2, 4"""},
    """SELECT yq.series_id, yq.scenario, period, period_end, mean, coalesce(cnt.interventions, 0) AS interventions
FROM yq LEFT JOIN cnt ON cnt.series_id = yq.series_id AND cnt.scenario = yq.scenario""")


@register("interpolate_linear_chunked", _LIN)
def q_linear_chunked(spark, sf_dir):
    """T1 + T2 + T4 with windows over (series, 2-day chunk): the same result
    as ``interpolate_linear`` without putting a whole series in one task."""
    return repair.enforce_frequency_chunked(hourly_frame(spark, sf_dir), K, "ts", "h", chunk="2D")


@register("nextday_samples_chunked", _samples_full_sql())
def q_samples_chunked(spark, sf_dir):
    """W1–W4 over (series, 7-day chunk) with a 24 h halo each side: the
    same samples as ``nextday_samples``."""
    return windows.nextday_samples_chunked(repaired_hourly(spark, sf_dir), K, HOURLY_TARGET, ND_FEATS,
                                           "h", "ts", WIN, chunk="7D")


@register("linear_trend_pvalues")
def q_trend_p(spark, sf_dir):
    """A8 p-values: two-sided t test of each daily column's slope on position."""
    return profile.linear_trend_pvalues(daily_frame(spark, sf_dir), K, "ts", DC)


@register("naive_backtest_chunked", _BT_SQL)
def q_backtest_chunked(spark, sf_dir):
    """B1–B4 with windows over (series, 7-day chunk) + a one-day halo: the
    same rows as ``naive_backtest`` without one task per series."""
    return baselines.naive_forecasts_chunked(repaired_hourly(spark, sf_dir), K, HOURLY_TARGET, "ts", "h", "7D")


@register("seasonal_profile_chunked", S.with_ctes({**_DR, **_season_sql(DF)}, "SELECT * FROM se"))
def q_season_chunked(spark, sf_dir):
    """X8 over (series, 400-day chunk) with a half-period halo: the same
    profile as ``seasonal_profile`` without one task per series."""
    return scenario.seasonal_profile_chunked(repaired_daily(spark, sf_dir), K, DF, P_DAILY, step="D", chunk="400D")


@register("interpolate_time_chunked", _TIME_SQL)
def q_time_chunked(spark, sf_dir):
    """T6 over (series, 2-day chunk) with carried neighbours: the same
    time-weighted fill as ``interpolate_time``."""
    return repair.interpolate_chunked(hourly_frame(spark, sf_dir), K, "ts", EVC, method="time", chunk="2D")


# ---------------------------------------------------------------------------
# A6 / A7 on predictions, X16 with features
# ---------------------------------------------------------------------------
@register("prediction_histogram")
def q_pred_hist(spark, sf_dir):
    """A6 on the model's predictions and residuals of the test rows."""
    return profile.histogram(q_gbt_pairs(spark, sf_dir), K, "ts", ["prediction", "residual"], bins=30)


@register("prediction_box_summary", S.with_ctes({**_PROJ_CTES, "cf": f"""SELECT regr_intercept({DAILY_TARGET}, qty) AS a,
  regr_slope({DAILY_TARGET}, qty) AS b FROM rd""",
    "q": """SELECT series_id, scenario, v, quantile_cont(v, 0.25) OVER w AS q1, quantile_cont(v, 0.5) OVER w AS med,
  quantile_cont(v, 0.75) OVER w AS q3 FROM (SELECT series_id, scenario, cf.a + cf.b * qty AS v FROM fut CROSS JOIN cf)
  WINDOW w AS (PARTITION BY series_id, scenario)"""}, f"""SELECT series_id, scenario, '{DAILY_TARGET}' AS feature,
  any_value(q1) AS q1, any_value(med) AS median, any_value(q3) AS q3,
  min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_low,
  max(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END) AS whisker_high,
  CAST(count_if(NOT (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))) AS BIGINT) AS outliers
FROM q GROUP BY series_id, scenario"""))
def q_pred_box(spark, sf_dir):
    """A7 on the projected predictions, per series and scenario."""
    future = q_scored(spark, sf_dir).filter("is_projected")
    return profile.box_summary(future, [*K, "scenario"], "ts", [DAILY_TARGET])


_X16 = [*DF, *[f"{c}_adjusted" for c in DF], f"{DAILY_TARGET}_no_intervention", f"{DAILY_TARGET}_with_intervention"]

_RESULT = SQL["intervention_result"]
SQL["intervention_daily"] = f"""SELECT series_id, scenario, date_trunc('day', ts) AS ts,
  {', '.join(f'avg({c}) AS {c}' for c in _X16)} FROM (
{_RESULT}) GROUP BY 1, 2, 3"""


@register("intervention_daily", SQL["intervention_daily"])
def q_idaily(spark, sf_dir):
    """Per day, the original and the adjusted features and the target
    without and with interventions."""
    return profile.daily_mean(q_result(spark, sf_dir), [*K, "scenario"], "ts", _X16)


# ---------------------------------------------------------------------------
# series too large for one task: the same statements as the per-series forms
# ---------------------------------------------------------------------------
from tempora.operators import large  # noqa: E402


@register("box_summary_selected", SQL["box_summary"])
def q_box_selected(spark, sf_dir):
    """A7 with quartiles by distributed selection."""
    return profile.box_summary(repaired_hourly(spark, sf_dir), K, "ts", EVC, select=True)


@register("quartiles_selected", "SELECT l_returnflag AS series_id, " + ", ".join(
    f"quantile_cont(CAST({c} AS DOUBLE), {p}) AS {c}_{n}" for c in ("l_quantity", "l_extendedprice")
    for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))) + " FROM lineitem GROUP BY 1")
def q_quartiles_selected(spark, sf_dir):
    """T9/A7 quartiles of raw rows: three large groups, many ties."""
    from tempora.sources.tables import table
    cols = ["l_quantity", "l_extendedprice"]
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("series_id"),
                                                   *[F.col(c).cast("double").alias(c) for c in cols])
    q = large.quantiles(rows, ["series_id"], cols, [0.25, 0.5, 0.75])
    return q.select("series_id", *[F.col(f"q_{i}")[j].alias(f"{c}_{n}") for i, c in enumerate(cols)
                                   for j, n in enumerate(("q1", "median", "q3"))])


@register("linear_trend_chunked", SQL["linear_trend"])
def q_trend_chunked(spark, sf_dir):
    """A8 from moments of yearly chunks."""
    return large.linear_trend_chunked(daily_frame(spark, sf_dir), K, "ts", DC, chunk="365D")


@register("overview_chunked", SQL["overview"])
def q_overview_chunked(spark, sf_dir):
    """A2 from summaries of weekly chunks."""
    return large.overview_chunked(hourly_frame(spark, sf_dir), K, chunk="7D")


@register("clean_iqr_chunked", SQL["clean_iqr"])
def q_clean_chunked(spark, sf_dir):
    """T9 + T11 + T12 by weekly chunks and blocks of 100 rows."""
    g = repair.regularize_chunked(hourly_frame(spark, sf_dir), K, "ts", "h", chunk="7D")
    return large.clean_chunked(g, K, "ts", EVC, method="iqr", threshold=1.5, rolling_window=3, chunk="7D", block=100)


@register("clean_std_chunked", SQL["clean_std_even_window"])
def q_clean_std_chunked(spark, sf_dir):
    """T10 + T11 + T12 with an even window, chunked."""
    g = repair.regularize_chunked(hourly_frame(spark, sf_dir), K, "ts", "h", chunk="7D")
    return large.clean_chunked(g, K, "ts", EVC, method="std", threshold=2.0, rolling_window=4, chunk="7D", block=100)


@register("resample_forward_chunked", SQL["resample_forward"])
def q_resample_chunked(spark, sf_dir):
    """T7 by weekly chunks."""
    from tempora.sources.tables import table
    piv = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).alias("series_id"), "ts",
        *[F.when(F.col("event_type") == t, F.col("value")).alias(t) for t in EVC])
    return repair.resample_interpolate_chunked(piv, K, "ts", "h", EVC, chunk="7D")


# ---------------------------------------------------------------------------
# P2, P6 and A6 on a scorer that SQL can express
# ---------------------------------------------------------------------------
_LINEAR = {**_HR, "m": f"SELECT avg({HOURLY_TARGET}) AS m FROM r", "cf": f"""SELECT
  regr_intercept({HOURLY_TARGET} - m, view) AS a, regr_slope({HOURLY_TARGET} - m, view) AS b FROM r CROSS JOIN m"""}


def _shifted_scorer(rows):
    """Linear in ``view``, for the target less its mean: some predictions are
    below 0."""
    mean = rows.agg(F.avg(HOURLY_TARGET)).first()[0]
    return scenario.LinearScorer.fit(rows.withColumn("shifted", F.col(HOURLY_TARGET) - F.lit(mean)), "shifted", "view",
                                     out="prediction")


@register("scores_in_feature_order_clamped", S.with_ctes(_LINEAR, """SELECT series_id, ts, click, view,
  greatest(a + b * view, 0) AS prediction FROM r CROSS JOIN cf"""))
def q_linear_clamped(spark, sf_dir):
    """P2 + P6 + S9: further columns dropped, the rest in feature order, linear
    score floored at 0."""
    r = repaired_hourly(spark, sf_dir)
    rows = quality.validate_columns(r.select(*reversed(r.columns)), ["click", "view"], keep=K + ["ts"])
    return scenario.score(rows, _shifted_scorer(r), clamp=True)


@register("linear_prediction_histogram", S.with_ctes({**_LINEAR, "p": f"""SELECT series_id, ts,
  a + b * view AS prediction, a + b * view - {HOURLY_TARGET} AS residual FROM r CROSS JOIN cf""",
    "l": _long_sql("p", ["prediction", "residual"]),
    "b": """SELECT series_id, feature, v, min(v) OVER w AS mn, (max(v) OVER w - min(v) OVER w) / 30 AS wd
FROM l WHERE v IS NOT NULL WINDOW w AS (PARTITION BY series_id, feature)"""},
    """SELECT series_id, feature, bin, count(*) AS count, any_value(mn) + bin * any_value(wd) AS bin_start,
  any_value(mn) + (bin + 1) * any_value(wd) AS bin_end
FROM (SELECT *, CAST(CASE WHEN wd = 0 THEN 0 ELSE least(floor((v - mn) / wd), 29) END AS INTEGER) AS bin FROM b)
GROUP BY series_id, feature, bin"""))
def q_linear_pred_hist(spark, sf_dir):
    """A6 on predictions and residuals of a linear scorer."""
    r = repaired_hourly(spark, sf_dir)
    scored = scenario.score(r, _shifted_scorer(r)).withColumn("residual", F.col("prediction") - F.col(HOURLY_TARGET))
    return profile.histogram(scored, K, "ts", ["prediction", "residual"], bins=30)
