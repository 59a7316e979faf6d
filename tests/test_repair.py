"""Repair operators against the fixed cases and pandas as oracle."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tempora.operators import cleaning, repair

T0 = datetime(2024, 1, 1)
SCHEMA = "series_id long, ts timestamp_ntz, v double"


def _series(spark, values, step_h=1, sid=0):
    rows = [(sid, T0 + timedelta(hours=i * step_h), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def _vals(df):
    return [r.v for r in df.orderBy("ts").collect()]


def test_linear_both_directions(spark):
    df = _series(spark, [None, None, 1.0, None, None, None, 5.0, None, None])
    out = repair.interpolate(df, ["series_id"], "ts", ["v"])
    assert _vals(out) == [1, 1, 1, 2, 3, 4, 5, 5, 5]


def test_linear_limit_one(spark):
    df = _series(spark, [None, None, 1.0, None, None, None, 5.0, None, None])
    out = repair.interpolate(df, ["series_id"], "ts", ["v"], limit=1)
    assert _vals(out) == [None, 1, 1, 2, None, 4, 5, 5, None]


def test_forward_direction_keeps_leading_nulls(spark):
    df = _series(spark, [None, 2.0, None, 4.0, None])
    out = repair.interpolate(df, ["series_id"], "ts", ["v"], direction="forward")
    assert _vals(out) == [None, 2, 3, 4, 4]


def test_grid_drops_off_grid_rows(spark):
    rows = [(0, datetime(2024, 1, 1, 0, 0), 1.0), (0, datetime(2024, 1, 1, 0, 30), 2.0),
            (0, datetime(2024, 1, 1, 2, 10), 3.0)]
    out = repair.regularize(spark.createDataFrame(rows, SCHEMA), ["series_id"], "ts", "h").orderBy("ts").collect()
    assert [r.ts.hour for r in out] == [0, 1, 2]
    assert [r.v for r in out] == [1.0, None, None]


def test_duplicates_keep_first_in_ingest_order(spark):
    from tempora.sources.readers import dedupe_first
    rows = [(0, T0, 1.0, 0), (0, T0, 2.0, 1), (0, T0 + timedelta(hours=1), 3.0, 2), (0, T0 + timedelta(hours=1), 4.0, 3)]
    df = spark.createDataFrame(rows, SCHEMA + ", ord long")
    assert _vals(dedupe_first(df, ["series_id"], "ts", "ord")) == [1.0, 3.0]


def test_assert_complete_raises(spark):
    df = _series(spark, [1.0, None, 3.0])
    with pytest.raises(RuntimeError):
        repair.assert_complete(df, ["series_id"])


def _random_series(rng, n_series=40):
    out = []
    for s in range(n_series):
        n = int(rng.integers(3, 60))
        v = rng.normal(10, 3, n)
        v[rng.random(n) < rng.uniform(0.1, 0.7)] = np.nan
        out.append((s, v))
    return out


def _to_df(spark, series, times=None):
    rows = []
    for s, v in series:
        ts = times[s] if times else [T0 + timedelta(hours=i) for i in range(len(v))]
        rows += [(s, t, None if np.isnan(x) else float(x)) for t, x in zip(ts, v)]
    return spark.createDataFrame(rows, SCHEMA)


def _compare(got, series, expect_fn):
    pdf = got.toPandas().sort_values(["series_id", "ts"])
    for s, v in series:
        mine = pdf[pdf.series_id == s]["v"].to_numpy(dtype=float)
        exp = expect_fn(s, pd.Series(v)).to_numpy(dtype=float)
        np.testing.assert_allclose(mine, exp, rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=f"series {s}")


@pytest.mark.parametrize("limit", [None, 1, 2, 3])
def test_linear_matches_pandas(spark, limit):
    rng = np.random.default_rng(7 + (limit or 0))
    series = _random_series(rng)
    got = repair.interpolate(_to_df(spark, series), ["series_id"], "ts", ["v"], limit=limit)
    _compare(got, series, lambda s, x: x.interpolate(method="linear", limit=limit, limit_direction="both"))


def test_forward_matches_pandas(spark):
    rng = np.random.default_rng(11)
    series = _random_series(rng)
    got = repair.interpolate(_to_df(spark, series), ["series_id"], "ts", ["v"], direction="forward")
    _compare(got, series, lambda s, x: x.interpolate(method="linear"))


def test_time_weighted_matches_pandas(spark):
    rng = np.random.default_rng(5)
    series = _random_series(rng)
    times = {}
    for s, v in series:
        gaps = rng.integers(1, 10, len(v))
        times[s] = [T0 + timedelta(minutes=int(m) * 7) for m in np.cumsum(gaps)]
    got = repair.interpolate(_to_df(spark, series, times), ["series_id"], "ts", ["v"], method="time")

    def exp(s, x):
        x.index = pd.DatetimeIndex(times[s])
        return x.interpolate(method="time").bfill()
    _compare(got, series, exp)


@pytest.mark.parametrize("window", [1, 3, 4, 5])
@pytest.mark.parametrize("method", ["iqr", "std"])
def test_clean_matches_pandas(spark, window, method):
    rng = np.random.default_rng(window * 10 + len(method))
    series = _random_series(rng)
    for _, v in series:  # plant some outliers
        idx = rng.integers(0, len(v), 2)
        v[idx] = v[idx] * 8
    got = cleaning.clean(_to_df(spark, series), ["series_id"], "ts", ["v"], method=method,
                         threshold=1.5, rolling_window=window)

    def exp(s, x):
        if method == "iqr":
            q1, q3 = x.quantile(0.25), x.quantile(0.75)
            lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        else:
            lo, hi = x.mean() - 1.5 * x.std(), x.mean() + 1.5 * x.std()
        y = x.copy()
        y[(x < lo) | (x > hi)] = np.nan
        y = y.ffill().bfill()
        if window > 1:
            y = y.rolling(window=window, min_periods=1, center=True).mean()
        return y
    _compare(got, series, exp)


def test_iqr_quartile_fixed_case(spark):
    df = _series(spark, [1.0, None, 3.0, 10.0])
    q = df.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).alias("q")).first().q
    assert q[0] == 2.0


def test_resample_then_grid_matches_pandas(spark):
    rng = np.random.default_rng(3)
    rows, pdfs = [], {}
    for s in range(10):
        n = int(rng.integers(5, 80))
        mins = np.sort(rng.choice(60 * 48, n, replace=False))
        ts = [T0 + timedelta(minutes=int(m)) for m in mins]
        v = rng.normal(0, 1, n)
        rows += [(s, t, float(x)) for t, x in zip(ts, v)]
        pdfs[s] = pd.Series(v, index=pd.DatetimeIndex(ts)).resample("h").mean().interpolate()
    got = repair.resample_interpolate(spark.createDataFrame(rows, SCHEMA), ["series_id"], "ts", "h", ["v"])
    pdf = got.toPandas().sort_values(["series_id", "ts"])
    for s, exp in pdfs.items():
        mine = pdf[pdf.series_id == s]
        assert list(pd.DatetimeIndex(mine.ts)) == list(exp.index)
        np.testing.assert_allclose(mine.v.to_numpy(dtype=float), exp.to_numpy(dtype=float), equal_nan=True)


def test_enforce_frequency_grid_matches_pandas(spark):
    rng = np.random.default_rng(9)
    rows, exp = [], {}
    for s in range(8):
        n = int(rng.integers(4, 40))
        hours = np.sort(rng.choice(100, n, replace=False))
        ts = [T0 + timedelta(hours=int(h)) for h in hours]
        v = rng.normal(5, 1, n)
        rows += [(s, t, float(x)) for t, x in zip(ts, v)]
        ser = pd.Series(v, index=pd.DatetimeIndex(ts))
        full = pd.date_range(ser.index.min(), ser.index.max(), freq="h")
        exp[s] = ser.reindex(full).interpolate(method="linear", limit_direction="both")
    got = repair.enforce_frequency(spark.createDataFrame(rows, SCHEMA), ["series_id"], "ts", "h").toPandas()
    for s, e in exp.items():
        mine = got[got.series_id == s].sort_values("ts")
        np.testing.assert_allclose(mine.v.to_numpy(dtype=float), e.to_numpy(dtype=float))


def test_multi_series_equals_union_of_single(spark):
    rng = np.random.default_rng(1)
    series = _random_series(rng, 6)
    df = _to_df(spark, series)
    whole = repair.interpolate(df, ["series_id"], "ts", ["v"]).toPandas().sort_values(["series_id", "ts"])
    for s, _ in series:
        one = repair.interpolate(df.filter(F.col("series_id") == s), ["series_id"], "ts", ["v"]).toPandas().sort_values("ts")
        np.testing.assert_allclose(whole[whole.series_id == s].v.to_numpy(dtype=float), one.v.to_numpy(dtype=float))


def test_sanity_guard(spark):
    ok = _series(spark, [1.0, 2.0, 3.0])
    repair.assert_sane(ok, ["series_id"])
    irregular = spark.createDataFrame([(0, T0, 1.0), (0, T0 + timedelta(hours=1), 1.0), (0, T0 + timedelta(hours=3), 1.0)], SCHEMA)
    with pytest.raises(ValueError):
        repair.assert_sane(irregular, ["series_id"])
    dup = spark.createDataFrame([(0, T0, 1.0), (0, T0, 2.0), (0, T0 + timedelta(hours=1), 1.0)], SCHEMA)
    with pytest.raises(ValueError):
        repair.assert_sane(dup, ["series_id"])
    backwards = spark.createDataFrame([(0, T0 + timedelta(hours=i), 1.0, o) for i, o in [(0, 0), (2, 1), (1, 2)]],
                                      SCHEMA + ", ord long")
    with pytest.raises(ValueError):
        repair.assert_sane(backwards, ["series_id"], order_col="ord")


def test_empty_single_and_all_null_series(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.enforce_frequency(empty, ["series_id"]).count() == 0
    one = _series(spark, [4.0])
    assert _vals(repair.enforce_frequency(one, ["series_id"])) == [4.0]
    nulls = _series(spark, [None, None, None])
    assert _vals(repair.interpolate(nulls, ["series_id"], "ts", ["v"])) == [None, None, None]
    with pytest.raises(RuntimeError):
        repair.enforce_frequency(nulls, ["series_id"], check=True)
