"""Calendar semantics against pandas for many random starts (each start is
one series of the same DataFrame, so one Spark job checks them all)."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tempora.operators import intervention, profile, scenario


def _starts(rng, n):
    base = datetime(2019, 1, 1)
    return [base + timedelta(days=int(rng.integers(0, 2000)), hours=int(rng.integers(0, 24)) if i % 2 else 0)
            for i in range(n)]


def test_quarter_and_year_labels_match_pandas(spark):
    rng = np.random.default_rng(21)
    starts = _starts(rng, 40)
    rows, exp_q, exp_y = [], {}, {}
    for s, t0 in enumerate(starts):
        n = int(rng.integers(30, 900))
        step = timedelta(days=1) if s % 2 == 0 else timedelta(hours=7)
        ts = [t0 + i * step for i in range(n)]
        v = rng.normal(0, 1, n)
        rows += [(s, t, float(x)) for t, x in zip(ts, v)]
        ser = pd.Series(v, index=pd.DatetimeIndex(ts))
        q = ser.resample("3ME").mean().dropna()
        exp_q[s] = {k.date(): val for k, val in q.items()}
        y = ser.resample("YE").mean().dropna()
        exp_y[s] = {k.date(): val for k, val in y.items()}
    df = spark.createDataFrame(rows, "series_id long, ts timestamp_ntz, v double")
    got_q = profile.quarter_mean(df, ["series_id"], "ts", ["v"]).collect()
    got_y = profile.yearly_mean(df, ["series_id"], "ts", ["v"]).collect()
    for name, got, exp in (("quarter", got_q, exp_q), ("year", got_y, exp_y)):
        mine = {}
        for r in got:
            mine.setdefault(r.series_id, {})[r.period_end] = r.v
        for s in exp:
            assert set(mine[s]) == set(exp[s]), (name, s, starts[s])
            for k in exp[s]:
                assert abs(mine[s][k] - exp[s][k]) < 1e-9


@settings(max_examples=8, deadline=None)
@given(st.datetimes(min_value=datetime(2000, 1, 1), max_value=datetime(2030, 12, 31)),
       st.integers(min_value=1, max_value=6), st.sampled_from([1, 6, 24]))
def test_future_calendar_matches_pandas(spark, last, years, step_h):
    last = last.replace(second=0, microsecond=0, minute=0)
    hist = spark.createDataFrame([(0, last - timedelta(hours=step_h), 1.0), (0, last, 2.0)],
                                 "series_id long, ts timestamp_ntz, a double")
    out = scenario.project(hist, ["series_id"], ["a"], years, [], f"{step_h}h", include_history=False,
                           materialize_history=False)
    got = sorted(r.ts for r in out.select("ts").collect())
    freq = pd.Timedelta(hours=step_h)
    start = pd.Timestamp(last) + freq
    exp = pd.date_range(start, start + pd.DateOffset(years=years) - freq, freq=freq)
    assert len(got) == len(exp) and got[0] == exp[0] and got[-1] == exp[-1]


def test_year_windows_match_pandas_year_starts(spark):
    rng = np.random.default_rng(8)
    starts = _starts(rng, 30)
    rows, exp = [], {}
    for s, t0 in enumerate(starts):
        t0 = t0 + timedelta(hours=int(rng.integers(0, 24)))
        n = int(rng.integers(100, 1500))
        ts = [t0 + timedelta(days=i) for i in range(n)]
        rows += [(s, "x", t) for t in ts]
        idx = pd.DatetimeIndex(ts)
        exp[s] = {}
        for ys in pd.date_range(idx.min(), idx.max(), freq="YS"):
            m = (idx >= ys) & (idx < ys + pd.DateOffset(years=1))
            if m.any():
                exp[s][ys.to_pydatetime()] = int(m.sum())
    df = spark.createDataFrame(rows, "series_id long, scenario string, ts timestamp_ntz")
    yw = intervention.year_windows(df, ["series_id", "scenario"], "ts").filter(F.col("__year").isNotNull())
    got = {}
    for r in yw.groupBy("series_id", "window_start").count().collect():
        got.setdefault(r.series_id, {})[r.window_start] = r["count"]
    for s in exp:
        assert got.get(s, {}) == exp[s], (s, starts[s])
