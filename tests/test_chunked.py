"""Chunked repair equals the per-series repair on random gappy series."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from tempora.operators import repair

T0 = datetime(2024, 1, 1)


def _data(spark, seed, n_series=6, strings=False):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(n_series):
        n = int(rng.integers(20, 300))
        hours = np.sort(rng.choice(24 * 40, n, replace=False))
        for h in hours:
            v = None if rng.random() < 0.4 else float(rng.normal())
            w = None if rng.random() < 0.6 else float(rng.normal())
            lab = None if rng.random() < 0.5 else f"l{int(h) % 7}"
            rows.append((s, T0 + timedelta(hours=int(h), minutes=int(rng.integers(0, 2)) * 30), v, w, lab))
    return spark.createDataFrame(rows, "series_id long, ts timestamp_ntz, v double, w double, lab string")


def _same(a, b):
    order = ["series_id", "ts" if "ts" in a.columns else "sample_ts"]
    pa = a.toPandas().sort_values(order).reset_index(drop=True)
    pb = b.toPandas().sort_values(order).reset_index(drop=True)
    assert list(pa.columns) == list(pb.columns) and len(pa) == len(pb)
    for c in pa.columns:
        if pa[c].dtype.kind == "f":
            np.testing.assert_allclose(pa[c].to_numpy(dtype=float), pb[c].to_numpy(dtype=float), rtol=1e-9, atol=1e-9,
                                       equal_nan=True, err_msg=c)
        else:
            assert pa[c].tolist() == pb[c].tolist(), c


@pytest.mark.parametrize("chunk", ["1D", "3D", "100D"])
def test_regularize_chunked(spark, chunk):
    df = _data(spark, 1)
    _same(repair.regularize_chunked(df, ["series_id"], "ts", "h", chunk), repair.regularize(df, ["series_id"], "ts", "h"))


@pytest.mark.parametrize("method,limit,direction", [("linear", None, "both"), ("linear", 2, "both"),
                                                    ("time", None, "both"), ("linear", None, "forward"),
                                                    ("time", 3, "forward")])
def test_interpolate_chunked(spark, method, limit, direction):
    df = repair.regularize(_data(spark, 2), ["series_id"], "ts", "h")
    kw = dict(columns=["v", "w"], method=method, limit=limit, direction=direction)
    _same(repair.interpolate_chunked(df, ["series_id"], "ts", chunk="2D", **kw),
          repair.interpolate(df, ["series_id"], "ts", **kw))


def test_fills_chunked(spark):
    df = _data(spark, 3)
    _same(repair.fill_forward_chunked(df, ["series_id"], "ts", chunk="1D"), repair.fill_forward(df, ["series_id"], "ts"))
    _same(repair.fill_forward_chunked(df, ["series_id"], "ts", ["v", "w"], backward=True, chunk="1D"),
          repair.fill_forward_backward(df, ["series_id"], "ts", ["v", "w"]))


def test_enforce_frequency_chunked(spark):
    df = _data(spark, 4)
    _same(repair.enforce_frequency_chunked(df, ["series_id"], "ts", "h", chunk="2D"),
          repair.enforce_frequency(df, ["series_id"], "ts", "h"))


@pytest.mark.parametrize("chunk,window,horizon", [("1D", 24, 24), ("2D", 24, 6), ("12h", 5, 12)])
def test_nextday_samples_halo(spark, chunk, window, horizon):
    from tempora.operators import windows
    rng = np.random.default_rng(len(chunk) + window)
    rows = []
    for s in range(3):
        start = T0 + timedelta(hours=int(rng.integers(0, 30)))
        for i in range(int(rng.integers(40, 200))):
            rows.append((s, start + timedelta(hours=i), float(rng.normal()), float(rng.normal())))
    df = spark.createDataFrame(rows, "series_id long, ts timestamp_ntz, a double, y double")
    _same(windows.nextday_samples_chunked(df, ["series_id"], "y", ["a"], "h", "ts", window, horizon, chunk),
          windows.nextday_samples(df, ["series_id"], "y", ["a"], "ts", window, horizon))


def test_halo_must_cover_window(spark):
    from tempora.operators import windows
    df = spark.createDataFrame([(0, T0, 1.0, 1.0)], "series_id long, ts timestamp_ntz, a double, y double")
    with pytest.raises(ValueError):
        windows.nextday_samples_chunked(df, ["series_id"], "y", ["a"], "h", "ts", 24, 24, "12h")


@pytest.mark.parametrize("P,chunk", [(8, "5D"), (7, "5D"), (24, "2D")])
def test_seasonal_profile_chunked(spark, P, chunk):
    from tempora.operators import scenario
    rng = np.random.default_rng(P)
    rows = []
    for s in range(3):
        n = int(rng.integers(2 * P + 1, 12 * P))
        x = np.sin(np.arange(n) * 2 * np.pi / P) * 2 + rng.normal(0, 0.3, n) + np.arange(n) * 0.05
        start = T0 + timedelta(hours=int(rng.integers(0, 50)))
        rows += [(s, start + timedelta(hours=i), float(v)) for i, v in enumerate(x)]
    rows.append((9, T0, 1.0))          # too short: no profile
    df = spark.createDataFrame(rows, "series_id long, ts timestamp_ntz, v double")
    a = scenario.seasonal_profile(df, ["series_id"], ["v"], P, step="h").orderBy("series_id", "phase").collect()
    b = scenario.seasonal_profile_chunked(df, ["series_id"], ["v"], P, step="h", chunk=chunk) \
        .orderBy("series_id", "phase").collect()
    assert len(a) == len(b) == 3 * P
    for x, y in zip(a, b):
        assert (x.series_id, x.phase, x.n) == (y.series_id, y.phase, y.n)
        assert abs(x.v - y.v) < 1e-9
