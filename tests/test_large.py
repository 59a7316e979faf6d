"""Operators for series too large for one task: equal to the per-series forms,
spread over tasks, without one buffer or window over a series."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators import cleaning, large, profile

T0 = datetime(2024, 1, 1)
SCHEMA = "series_id long, ts timestamp_ntz, a double, b double"


@pytest.fixture(scope="module")
def rows(spark):
    """Series 0 holds nine tenths of the rows; gaps, nulls, ties, constants."""
    rng = np.random.default_rng(8)
    out = [(0, T0 + timedelta(hours=i), float(rng.normal()) if i % 11 else None, float(i % 5 == 0) * 7.0) for i in range(6000)]
    out += [(1, T0 + timedelta(hours=3 * i), 2.5, float(i * i)) for i in range(300)]
    out += [(2, T0, 1.0, 2.0), (3, T0, None, None), (4, T0, 1.0, 5.0), (4, T0 + timedelta(days=400), 4.0, None)]
    out += [(5, T0 + timedelta(days=i * i), float(-i), None) for i in range(40)] + [(6, T0, 1.0, 1.0)] * 3
    return spark.createDataFrame(out, SCHEMA).repartition(8, "series_id")


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_match_numpy(rows, accuracy):
    ps = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["series_id"]: r for r in large.quantiles(rows, "series_id", ["a", "b"], ps, accuracy).collect()}
    data = rows.toPandas()
    assert set(got) == set(data.series_id)
    for s, part in data.groupby("series_id"):
        for i, c in enumerate("ab"):
            v = part[c].dropna().to_numpy()
            if len(v):
                assert np.allclose(got[s][f"q_{i}"], np.quantile(v, ps), atol=1e-12), (s, c)
            else:
                assert got[s][f"q_{i}"] is None


def test_selected_quartiles_serve_cleaning_and_boxes(rows):
    for f in (lambda x: cleaning.mark_outliers(rows, "series_id", "ts", ["a", "b"], select=x),
              lambda x: profile.box_summary(rows, "series_id", "ts", ["a", "b"], select=x)):
        one, two = (sorted(map(tuple, f(x).collect()), key=repr) for x in (False, True))
        assert one == two
    plan = large.quantiles(rows, "series_id", ["a"], [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan


def _close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-9 * max(1, abs(a), abs(b)))


def test_trend_matches_the_series_form(rows):
    key = lambda r: (r["series_id"], r["feature"])
    one = sorted(profile.linear_trend(rows.filter("series_id != 6"), "series_id").collect(), key=key)
    two = sorted(large.linear_trend_chunked(rows.filter("series_id != 6"), "series_id", chunk="7D").collect(), key=key)
    assert len(one) == len(two)
    for a, b in zip(one, two):
        assert a.asDict().keys() == b.asDict().keys()
        for name in ("feature", "n", "slope", "intercept", "r_squared"):
            assert _close(a[name], b[name]) or (name == "r_squared" and a["n"] < 2), (a, b)


def test_overview_matches_the_series_form(rows):
    one, two = (sorted(map(tuple, f.collect())) for f in (profile.overview(rows, "series_id"),
                                                          large.overview_chunked(rows, "series_id", chunk="7D")))
    assert one == two


def test_windows_hold_a_chunk_of_the_large_series(rows, spark):
    cut = large._by_chunk(rows, ["series_id"], "ts", "7D").filter("series_id = 0")
    assert cut.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    for df in (large.overview_chunked(rows, "series_id", chunk="7D"), large.linear_trend_chunked(rows, "series_id", chunk="7D")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "series_id" in plan and "__chunk" in plan
        raw = [ln for ln in plan.splitlines() if "Window [" in ln and "ts#" in ln and "__chunk" not in ln and "first" not in ln]
        assert not raw, raw


def test_empty(spark, rows):
    none = rows.limit(0)
    assert large.quantiles(none, "series_id", ["a"], [0.5]).count() == 0
    assert large.linear_trend_chunked(none, "series_id").count() == 0 and large.overview_chunked(none, "series_id").count() == 0
