"""One dominant series: the chunked operators spread it over many tasks and
give the same rows as the per-series versions."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tempora.operators import baselines, cleaning, large, repair, windows

T0 = datetime(2024, 1, 1)


def _skewed(spark):
    rng = np.random.default_rng(5)
    rows = []
    # series 0 holds ~90 % of the rows (hourly, 120 days); 9 small series
    for i in range(24 * 120):
        rows.append((0, T0 + timedelta(hours=i), float(rng.normal(10, 2))))
    for s in range(1, 10):
        for i in range(24 * 3):
            rows.append((s, T0 + timedelta(hours=i), float(rng.normal(5, 1))))
    # already hash-partitioned by series, as after any per-series operator
    return spark.createDataFrame(rows, "series_id long, ts timestamp_ntz, y double").repartition(8, "series_id")


def _tasks_for_series0(df):
    spark = df.sparkSession
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")   # tiny data would be merged
    try:
        return df.select("series_id", F.spark_partition_id().alias("p")).filter("series_id = 0").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_chunked_spreads_hot_series(spark):
    df = _skewed(spark)
    whole = repair.enforce_frequency(df, ["series_id"], "ts", "h")
    chunked = repair.enforce_frequency_chunked(df, ["series_id"], "ts", "h", chunk="7D", materialize_input=False)
    assert _tasks_for_series0(whole) == 1
    assert _tasks_for_series0(chunked) > 1
    a = whole.orderBy("series_id", "ts").collect()
    b = chunked.orderBy("series_id", "ts").collect()
    assert a == b


def test_chunked_backtest_and_samples_match(spark):
    df = _skewed(spark)
    k = ["series_id"]
    bt1 = baselines.naive_forecasts(df, k, "y")
    bt2 = baselines.naive_forecasts_chunked(df, k, "y", "ts", "h", "7D")
    assert _tasks_for_series0(bt2) > 1
    cols = ["series_id", "ts", "method"]
    assert bt1.orderBy(*cols).collect() == bt2.select(*bt1.columns).orderBy(*cols).collect()
    s1 = windows.nextday_samples(df.withColumn("a", F.col("y") * 2), k, "y", ["a"], window=24)
    s2 = windows.nextday_samples_chunked(df.withColumn("a", F.col("y") * 2), k, "y", ["a"], "h", "ts", 24, 24, "7D")
    assert s1.orderBy("series_id", "sample_ts").collect() == s2.select(*s1.columns).orderBy("series_id", "sample_ts").collect()


def test_interpolate_chunked_spreads_series_partitioned_input(spark):
    df = _skewed(spark)
    g = repair.regularize(df, ["series_id"], "ts", "h")      # hash-partitioned by series
    out = repair.interpolate_chunked(g, ["series_id"], "ts", ["y"], chunk="7D")
    assert _tasks_for_series0(out) > 1
    assert out.orderBy("series_id", "ts").collect() == \
        repair.interpolate(g, ["series_id"], "ts", ["y"]).orderBy("series_id", "ts").collect()


def test_clean_chunked_matches_and_spreads(spark):
    rng = np.random.default_rng(11)
    rows = [(0, T0 + timedelta(hours=i), None if i % 7 == 3 or 300 < i < 900 else float(rng.normal(10, 2)) * (40 if i % 97 == 0 else 1))
            for i in range(24 * 120)]
    rows += [(1, T0 + timedelta(hours=i), None) for i in range(50)] + [(2, T0, 1.0), (3, T0, None), (3, T0 + timedelta(days=90), 4.0)]
    rows += [(4, T0 + timedelta(days=i), float(i) if i > 20 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "series_id long, ts timestamp_ntz, y double").repartition(8, "series_id")
    for method, k, w, block in (("iqr", 1.5, 3, 100), ("std", 2.0, 4, 7), ("iqr", 1.5, 1, 100), ("std", 1.0, 25, 5)):
        want = cleaning.clean(df, ["series_id"], "ts", None, method, k, w, with_flags=True)
        got = large.clean_chunked(df, ["series_id"], "ts", None, method, k, w, "7D", block, with_flags=True)
        assert got.columns == want.columns
        assert got.orderBy("series_id", "ts").collect() == want.orderBy("series_id", "ts").collect(), (method, w)
    assert _tasks_for_series0(got) > 1


def test_resample_chunked_matches_and_spreads(spark):
    df = _skewed(spark).filter("minute(ts) = 0 and dayofyear(ts) % 3 != 1")
    want = repair.resample_interpolate(df, ["series_id"], "ts", "h")
    got = repair.resample_interpolate_chunked(df, ["series_id"], "ts", "h", chunk="7D")
    assert _tasks_for_series0(want) == 1 < _tasks_for_series0(got)
    assert got.select(*want.columns).orderBy("series_id", "ts").collect() == want.orderBy("series_id", "ts").collect()


def test_long_gap_is_laid_out_in_blocks(spark, monkeypatch):
    """One gap of a year at a step of a second; and blocks of three steps give
    the rows of one block."""
    far = spark.createDataFrame([(0, T0, 1.0), (0, T0 + timedelta(days=365), 2.0)], "series_id long, ts timestamp_ntz, y double")
    grid = repair.regularize_chunked(far, ["series_id"], "ts", "1s", chunk="30D")
    got = grid.agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("seen"), F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    assert tuple(got) == (365 * 86400 + 1, 2, T0, T0 + timedelta(days=365))
    df = spark.createDataFrame([(0, T0 + timedelta(minutes=40 * i), float(i)) for i in (0, 3, 4, 5, 9, 60, 61)] + [(1, T0, 1.0)],
                               "series_id long, ts timestamp_ntz, y double")
    want = repair.regularize(df, ["series_id"]).orderBy("series_id", "ts").collect()
    monkeypatch.setattr(repair, "GAP_BLOCK", 3)
    for form in (repair.regularize, repair.regularize_chunked):
        assert form(df, ["series_id"]).orderBy("series_id", "ts").collect() == want
