"""S1–S8 readers."""

import os
import tempfile
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.feather as feather
import pytest
from pyspark.sql import types as T

from tempora.sources import readers


def test_detect_datetime_column():
    assert readers.detect_datetime_column(["Flow", "Tarih", "DateTime"]) == "Tarih"
    assert readers.detect_datetime_column(["a", "b"]) is None


def test_csv_with_datetime_and_duplicates(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "plant.csv")
    with open(p, "w") as f:
        f.write("Timestamp,flow,power\n2024-01-01 00:00:00,1.0,5\n2024-01-01 01:00:00,2.0,6\n"
                "2024-01-01 01:00:00,9.0,9\n2024-01-01 02:00:00,NaN,7\n")
    schema = T.StructType([T.StructField("Timestamp", T.StringType()), T.StructField("flow", T.DoubleType()),
                           T.StructField("power", T.DoubleType())])
    df = readers.read_series(spark, p, datetime_col="Timestamp", schema=schema)
    rows = df.orderBy("ts").collect()
    assert [r.flow for r in rows] == [1.0, 2.0, None]        # first duplicate kept, NaN → NULL
    assert rows[0].ts == datetime(2024, 1, 1)


def test_unparsable_timestamp_raises(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "bad.csv")
    with open(p, "w") as f:
        f.write("time,v\n2024-01-01 00:00:00,1\nnot a date,2\n")
    with pytest.raises(ValueError):
        readers.read_series(spark, p, datetime_col="time")


def test_missing_index_arguments_raise(spark):
    with pytest.raises(ValueError):
        readers.read_series(spark, "/root/testdata/sf0.001/region.parquet")


def test_generated_index_parquet(spark):
    df = readers.read_series(spark, "/root/testdata/sf0.001/orders.parquet", start_date="2020-01-01", freq="h",
                             drop_duplicates=False)
    n = df.count()
    stamps = sorted(r.ts for r in df.select("ts").collect())
    assert stamps[0] == datetime(2020, 1, 1) and stamps[-1] == datetime(2020, 1, 1) + timedelta(hours=n - 1)
    assert len(set(stamps)) == n


def test_generated_index_csv(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "x.csv")
    with open(p, "w") as f:
        f.write("v\n" + "\n".join(str(i) for i in range(50)) + "\n")
    df = readers.read_series(spark, p, start_date="2024-01-01", freq="D", drop_duplicates=False)
    rows = df.orderBy("ts").collect()
    assert [int(r.v) for r in rows] == list(range(50))
    assert rows[49].ts == datetime(2024, 1, 1) + timedelta(days=49)


def test_feather_many_files(spark):
    d = tempfile.mkdtemp()
    for i in range(3):
        t = pa.table({"ts": pa.array([datetime(2024, 1, 1) + timedelta(hours=3 * i + j) for j in range(3)],
                                     pa.timestamp("us")),
                      "v": pa.array([float(3 * i + j) for j in range(3)])})
        feather.write_feather(t, os.path.join(d, f"part{i}.feather"))
    schema = T.StructType([T.StructField("ts", T.TimestampNTZType()), T.StructField("v", T.DoubleType())])
    df = readers.read_feather(spark, os.path.join(d, "*.feather"), schema)
    assert sorted(r.v for r in df.collect()) == [float(i) for i in range(9)]


def test_auto_datetime_and_column_guard(spark):
    from tempora.operators import quality
    d = tempfile.mkdtemp()
    p = os.path.join(d, "up.csv")
    with open(p, "w") as f:
        f.write("flow,Measurement Time,extra\n1.5,2024-01-01 00:00:00,x\n2.5,2024-01-01 01:00:00,y\n")
    df = readers.read_series(spark, p, datetime_col="auto")
    assert "ts" in df.columns and df.count() == 2
    out = quality.validate_columns(df, ["flow"], keep=["ts"])
    assert out.columns == ["ts", "flow"]
    with pytest.raises(ValueError):
        quality.validate_columns(df, ["flow", "steam"])


def test_export_and_display_round(spark):
    from tempora.operators import quality
    from tempora.sources import sinks
    df = spark.createDataFrame([(2.5, 0.125), (3.5, 0.135)], "a double, b double")
    r = quality.display_round(df, 0, ["a"]).collect()
    assert [x.a for x in r] == [2.0, 4.0]                      # half-even
    d = os.path.join(tempfile.mkdtemp(), "out")
    sinks.export(df, d, "csv")
    back = spark.read.option("header", True).option("inferSchema", True).csv(d)
    assert sorted(x.a for x in back.collect()) == [2.5, 3.5]
