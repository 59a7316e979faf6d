"""Frames derived from the driver tables (see FIXTURES.md, section B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.expressions import floor_ts, nan_to_null

# The five event types pivoted into hourly feature columns,
# in this order; "purchase" is the target.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
HOURLY_TARGET = "purchase"
HOURLY_FEATURES = ("click", "error", "signup", "view")
SERIES_MOD = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def hourly_frame(spark: SparkSession, sf_dir: str, multi: bool = True) -> DataFrame:
    """FX1/FX2: hourly mean of ``events.value`` pivoted on event type.

    Keyed by ``series_id = user_id % 8`` (multi) or a single series 0.  The
    pivot is written as conditional aggregates over an explicit value list,
    so it is one hash aggregate with map-side partial aggregation.
    """
    ev = table(spark, sf_dir, "events")
    sid = (F.col("user_id") % SERIES_MOD) if multi else F.lit(0).cast("long")
    v = nan_to_null("value")
    return (ev.groupBy(sid.alias("series_id"), floor_ts("ts", 3600).alias("ts"))
              .agg(*[F.avg(F.when(F.col("event_type") == t, v)).alias(t) for t in EVENT_TYPES]))


def daily_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX3: daily lineitem profile keyed by return flag.

    qty   = avg(l_quantity)          (brine-like)
    disc  = avg(l_discount) * 1000   (steam-like)
    tax   = avg(l_tax) * 1000
    price = avg(l_extendedprice)     (target)
    """
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_returnflag").alias("series_id"), floor_ts("l_shipdate", 86400).alias("ts"))
              .agg(F.avg(nan_to_null("l_quantity")).alias("qty"),
                   (F.avg(nan_to_null("l_discount")) * 1000).alias("disc"),
                   (F.avg(nan_to_null("l_tax")) * 1000).alias("tax"),
                   F.avg(nan_to_null("l_extendedprice")).alias("price")))


DAILY_FEATURES = ("qty", "disc", "tax")
DAILY_TARGET = "price"


def table_version(spark: SparkSession, sf_dir: str, *names: str) -> int:
    """Hash of the files behind the tables (place, size, time of change): a
    rewritten table has another one.  Reads no column of the rows."""
    parts = [table(spark, sf_dir, n).select(
        F.lit(n).alias("name"), "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        for n in names]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    got = every.agg(F.sum(F.xxhash64(*every.columns).cast("decimal(38,0)"))).first()[0]
    return int(got or 0)
