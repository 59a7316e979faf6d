"""Incremental hourly means for series data arriving as files.

The same bucket mean as ``repair.resample_mean`` (T7, first half) written
as a Structured Streaming aggregation: event-time tumbling windows with a
watermark, so finished hours are emitted once (append mode) and state for
closed hours is dropped.  Downstream repair (grid, interpolation) runs in
batch on the appended table.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.functions.expressions import freq_seconds, nan_to_null
from tempora.session import ensure_utc


def hourly_means(stream: DataFrame, key: Column, ts: str, value: str, category: str,
                 categories: Sequence[str], freq="h", watermark: str = "2 hours") -> DataFrame:
    """Per key and bucket, the mean of ``value`` for each category (explicit
    list, like the batch pivot)."""
    ensure_utc(stream.sparkSession)
    step = freq_seconds(freq)
    v = nan_to_null(value)
    # watermarks need TIMESTAMP; with the session pinned to UTC the cast
    # keeps wall-clock values and the bucket is cast back to NTZ
    et = "__event_time"
    return (stream.withColumn(et, F.col(ts).cast("timestamp"))
                  .withWatermark(et, watermark)
                  .groupBy(key.alias("series_id"), F.window(et, f"{step} seconds").alias("w"))
                  .agg(*[F.avg(F.when(F.col(category) == c, v)).alias(c) for c in categories])
                  .select("series_id", F.col("w.start").cast("timestamp_ntz").alias("ts"), *categories))


def start_append(spark: SparkSession, source_dir: str, schema: T.StructType, out_path: str, checkpoint: str,
                 key: Column, ts: str, value: str, category: str, categories: Sequence[str],
                 freq="h", watermark: str = "2 hours", once: bool = True):
    """Run the aggregation from a directory of Parquet files into an
    append-only Parquet table (exactly-once through the checkpoint)."""
    src = spark.readStream.schema(schema).parquet(source_dir)
    agg = hourly_means(src, key, ts, value, category, categories, freq, watermark)
    w = (agg.writeStream.outputMode("append").format("parquet")
            .option("path", out_path).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")
    return w.start()
