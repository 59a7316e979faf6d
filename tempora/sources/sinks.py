"""Exports, the metrics-runs table and model persistence."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRIC = T.StructType([T.StructField("mse", T.DoubleType()), T.StructField("rmse", T.DoubleType()),
                       T.StructField("r2", T.DoubleType())])
HOURLY_METRIC = T.StructType([T.StructField("hour", T.IntegerType()), *METRIC.fields])
CV_METRIC = T.StructType([T.StructField(n, T.DoubleType()) for n in ("r2_mean", "r2_std", "rmse_mean", "rmse_std")])
ROUND_LOSS = T.StructType([T.StructField("round", T.IntegerType()), T.StructField("train_rmse", T.DoubleType()),
                           T.StructField("test_rmse", T.DoubleType())])
#: Records of all kinds; what a kind does not have is NULL when read.
RUNS_SCHEMA = T.StructType([
    T.StructField("run_ts", T.TimestampNTZType()),
    T.StructField("model_type", T.StringType()),
    T.StructField("window_hours", T.IntegerType()),
    T.StructField("overall", METRIC),
    T.StructField("hourly", T.ArrayType(HOURLY_METRIC)),
    T.StructField("example_rmses", T.ArrayType(T.DoubleType())),
    T.StructField("cv", CV_METRIC),
    T.StructField("loss_curve", T.ArrayType(ROUND_LOSS)),
])


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a result table (CSV with header, or Parquet)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def metrics_record(run_ts: datetime, window_hours: int, overall: DataFrame, per_hour: DataFrame,
                   examples: DataFrame, by: str = "model_type") -> DataFrame:
    """One run row per ``by`` value, built from metric DataFrames that
    carry that column (overall, per horizon, example samples).  Everything
    stays in Spark; nothing passes the driver."""
    o = overall.select(F.col(by).alias("model_type"), F.struct("mse", "rmse", "r2").alias("overall"))
    h = per_hour.groupBy(F.col(by).alias("model_type")).agg(F.array_sort(F.collect_list(F.struct(
        F.col("horizon").cast("int").alias("hour"), "mse", "rmse", "r2"))).alias("hourly"))
    e = examples.groupBy(F.col(by).alias("model_type")).agg(
        F.array_sort(F.collect_list("rmse")).alias("example_rmses"))
    return o.join(h, "model_type", "left").join(e, "model_type", "left").select(
        F.lit(run_ts).cast("timestamp_ntz").alias("run_ts"), "model_type",
        F.lit(int(window_hours)).alias("window_hours"), "overall", "hourly", "example_rmses")


def regressor_record(run_ts: datetime, overall: DataFrame, cv: DataFrame, curve: DataFrame,
                     model_type: str = "Regressor") -> DataFrame:
    """The run row of a single-row regressor: test metrics, metrics over the
    folds (``model.cross_validate``) and the loss after every round
    (``model.loss_curve``, bounded by the number of trees)."""
    kind = F.lit(model_type).alias("model_type")
    o = overall.select(kind, F.struct("mse", "rmse", "r2").alias("overall"))
    c = cv.select(kind, F.struct(*[F.col(f"cv_{n}").alias(n) for n in CV_METRIC.fieldNames()]).alias("cv"))
    r = curve.groupBy(kind).agg(F.array_sort(F.collect_list(F.struct(
        F.col("round").cast("int").alias("round"), "train_rmse", "test_rmse"))).alias("loss_curve"))
    return o.join(c, "model_type", "left").join(r, "model_type", "left").select(
        F.lit(run_ts).cast("timestamp_ntz").alias("run_ts"), "model_type", "overall", "cv", "loss_curve")


def append_run(record: DataFrame, path: str) -> None:
    """Append to the runs table (Parquet, append-only)."""
    record.write.mode("append").parquet(path)


def latest_run(spark: SparkSession, path: str, model_type: str | None = None) -> DataFrame:
    """The most recent run (per model type), as a query."""
    runs = spark.read.schema(RUNS_SCHEMA).parquet(path)
    if model_type:
        runs = runs.filter(F.col("model_type") == model_type)
    latest = runs.groupBy("model_type").agg(F.max_by(F.struct(*RUNS_SCHEMA.fieldNames()), "run_ts").alias("r"))
    return latest.select("r.*")
