"""Session construction and cluster-facing settings."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession


def get_spark(master: str | None = None, cpus: int | None = None,
              app_name: str = "tempora", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    * The master comes from the caller or from the submit configuration;
      ``local[cpus]`` is used only if neither names one.  The number of
      shuffle partitions is the cluster's own unless the caller asks.
    * UTC session time zone.  Operators work on TIMESTAMP_NTZ with
      zone-free arithmetic (epoch offsets, ``window`` buckets, interval
      addition), so batch results do not depend on the zone; only the
      streaming watermark needs a TIMESTAMP and pins UTC itself.
    * AQE on, with partition coalescing and skew-join splitting.
    * UI off: no web server is opened.
    """
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = SparkSession.builder.appName(app_name)
    running = SparkSession.getActiveSession()
    if master:
        b = b.master(master)
    elif running is None and not SparkConf().contains("spark.master") and "--master" not in os.environ.get(
            "PYSPARK_SUBMIT_ARGS", "") and not os.environ.get("MASTER"):
        b = b.master(f"local[{cpus}]").config("spark.driver.memory", os.environ.get("TEMPORA_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if (master or "").startswith("local"):
        b = b.config("spark.driver.memory", os.environ.get("TEMPORA_DRIVER_MEMORY", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_utc(spark: SparkSession) -> None:
    """Pin the session zone (streaming event time is cast NTZ → TIMESTAMP)."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts, from ``spark.checkpoint.dir``: a file
    system that the driver and every executor can reach.

    A local session without the setting gets a scratch folder of its own; any
    other session without it is an error, because executors could not read
    each other's files.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not is_local(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tempora-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def is_local(master: str) -> bool:
    """One JVM: ``local`` or ``local[...]`` (not ``local-cluster``)."""
    return master == "local" or master.startswith("local[")


def materialize(df, name: str = "table"):
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    read it back.

    Used where one input feeds several branches of a plan (a projection's
    history, a model's training rows): the upstream scan and shuffles run
    once instead of once per branch, lineage is cut, and the copy survives
    executor loss (unlike ``localCheckpoint``).
    """
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tempora-{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
