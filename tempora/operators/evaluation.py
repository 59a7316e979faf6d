"""Splits, scaling and error metrics as aggregates."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.operators.repair import _keys


def split_key(keys, ts: str = "ts") -> Column:
    """Stable text key of a row: keys and the stamp to the second."""
    parts = [F.col(k).cast("string") for k in _keys(keys)] + [F.date_format(ts, "yyyy-MM-dd HH:mm:ss")]
    return F.concat_ws("|", *parts)


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """Deterministic bucket from the first 32 bits of md5(key); the same
    integer is reproducible in any SQL engine with md5."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % F.lit(buckets)).cast("int")


def with_split(df: DataFrame, keys, ts: str = "ts", test_pct: int = 20, col: str = "split",
               key: Column | None = None) -> DataFrame:
    """M1: random-like row split (train/test) that is stable across runs and
    engines; replaces a seeded permutation, which no distributed engine can
    reproduce."""
    k = key if key is not None else split_key(keys, ts)
    return df.withColumn(col, F.when(hash_bucket(k) < test_pct, "test").otherwise("train"))


def with_folds(df: DataFrame, keys, ts: str = "ts", k: int = 5, col: str = "fold") -> DataFrame:
    """M4: fold id 0..k−1 from the same hash (shuffled K-fold)."""
    return df.withColumn(col, (hash_bucket(split_key(keys, ts), 1000) % F.lit(k)).cast("int"))


def scaler_stats(train: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """M2 fit: mean and population std per column (0 std → 1), on train only."""
    keys = list(keys)
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    g = train.groupBy(*keys) if keys else train
    st = g.agg(*aggs)
    return st.select(*keys, *[F.col(f"{c}__mean") for c in columns],
                     *[F.when(F.col(f"{c}__std") == 0, F.lit(1.0)).otherwise(F.col(f"{c}__std")).alias(f"{c}__std")
                       for c in columns])


def standardize(df: DataFrame, stats: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """M2 transform: (x − mean)/std.  Global stats are a single row of 2·F
    numbers, inlined as literals (no join); per-key stats join on the key."""
    keys = list(keys)
    if not keys:
        st = stats.first()
        return df.select(*[((F.col(c) - F.lit(st[f"{c}__mean"])) / F.lit(st[f"{c}__std"])).alias(c) if c in columns
                           else F.col(c) for c in df.columns])
    j = df.join(stats, keys, "left")
    return j.select(*[((F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std")).alias(c) if c in columns
                      else F.col(c) for c in df.columns])


def regression_metrics(df: DataFrame, keys: Sequence[str] = (), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """MSE, RMSE and r² = 1 − SSE/SST (not squared correlation)."""
    keys = list(keys)
    e = F.col(yhat) - F.col(y)
    g = df.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    g = g.groupBy(*keys) if keys else g.groupBy()
    agg = g.agg(F.avg(e * e).alias("mse"), F.sum(e * e).alias("_sse"),
                (F.count(y) * F.var_pop(y)).alias("_sst"), F.count(F.lit(1)).alias("n"))
    return agg.select(*keys, "mse", F.sqrt("mse").alias("rmse"),
                      (F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_sst"))).alias("r2"), "n")


def sample_rmse(df: DataFrame, sample_keys: Sequence[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """RMSE across the horizon of each sample."""
    e = F.col(yhat) - F.col(y)
    return df.groupBy(*sample_keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.count(F.lit(1)).alias("n"))
