"""Next-day sliding-window samples, latest-window inputs and
ranking helpers.

A sample anchored at row i uses the features of rows [i−w, i) and targets
rows [i, i+24).  Every flattened value is a constant-offset ``lag``/``lead``
over the series partition, so all w·F inputs, the window aggregates and the
24 targets come out of one sorted pass per series (no collect_list, no
self-join).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.expressions import freq_seconds
from tempora.operators.repair import _keys

HORIZON = 24
AGG_NAMES = ("mean", "min", "max", "last", "std")


def feature_names(features: Sequence[str], window: int) -> list[str]:
    """Hour-major flattened names, then five window aggregates per feature."""
    names = [f"{f}_hour_{h}" for h in range(window) for f in features]
    names += [f"{f}_daily_{a}" for f in features for a in AGG_NAMES]
    return names


def target_names(horizon: int = HORIZON) -> list[str]:
    return [f"y_{h}" for h in range(horizon)]


def nextday_samples(df: DataFrame, keys, target: str, features: Sequence[str] | None = None,
                    ts: str = "ts", window: int = 24, horizon: int = HORIZON,
                    exclude: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """W1–W4 (+ P1/P3): one row per valid anchor.

    Valid anchors are i = w … n−h−1 (the reference's loop bound leaves the
    last possible anchor out), i.e. row i−w and row i+h must both exist;
    ``sample_ts`` is the first stamp of the input window.  The target is
    never an input (not autoregressive); ``exclude`` drops configured
    columns when present.
    """
    keys = _keys(keys)
    if features is None:
        features = [c for c in df.columns if c not in {*keys, ts, target, *exclude, *carry}]
    features = [f for f in features if f not in exclude and f != target]
    if not features:
        raise ValueError("no feature columns")
    w = Window.partitionBy(*keys).orderBy(ts)
    frame = w.rowsBetween(-window, -1)
    cols = [F.lag(ts, window).over(w).alias("sample_ts"), F.col(ts).alias("anchor_ts")]
    for h in range(window):
        for f in features:
            cols.append(F.lag(f, window - h).over(w).alias(f"{f}_hour_{h}"))
    for f in features:
        cols += [F.avg(f).over(frame).alias(f"{f}_daily_mean"), F.min(f).over(frame).alias(f"{f}_daily_min"),
                 F.max(f).over(frame).alias(f"{f}_daily_max"), F.lag(f, 1).over(w).alias(f"{f}_daily_last"),
                 F.stddev_samp(f).over(frame).alias(f"{f}_daily_std")]
    for h in range(horizon):
        cols.append((F.col(target) if h == 0 else F.lead(target, h).over(w)).alias(f"y_{h}"))
    valid = F.lag(ts, window).over(w).isNotNull() & F.lead(ts, horizon).over(w).isNotNull()
    return df.select(*keys, *cols, *carry, valid.alias("__valid")).filter("__valid").drop("__valid")


def with_halo(df: DataFrame, keys, ts: str, chunk, step, before: int, after: int) -> DataFrame:
    """Chunk a regular, gap-free series by time and copy the ``before`` rows
    preceding and the ``after`` rows following every chunk edge into the
    neighbouring chunk (``__home`` marks the original).  Row offsets equal
    time offsets on such a grid, so windows of at most ``before`` rows back
    and ``after`` rows ahead evaluated per (series, chunk) are exact for the
    home rows.  Rows are copied at most twice, into adjacent chunks."""
    from tempora.functions.expressions import epoch_us, freq_seconds
    keys = _keys(keys)
    span = freq_seconds(chunk) * 1_000_000
    st = freq_seconds(step) * 1_000_000
    if span < max(before, after) * st:
        raise ValueError("chunk must span at least the halo")
    us = epoch_us(ts)
    ck = F.floor(us / F.lit(span)).cast("long")
    off = us - ck * F.lit(span)
    targets = F.array_compact(F.array(
        F.struct(ck.alias("c"), F.lit(True).alias("home")),
        F.when(off >= F.lit(span - before * st), F.struct((ck + 1).alias("c"), F.lit(False).alias("home"))),
        F.when(off < F.lit(after * st), F.struct((ck - 1).alias("c"), F.lit(False).alias("home")))))
    out = df.select("*", F.inline(targets)).withColumnRenamed("c", "__chunk").withColumnRenamed("home", "__home")
    # explicit (series, chunk) shuffle: input partitioned by series alone
    # would otherwise satisfy the chunk windows and keep a series in one task
    return out.repartition(*keys, "__chunk")


def nextday_samples_chunked(df: DataFrame, keys, target: str, features: Sequence[str], step="h",
                            ts: str = "ts", window: int = 24, horizon: int = HORIZON, chunk="7D") -> DataFrame:
    """``nextday_samples`` with windows over (series, chunk) plus a halo,
    for long series on a regular, gap-free grid (e.g. after
    ``enforce_frequency``).  Same rows as the per-series version."""
    keys = _keys(keys)
    h = with_halo(df.select(*keys, ts, target, *features), keys, ts, chunk, step, window, horizon)
    res = nextday_samples(h, [*keys, "__chunk"], target, features, ts, window, horizon,
                          carry=["__home"])
    return res.filter("__home").drop("__home", "__chunk")


def targets_long(samples: DataFrame, keys, horizon: int = HORIZON, ts: str = "sample_ts") -> DataFrame:
    """W3 as long rows ``(keys…, sample_ts, horizon, y)``."""
    keys = _keys(keys)
    return samples.select(*keys, ts, F.inline(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"y_{h}").alias("y")) for h in range(horizon)])))


def latest_window(df: DataFrame, keys, features: Sequence[str], ts: str = "ts", window: int = 24,
                  check: bool = True, step="h") -> DataFrame:
    """Features of the last ``window`` rows of every series (the input
    of a next-day forecast).  With ``check`` a series holding fewer rows
    raises instead of producing a partial window."""
    keys = _keys(keys)
    # only rows near each series' end are ranked
    end = df.groupBy(*keys).agg(F.max(ts).alias("__end"))
    tail = df.select(*keys, ts, *features).join(end, keys).filter(
        F.timestamp_diff("SECOND", F.col(ts), F.col("__end")) < F.lit(int(window) * freq_seconds(step)))
    rd = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(ts).desc()))
    last = tail.withColumn("__rd", rd).filter(F.col("__rd") <= window)
    if check:
        # a short series fails the job that reads the result, not an extra one
        size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        last = last.withColumn("__rd", F.when(size >= window, F.col("__rd")).otherwise(
            F.raise_error(F.concat(F.lit("a series has fewer rows than the window: "),
                                   F.to_json(F.struct(*keys)))).cast("int")))
    aggs = [F.min(ts).alias("sample_ts"), F.max(ts).alias("last_ts")]
    for h in range(window):
        for f in features:
            aggs.append(F.max(F.when(F.col("__rd") == window - h, F.col(f))).alias(f"{f}_hour_{h}"))
    for f in features:
        aggs += [F.avg(f).alias(f"{f}_daily_mean"), F.min(f).alias(f"{f}_daily_min"),
                 F.max(f).alias(f"{f}_daily_max"), F.max(F.when(F.col("__rd") == 1, F.col(f))).alias(f"{f}_daily_last"),
                 F.stddev_samp(f).alias(f"{f}_daily_std")]
    return last.groupBy(*keys).agg(*aggs)


def head_per_key(df: DataFrame, keys, order: Sequence, n: int = 10) -> DataFrame:
    """First ``n`` rows of every series in the given order."""
    keys = _keys(keys)
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("row", rn.cast("int")).filter(F.col("row") <= n)


#: Shares of a group between which its median rows lie, by group size: each
#: band is wider than the error of the approximate percentiles it uses.
_BANDS = ((200, 0.0, 1.0), (20_000, 0.4, 0.6), (2_000_000, 0.49, 0.51), (None, 0.499, 0.501))


def median_centred(df: DataFrame, keys, metric: str, tie: str, k: int = 5) -> DataFrame:
    """The ``k`` rows around the median of ``metric`` per group (no keys:
    over all rows): start = max(0, n//2 − 2) in (metric, tie) order; all rows
    if n < k.

    One aggregate gives each group's size and a narrow band around its
    median; rows below the band are only counted, and the ranking runs on
    the band alone, so a large group is never sorted whole."""
    keys = _keys(keys)
    one = "__group"
    gk = keys or [one]
    rows = df if keys else df.withColumn(one, F.lit(0))
    known = rows.filter(F.col(metric).isNotNull())
    shares = sorted({s for _, lo, hi in _BANDS for s in (lo, hi)})
    at = F.percentile_approx(metric, shares, 100_000)
    lo, hi = F.lit(None), F.lit(None)
    for size, a, b in reversed(_BANDS):
        here = F.lit(True) if size is None else F.col("__n") < size
        lo = F.when(here, F.col("__q")[shares.index(a)]).otherwise(lo)
        hi = F.when(here, F.col("__q")[shares.index(b)]).otherwise(hi)
    band = known.groupBy(*gk).agg(F.count(F.lit(1)).alias("__n"), at.alias("__q")).select(
        *gk, "__n", lo.alias("__lo"), hi.alias("__hi"))
    joined = known.join(band, gk)
    below = joined.filter(F.col(metric) < F.col("__lo")).groupBy(*gk).agg(F.count(F.lit(1)).alias("__below"))
    near = joined.filter((F.col(metric) >= F.col("__lo")) & (F.col(metric) <= F.col("__hi")))
    nth = F.row_number().over(Window.partitionBy(*gk).orderBy(F.col(metric), F.col(tie)))
    start = F.greatest(F.lit(0), F.floor(F.col("__n") / 2).cast("long") - (k // 2))
    ranked = near.withColumn("__nth", nth).join(below, gk, "left").withColumn(
        "__rn", F.col("__nth") + F.coalesce("__below", F.lit(0)))
    return ranked.filter((F.col("__rn") > start) & (F.col("__rn") <= start + k)).select(
        *df.columns, (F.col("__rn") - 1).cast("int").alias("position"))
