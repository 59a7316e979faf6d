"""Statistics of series that are too large for one task or one buffer.

A7/T9 quartiles by selection, T11 fills, A8 trends and A2/T8 steps over time
chunks, T12 smoothing over blocks of rows with a halo.  Each
gives the rows of the per-series form in ``profile``, ``cleaning`` and ``repair``.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.expressions import epoch_us, freq_seconds
from tempora.operators.cleaning import mark_outliers
from tempora.operators.repair import _CK, _keys, _numeric_cols, _per_chunk, _with_chunk
from tempora.session import materialize

#: Relative accuracy of the sketches is one over this; bands take twice as much.
ACCURACY = 10_000
#: Rows of a series smoothed in one window group.
BLOCK_ROWS = 1 << 16


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def quantiles(df: DataFrame, keys, columns: Sequence[str], probabilities: Sequence[float],
              accuracy: int = ACCURACY) -> DataFrame:
    """Exact interpolated quantiles: one row per series, ``q_<i>`` an array per
    column, NULL for a column without values.

    A sketch gives a band around each quantile that holds its rank for certain
    (the sketch errs by 1/accuracy of the rows).  One pass counts what lies below
    the bands and finds the nearest value on either side; only values inside are
    grouped, with their counts, so ties take one row however many there are, and
    running counts over the distinct values of a band find the two values to
    interpolate between.  A rank outside its band is an error, never a guess.  No buffer and no
    window holds more than about 4/accuracy of a series' distinct values.
    """
    keys, columns, ps = _keys(keys), list(columns), [float(p) for p in probabilities]
    rows = materialize(df.select(*keys, *columns), "quantile-rows")
    near = [max(0.0, min(1.0, p + d)) for p in ps for d in (-2 / accuracy, 2 / accuracy)]
    bands = materialize(rows.groupBy(*keys).agg(
        *[F.percentile_approx(c, near, accuracy).alias(f"b_{i}") for i, c in enumerate(columns)],
        *[F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)]), "quantile-bands")
    joined = rows.select(*[F.col(k).alias(f"k_{j}") for j, k in enumerate(keys)],
                         *[F.col(c).cast("double").alias(f"v_{i}") for i, c in enumerate(columns)]).join(
        bands.select(*[F.col(k).alias(f"k_{j}") for j, k in enumerate(keys)],
                     *[F.col(f"b_{i}") for i in range(len(columns))]), [f"k_{j}" for j in range(len(keys))])
    ids = [f"k_{j}" for j in range(len(keys))]
    place = [(i, m) for i in range(len(columns)) for m in range(len(ps))]
    low = lambda i, m: F.col(f"b_{i}")[2 * m].cast("double")
    high = lambda i, m: F.col(f"b_{i}")[2 * m + 1].cast("double")
    beside = joined.groupBy(*ids).agg(*[x for i, m in place for v in [F.col(f"v_{i}")] for x in (
        F.count_if(v < low(i, m)).alias(f"below_{i}_{m}"), F.max(F.when(v < low(i, m), v)).alias(f"under_{i}_{m}"),
        F.min(F.when(v > high(i, m), v)).alias(f"over_{i}_{m}"))])
    below = _stacked(beside, ids, place, lambda i, m: [F.col(f"{c}_{i}_{m}").alias(c) for c in ("below", "under", "over")])
    counts = _stacked(bands.select(*[F.col(k).alias(f"k_{j}") for j, k in enumerate(keys)],
                                   *[F.col(f"n_{i}") for i in range(len(columns))]),
                      ids, place, lambda i, m: [F.col(f"n_{i}").alias("n"), F.lit(ps[m]).alias("p")])
    inside = joined.select(*ids, F.explode(F.array_compact(F.array(*[
        F.when(F.col(f"v_{i}").between(low(i, m), high(i, m)),
               F.struct(F.lit(i).alias("i"), F.lit(m).alias("m"), F.col(f"v_{i}").alias("v"))) for i, m in place]))).alias("e"))
    values = inside.select(*ids, "e.*").groupBy(*ids, "i", "m", "v").agg(F.count(F.lit(1)).alias("held"))
    upto = F.sum("held").over(Window.partitionBy(*ids, "i", "m").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    slot = [*ids, "i", "m"]
    ranked = values.withColumn("upto", upto).join(below, slot).join(counts, slot)
    at = F.col("p") * (F.col("n") - 1)
    first, last = F.col("below") + F.col("upto") - F.col("held"), F.col("below") + F.col("upto") - 1   # ranks of the value
    holds = lambda r: F.coalesce(F.max(F.when((first <= r) & (r <= last), F.col("v"))),
                                 F.max(F.when(r == F.col("below") - 1, F.col("under"))),
                                 F.max(F.when(r == F.col("below") + F.col("band"), F.col("over"))),
                                 F.raise_error(F.lit("a rank lies outside the band of its sketch")).cast("double"))
    ranked = ranked.withColumn("band", F.sum("held").over(Window.partitionBy(*ids, "i", "m")))
    found = ranked.groupBy(*slot).agg(holds(F.floor(at)).alias("a"), holds(F.ceil(at)).alias("b"), F.first(at).alias("at"))
    value = F.when(F.floor("at") == F.ceil("at"), F.col("a")).otherwise(
        (F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b"))
    flat = found.withColumn("q", value).groupBy(*ids).agg(
        *[F.max(F.when((F.col("i") == i) & (F.col("m") == m), F.col("q"))).alias(f"f_{i}_{m}") for i, m in place])
    every = bands.select(*[F.col(k).alias(f"k_{j}") for j, k in enumerate(keys)]).join(flat, ids, "left")
    return every.select(*[F.col(f"k_{j}").alias(k) for j, k in enumerate(keys)],
                        *[F.when(F.col(f"f_{i}_0").isNotNull(), F.array(*[F.col(f"f_{i}_{m}") for m in range(len(ps))]))
                          .alias(f"q_{i}") for i in range(len(columns))])


def _stacked(wide: DataFrame, ids: list[str], place: list[tuple[int, int]], cells) -> DataFrame:
    return wide.select(*ids, F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(m).alias("m"), *cells(i, m)) for i, m in place])))


def _chunk(ts: str, chunk) -> Column:
    return F.floor(epoch_us(ts) / F.lit(int(freq_seconds(chunk)) * 1_000_000)).cast("long")


def _by_chunk(df: DataFrame, keys: list[str], ts: str, chunk) -> DataFrame:
    """``df`` dealt by (series, chunk), whatever its partitioning."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn("__chunk", _chunk(ts, chunk)).repartition(parts, *keys, "__chunk")


def trend_moments_chunked(df: DataFrame, keys, ts: str, columns: Sequence[str], chunk="30D") -> DataFrame:
    """One row per series and feature: n, means and centred second moments of
    the values and of their positions 0..n−1 in the series.

    Positions and moments are taken inside a chunk; a running count over the
    chunk summaries shifts the positions, and the moments of chunks are combined
    around the common mean, so no series is sorted in one task.
    """
    keys = _keys(keys)
    cut = _by_chunk(df.select(*keys, ts, *columns), keys, ts, chunk)
    pos = (F.row_number().over(Window.partitionBy(*keys, "__chunk").orderBy(ts)) - 1).cast("double")
    local = cut.withColumn("__x", pos)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        y = F.col(c).cast("double")
        x = F.when(y.isNotNull(), F.col("__x"))
        aggs += [F.count(y).alias(f"n__{i}"), F.avg(x).alias(f"mx__{i}"), F.avg(y).alias(f"my__{i}"),
                 F.var_pop(x).alias(f"vx__{i}"), F.var_pop(y).alias(f"vy__{i}"), F.covar_pop(x, y).alias(f"vxy__{i}")]
    chunks = local.groupBy(*keys, "__chunk").agg(*aggs)
    before = F.coalesce(F.sum("rows").over(Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    stats = ["n", "mx", "my", "vx", "vy", "vxy"]
    long = chunks.withColumn("__before", before).select(*keys, "__before", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{s}__{i}").alias(s) for s in stats]) for i, c in enumerate(columns)])))
    long = long.withColumn("mx", F.col("mx") + F.col("__before"))
    by = [*keys, "feature"]
    mean = lambda m: F.try_divide(F.sum(F.col("n") * F.col(m)), F.sum("n"))
    centre = long.groupBy(*by).agg(F.sum("n").alias("all_n"), mean("mx").alias("all_x"), mean("my").alias("all_y"))
    both = long.join(centre, by)
    dx, dy, n = F.col("mx") - F.col("all_x"), F.col("my") - F.col("all_y"), F.col("n")
    return both.groupBy(*by).agg(
        F.first("all_n").alias("n"), F.first("all_x").alias("mean_x"), F.first("all_y").alias("mean_y"),
        F.sum(n * (F.col("vx") + dx * dx)).alias("sxx"), F.sum(n * (F.col("vy") + dy * dy)).alias("syy"),
        F.sum(n * (F.col("vxy") + dx * dy)).alias("sxy"))


def linear_trend_chunked(df: DataFrame, keys, ts: str = "ts", columns: Sequence[str] | None = None, chunk="30D") -> DataFrame:
    """A8 over chunks: the rows of ``profile.linear_trend``."""
    keys = _keys(keys)
    columns = list(columns) if columns is not None else _numeric_cols(df, [*keys, ts])
    m = trend_moments_chunked(df, keys, ts, columns, chunk)
    # as regr_slope and regr_intercept: NULL without two positions
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    staged = m.withColumn("slope", slope).withColumn("intercept", F.col("mean_y") - F.col("slope") * F.col("mean_x"))
    r2 = F.when(F.col("syy") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy")))
    direction = F.when(F.col("slope") > 0, "Increasing").when(F.col("slope") < 0, "Decreasing").otherwise("No trend")
    return staged.select(*keys, "feature", "slope", "intercept", r2.alias("r_squared"),
                         direction.alias("trend_direction"), "n")


def _step_summaries(df: DataFrame, keys: list[str], ts: str, chunk) -> DataFrame:
    """Per chunk: rows, first and last stamp, and its inner steps: how many are
    zero, and the least and largest other one."""
    us = epoch_us(ts)
    cut = _by_chunk(df.select(*keys, ts), keys, ts, chunk)
    step = us - F.lag(us).over(Window.partitionBy(*keys, "__chunk").orderBy(ts))
    d = cut.select(*keys, "__chunk", ts, step.alias("step"))
    own = F.when(F.col("step") > 0, F.col("step"))
    return d.groupBy(*keys, "__chunk").agg(
        F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last"),
        F.count_if(F.col("step") == 0).alias("zeros"), F.min(own).alias("least"), F.max(own).alias("most"))


def step_summary_chunked(df: DataFrame, keys, ts: str = "ts", chunk="30D") -> DataFrame:
    """One row per series: rows, first and last stamp, repeated stamps and the
    least and largest step, from chunk summaries and the steps between chunks.
    The windows run over a chunk's rows and over a series' chunk summaries."""
    keys = _keys(keys)
    s = _step_summaries(df, keys, ts, chunk)
    over = epoch_us("first") - F.lag(epoch_us("last")).over(Window.partitionBy(*keys).orderBy("__chunk"))
    joined = s.withColumn("over", over)
    return joined.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.min("first").alias("first_ts"), F.max("last").alias("last_ts"),
        F.sum("zeros").alias("zeros"), F.min(F.least("least", "over")).alias("least"),
        F.max(F.greatest("most", "over")).alias("most"))


def overview_chunked(df: DataFrame, keys, ts: str = "ts", n_features: int | None = None, chunk="30D") -> DataFrame:
    """A2 over chunks: the rows of ``profile.overview`` for stamps that are not null."""
    keys = _keys(keys)
    nf = n_features if n_features is not None else len(_numeric_cols(df, [*keys, ts]))
    s = step_summary_chunked(df, keys, ts, chunk)
    one = F.when(F.col("zeros") == 0, F.when(F.col("least") == F.col("most"), F.col("least"))).when(
        F.col("zeros") == F.col("rows") - 1, F.lit(0).cast("long"))
    return s.select(*keys, "rows", F.lit(nf).alias("features"), "first_ts", "last_ts",
                    F.timestamp_diff("DAY", F.col("first_ts"), F.col("last_ts")).alias("span_days"),
                    (F.when(F.col("rows") > 1, one) / F.lit(1_000_000)).cast("long").alias("step_seconds"))


def clean_chunked(df: DataFrame, keys, ts: str = "ts", columns: Sequence[str] | None = None, method: str = "iqr",
                  threshold: float = 1.5, rolling_window: int = 3, chunk="30D", block: int = BLOCK_ROWS,
                  with_flags: bool = False) -> DataFrame:
    """T9-T12, the rows of ``cleaning.clean``, without a window over a series.

    Quartiles are selected.  Fills take the nearest value inside the chunk, else
    the last of earlier chunks, else the first of later ones, from a summary with
    one row per chunk.  Smoothing goes by the row's place in its series: blocks of
    ``block`` rows, each with the neighbours' rows that its frames reach into.
    Stamps are unique per series (``dedupe_first``).
    """
    keys = _keys(keys)
    columns = list(columns) if columns is not None else _numeric_cols(df, [*keys, ts])
    marked = mark_outliers(df, keys, ts, columns, method, threshold, select=True)
    names = [c for c in marked.columns if with_flags or c not in {f"__out_{c}" for c in columns}]
    own = Window.partitionBy(*keys, _CK)
    d = _with_chunk(marked.select(*names), ts, chunk, keys).withColumn("__lr", F.row_number().over(own.orderBy(ts)))
    seen = [F.when(F.col(c).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(c).alias("v"))) for c in columns]
    summary = d.groupBy(*keys, _CK).agg(
        F.count(F.lit(1)).alias("__n"), *[F.max(v).alias(f"__l_{i}") for i, v in enumerate(seen)],
        *[F.min(v).alias(f"__f_{i}") for i, v in enumerate(seen)])
    chunks = Window.partitionBy(*keys)
    before = chunks.orderBy(_CK).rowsBetween(Window.unboundedPreceding, -1)
    after = chunks.orderBy(F.col(_CK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, _CK, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
                           *[F.last(f"__l_{i}", True).over(before)["v"].alias(f"__p_{i}") for i in range(len(columns))],
                           *[F.last(f"__f_{i}", True).over(after)["v"].alias(f"__x_{i}") for i in range(len(columns))])
    j = d.join(_per_chunk(carry, keys), [*keys, _CK])
    w_f = own.orderBy(F.col(ts).asc()).rowsBetween(Window.unboundedPreceding, 0)
    w_b = own.orderBy(F.col(ts).desc()).rowsBetween(Window.unboundedPreceding, 0)
    fill = {c: F.coalesce(F.col(c), F.last(c, True).over(w_f), F.col(f"__p_{i}"), F.last(c, True).over(w_b),
                          F.col(f"__x_{i}")) for i, c in enumerate(columns)}
    filled = j.select(*[fill[c].alias(c) if c in fill else F.col(c) for c in names],
                      (F.col("__off") + F.col("__lr") - 1).alias("__at"))
    if not rolling_window or rolling_window <= 1:
        return filled.drop("__at")
    back, ahead = rolling_window // 2, (rolling_window - 1) // 2
    size = max(int(block), rolling_window)          # frames reach only into the next block
    home, place = F.floor(F.col("__at") / F.lit(size)), F.col("__at") % size
    meets = F.array_compact(F.array(home, F.when(place >= size - back, home + 1),
                                    F.when((place < ahead) & (home > 0), home - 1)))
    spread = filled.withColumn("__home", home).withColumn("__block", F.explode(meets)).repartition(*keys, "__block")
    frame = Window.partitionBy(*keys, "__block").orderBy("__at").rowsBetween(-back, ahead)
    smooth = spread.select(*[F.avg(c).over(frame).alias(c) if c in fill else F.col(c) for c in names], "__home", "__block")
    return smooth.filter(F.col("__home") == F.col("__block")).drop("__home", "__block")
