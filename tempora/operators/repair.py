"""Time-series repair: uniform grid, interpolation, fills, resampling.

All operators work per series key.  The window partitions are the series
keys, so a series is processed in one task *after* it has been reduced to a
regular calendar grid (hourly/daily rows), whose length is bounded by the
calendar span and not by the raw data volume.  Raw-resolution inputs are
first aggregated with map-side partial aggregation (``resample_mean``).
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.expressions import (
    epoch_us, floor_ts, freq_seconds, nan_to_null, ts_plus_seconds,
)

_POS = "__pos"
#: Steps of a gap that are laid out at a time.
GAP_BLOCK = 1 << 16


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys or [])


def _numeric_cols(df: DataFrame, exclude: Iterable[str]) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if f.name not in ex and f.dataType.typeName() in
            ("double", "float", "integer", "long", "short", "byte", "decimal")]


def _string_cols(df: DataFrame, exclude: Iterable[str]) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if f.name not in ex and f.dataType.typeName() == "string"]


# --------------------------------------------------------------------------
# T1 uniform grid
# --------------------------------------------------------------------------
def _every_step(base: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per step ``__k`` from ``__k0`` to ``__k1``.  A gap is split into
    blocks first and each block into its steps, so no row carries more than
    ``GAP_BLOCK`` steps, however long the gap is."""
    k0, k1, size = F.col("__k0"), F.col("__k1"), F.lit(GAP_BLOCK)
    blocks = base.withColumn("__b", F.explode(
        F.when(k0 <= k1, F.sequence(F.floor(k0 / size), F.floor(k1 / size))).otherwise(F.array().cast("array<long>"))))
    first = F.col("__b") * size
    return blocks.select(*columns, F.explode(F.sequence(F.greatest(k0, first), F.least(k1, first + size - 1))).alias("__k"))


def regularize(df: DataFrame, keys, ts: str = "ts", freq="h") -> DataFrame:
    """Reindex every series onto the calendar ``min(ts) .. max(ts)`` step ``freq``.

    Exact-match reindex: rows off the grid (anchored at the series' first
    stamp) are dropped, missing grid stamps appear with NULL values.  The
    grid rows are generated from each data row up to its successor inside the
    series window, so no calendar table is joined back (no extra shuffle).
    Input stamps must be unique per series (see ``dedupe_first``).
    """
    keys = _keys(keys)
    step = freq_seconds(freq)
    step_us = step * 1_000_000
    values = [c for c in df.columns if c not in keys and c != ts]
    w_all = Window.partitionBy(*keys)
    w = Window.partitionBy(*keys).orderBy(ts)
    us = epoch_us(ts)
    first_us = F.min(us).over(w_all)
    first_ts = F.min(ts).over(w_all)
    rel = us - first_us
    nxt = F.lead(us).over(w) - first_us
    k0 = F.ceil(rel / F.lit(step_us)).cast("long")
    # last grid index strictly before the next stamp, or at/before this stamp for the last row
    k1 = F.when(nxt.isNull(), F.floor(rel / F.lit(step_us)))\
          .otherwise(F.ceil(nxt / F.lit(step_us)) - 1).cast("long")
    base = df.select(*keys, F.col(ts).alias("__ts"), *values,
                     first_ts.alias("__first"), k0.alias("__k0"), k1.alias("__k1"),
                     (rel % F.lit(step_us) == 0).alias("__on"))
    exploded = _every_step(base, [*keys, "__ts", "__first", "__on", *values])
    grid_ts = ts_plus_seconds(F.col("__first"), F.col("__k") * F.lit(step))
    hit = F.col("__on") & (F.col("__k") * F.lit(step_us) ==
                           epoch_us("__ts") - epoch_us("__first"))
    return exploded.select(*keys, grid_ts.alias(ts),
                           *[F.when(hit, F.col(v)).alias(v) for v in values])


def gap_rows(df: DataFrame, keys, ts: str = "ts") -> Column:
    """Row has any NULL value column (reference counts these as gaps)."""
    keys = _keys(keys)
    vals = [c for c in df.columns if c not in keys and c != ts]
    return F.greatest(*[F.col(c).isNull() for c in vals]) if len(vals) > 1 else F.col(vals[0]).isNull()


def gap_report(df: DataFrame, keys, ts: str = "ts") -> DataFrame:
    """T5: per series, rows with any NULL and total rows."""
    keys = _keys(keys)
    return df.groupBy(*keys).agg(F.count_if(gap_rows(df, keys, ts)).alias("gap_rows"),
                                 F.count(F.lit(1)).alias("rows"))


def assert_complete(df: DataFrame, keys, ts: str = "ts") -> DataFrame:
    """T5 guard: raise if any NULL remains (one aggregate action)."""
    keys = _keys(keys)
    n = df.agg(F.count_if(gap_rows(df, keys, ts)).alias("n")).first()["n"]
    if n:
        raise RuntimeError(f"{n} rows still hold NULLs after interpolation; "
                           "use a different strategy or inspect the data")
    return df


# --------------------------------------------------------------------------
# T2/T3/T6/T7 interpolation, T4/T11 fills
# --------------------------------------------------------------------------
def _neighbour_cols(keys, ts, cols, weight: Column):
    """prev/next non-null value and position for each column."""
    w_fwd = Window.partitionBy(*keys).orderBy(F.col(ts).asc()).rowsBetween(Window.unboundedPreceding, 0)
    # "next non-null" uses a descending order + unboundedPreceding frame:
    # unboundedFollowing frames are re-evaluated per row (quadratic).
    w_bwd = Window.partitionBy(*keys).orderBy(F.col(ts).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for c in cols:
        pos_if = F.when(F.col(c).isNotNull(), weight)
        out[c] = (F.last(c, True).over(w_fwd), F.last(pos_if, True).over(w_fwd),
                  F.last(c, True).over(w_bwd), F.last(pos_if, True).over(w_bwd))
    return out


def interpolate(df: DataFrame, keys, ts: str = "ts", columns: Sequence[str] | None = None,
                method: str = "linear", limit: int | None = None,
                direction: str = "both") -> DataFrame:
    """Fill NULLs between observations of each series.

    method    'linear' weights by row position (pandas ``linear``), 'time' by
              elapsed time (pandas ``time``).
    direction 'both'    leading gaps take the next value, trailing the last;
              'forward' leading gaps stay NULL, trailing take the last value;
    limit     at most ``limit`` fills from each side of a gap.
    """
    keys = _keys(keys)
    columns = list(columns) if columns is not None else _numeric_cols(df, [*keys, ts])
    if method not in ("linear", "time"):
        raise ValueError("method must be 'linear' or 'time'")
    if direction not in ("both", "forward"):
        raise ValueError("direction must be 'both' or 'forward'")
    w_pos = Window.partitionBy(*keys).orderBy(ts)
    if method == "linear":
        base = df.withColumn(_POS, F.row_number().over(w_pos).cast("double"))
    else:
        base = df.withColumn(_POS, epoch_us(ts).cast("double"))
    nb = _neighbour_cols(keys, ts, columns, F.col(_POS))
    tmp = []
    for c, (pv, pp, nv, np_) in nb.items():
        tmp += [pv.alias(f"__pv_{c}"), pp.alias(f"__pp_{c}"), nv.alias(f"__nv_{c}"), np_.alias(f"__np_{c}")]
    staged = base.select("*", *tmp)
    # for 'time' with a limit the gap is counted in rows, so keep a row index too
    if limit is not None:
        staged = staged.withColumn("__rn", F.row_number().over(w_pos))
        rn_nb = _neighbour_cols(keys, ts, columns, F.col("__rn"))
        staged = staged.select("*", *[x.alias(f"__rp_{c}") for c, (_, x, _, _) in rn_nb.items()],
                               *[x.alias(f"__rq_{c}") for c, (_, _, _, x) in rn_nb.items()])
    exprs = {}
    for c in columns:
        pv, pp, nv, np_ = (F.col(f"__pv_{c}"), F.col(f"__pp_{c}"), F.col(f"__nv_{c}"), F.col(f"__np_{c}"))
        inner = pv + (nv - pv) * (F.col(_POS) - pp) / (np_ - pp)
        if direction == "both":
            filled = F.coalesce(F.col(c), inner, pv, nv)
        else:
            filled = F.coalesce(F.col(c), inner, pv)
        if limit is not None:
            rp, rq = F.col(f"__rp_{c}"), F.col(f"__rq_{c}")
            ok = ((F.col("__rn") - rp) <= limit) | ((rq - F.col("__rn")) <= limit)
            if direction == "forward":
                ok = (F.col("__rn") - rp) <= limit
            filled = F.when(F.col(c).isNotNull(), F.col(c)).when(ok, filled)
        exprs[c] = filled.cast(df.schema[c].dataType) if df.schema[c].dataType.typeName() in ("double", "float") else filled
    return staged.select(*[exprs[c].alias(c) if c in exprs else F.col(c) for c in df.columns])


def fill_forward(df: DataFrame, keys, ts: str = "ts", columns: Sequence[str] | None = None) -> DataFrame:
    """T4: carry the last non-null value forward (string columns by default)."""
    keys = _keys(keys)
    columns = list(columns) if columns is not None else _string_cols(df, [*keys, ts])
    if not columns:
        return df
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*[F.last(c, True).over(w).alias(c) if c in columns else F.col(c) for c in df.columns])


def fill_forward_backward(df: DataFrame, keys, ts: str = "ts", columns: Sequence[str] | None = None) -> DataFrame:
    """Forward fill, then backward fill what is still missing."""
    keys = _keys(keys)
    columns = list(columns) if columns is not None else _numeric_cols(df, [*keys, ts])
    w_f = Window.partitionBy(*keys).orderBy(F.col(ts).asc()).rowsBetween(Window.unboundedPreceding, 0)
    w_b = Window.partitionBy(*keys).orderBy(F.col(ts).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*[F.coalesce(F.last(c, True).over(w_f), F.last(c, True).over(w_b)).alias(c)
                       if c in columns else F.col(c) for c in df.columns])


def enforce_frequency(df: DataFrame, keys, ts: str = "ts", freq="h", method: str = "linear",
                      limit: int | None = None, check: bool = False) -> DataFrame:
    """T1 → T2/T3 → T4 (→ T5 when ``check``): uniform grid with gaps filled."""
    keys = _keys(keys)
    g = regularize(df, keys, ts, freq)
    g = interpolate(g, keys, ts, method=method, limit=limit, direction="both")
    g = fill_forward(g, keys, ts)
    if check:
        assert_complete(g, keys, ts)
    return g


# --------------------------------------------------------------------------
# T7 resampling
# --------------------------------------------------------------------------
def resample_mean(df: DataFrame, keys, ts: str = "ts", freq="h",
                  columns: Sequence[str] | None = None) -> DataFrame:
    """Bucket mean per series and step (NaN-safe).  Partial aggregation runs
    map-side, so a hot series is pre-reduced before the shuffle."""
    keys = _keys(keys)
    columns = list(columns) if columns is not None else _numeric_cols(df, [*keys, ts])
    step = freq_seconds(freq)
    return (df.groupBy(*keys, floor_ts(ts, step).alias(ts))
              .agg(*[F.avg(nan_to_null(c)).alias(c) for c in columns]))


def resample_interpolate(df: DataFrame, keys, ts: str = "ts", freq="h",
                         columns: Sequence[str] | None = None) -> DataFrame:
    """Bucket mean, full calendar, forward-direction linear interpolation
    (leading empty buckets stay NULL, trailing take the last value)."""
    keys = _keys(keys)
    m = resample_mean(df, keys, ts, freq, columns)
    g = regularize(m, keys, ts, freq)
    return interpolate(g, keys, ts, method="linear", direction="forward")


def resample_interpolate_chunked(df: DataFrame, keys, ts: str = "ts", freq="h",
                                 columns: Sequence[str] | None = None, chunk="30D") -> DataFrame:
    """T7 with windows over (series, chunk); same result as ``resample_interpolate``."""
    m = resample_mean(df, keys, ts, freq, columns)
    return interpolate_chunked(regularize_chunked(m, keys, ts, freq, chunk), keys, ts, method="linear",
                               direction="forward", chunk=chunk)


# --------------------------------------------------------------------------
# T8 sanity checks
# --------------------------------------------------------------------------
def sanity_checks(df: DataFrame, keys, ts: str = "ts", order_col: str | None = None) -> DataFrame:
    """Per series: monotonic (in ingest order), unique stamps, constant step.

    Spark rows carry no order, so monotonicity needs an ingest-order column;
    without one only uniqueness and step regularity are checked (in time
    order).  Needs at least 3 rows for a step check.  One pass: both deltas
    come from windows over the series partition, then one aggregate.
    """
    keys = _keys(keys)
    us = epoch_us(ts)
    w_t = Window.partitionBy(*keys).orderBy(ts)
    cols = [(us - F.lag(us).over(w_t)).alias("tdelta")]
    if order_col:
        cols.append((us - F.lag(us).over(Window.partitionBy(*keys).orderBy(order_col))).alias("delta"))
    d = df.select(*keys, *cols)
    back = F.count_if(F.col("delta") < 0) if order_col else F.lit(0).cast("long")
    pos = F.when(F.col("tdelta") > 0, F.col("tdelta"))
    agg = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), back.alias("backward_steps"),
                               F.count_if(F.col("tdelta") == 0).alias("duplicate_stamps"),
                               F.count_distinct(pos).alias("distinct_steps"), F.min(pos).alias("min_step_us"))
    return agg.select(*keys, "rows",
                      (F.col("backward_steps") == 0).alias("is_monotonic"),
                      (F.col("duplicate_stamps") == 0).alias("is_unique"),
                      ((F.col("distinct_steps") == 1) & (F.col("rows") >= 3)).alias("is_regular"),
                      "backward_steps", "duplicate_stamps", "distinct_steps", "min_step_us")


# --------------------------------------------------------------------------
# Time-chunked variants for very long series
# --------------------------------------------------------------------------
# A series that is both long and fine-grained would put its whole history in
# one window partition.  These variants partition by (series, time chunk)
# instead.  Whatever a row needs from outside its chunk (series anchor, the
# next stamp, the last / next observation, the global row position) comes
# from a per-chunk summary table with one row per chunk, which is tiny next
# to the data and is joined back on (series, chunk).
_CK = "__chunk"


def _per_chunk(summary: DataFrame, keys) -> DataFrame:
    """The summary leaves its per-series window hash-partitioned by series
    only; a join would pass that coarser partitioning on and put every
    chunk of a series back into one task.  Re-key the (small) summary by
    (series, chunk) so the rows stay spread by chunk."""
    return summary.repartition(*keys, _CK)


def _with_chunk(df: DataFrame, ts: str, chunk, keys=()) -> DataFrame:
    """Add the chunk id and hash-partition by (series, chunk).  The explicit
    shuffle matters: input already partitioned by series alone would
    satisfy the (series, chunk) windows as is and keep a series in one task."""
    span = freq_seconds(chunk) * 1_000_000
    d = df.withColumn(_CK, F.floor(epoch_us(ts) / F.lit(span)).cast("long"))
    return d.repartition(*_keys(keys), _CK) if keys else d


def regularize_chunked(df: DataFrame, keys, ts: str = "ts", freq="h", chunk="30D") -> DataFrame:
    """T1 with windows over (series, chunk); same result as ``regularize``."""
    keys = _keys(keys)
    step = freq_seconds(freq)
    step_us = step * 1_000_000
    values = [c for c in df.columns if c not in keys and c != ts]
    d = _with_chunk(df, ts, chunk, keys)
    cs = d.groupBy(*keys, _CK).agg(F.min(ts).alias("__cmin"))
    wk = Window.partitionBy(*keys).orderBy(_CK)
    cs = cs.select(*keys, _CK, F.min("__cmin").over(Window.partitionBy(*keys)).alias("__first"),
                   F.lead("__cmin").over(wk).alias("__next_chunk_ts"))
    j = d.join(_per_chunk(cs, keys), [*keys, _CK])
    w = Window.partitionBy(*keys, _CK).orderBy(ts)
    us, first_us = epoch_us(ts), epoch_us("__first")
    rel = us - first_us
    nxt_ts = F.coalesce(F.lead(ts).over(w), F.col("__next_chunk_ts"))
    nxt = epoch_us(nxt_ts) - first_us
    k0 = F.ceil(rel / F.lit(step_us)).cast("long")
    k1 = F.when(nxt_ts.isNull(), F.floor(rel / F.lit(step_us))).otherwise(F.ceil(nxt / F.lit(step_us)) - 1).cast("long")
    base = j.select(*keys, F.col(ts).alias("__ts"), *values, "__first", k0.alias("__k0"), k1.alias("__k1"),
                    (rel % F.lit(step_us) == 0).alias("__on"))
    exploded = _every_step(base, [*keys, "__ts", "__first", "__on", *values])
    hit = F.col("__on") & (F.col("__k") * F.lit(step_us) == epoch_us("__ts") - epoch_us("__first"))
    return exploded.select(*keys, ts_plus_seconds(F.col("__first"), F.col("__k") * F.lit(step)).alias(ts),
                           *[F.when(hit, F.col(v)).alias(v) for v in values])


def interpolate_chunked(df: DataFrame, keys, ts: str = "ts", columns: Sequence[str] | None = None,
                        method: str = "linear", limit: int | None = None, direction: str = "both",
                        chunk="30D", ffill: Sequence[str] = ()) -> DataFrame:
    """``interpolate`` with windows over (series, chunk).

    Per chunk: row count and the first / last observation of every column
    (stamp, in-chunk row, value).  A window over the chunk rows of each
    series turns these into the row offset of the chunk and the nearest
    observation before and after it; rows whose neighbour lies outside
    their chunk take it from there.  ``ffill`` columns are forward-filled
    in the same pass (T4).
    """
    keys = _keys(keys)
    columns = list(columns) if columns is not None else _numeric_cols(df, [*keys, ts])
    ffill = [c for c in ffill if c not in columns]
    if method not in ("linear", "time") or direction not in ("both", "forward"):
        raise ValueError("method must be linear/time and direction both/forward")
    d = _with_chunk(df, ts, chunk, keys)
    wc = Window.partitionBy(*keys, _CK).orderBy(ts)
    d = d.withColumn("__lr", F.row_number().over(wc))
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in columns:
        obs = F.when(F.col(c).isNotNull(), F.struct(F.col(ts).alias("t"), F.col("__lr").alias("r"), F.col(c).alias("v")))
        aggs += [F.max(obs).alias(f"__L_{c}"), F.min(obs).alias(f"__F_{c}")]
    for c in ffill:
        aggs.append(F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(c).alias("v")))).alias(f"__S_{c}"))
    cs = d.groupBy(*keys, _CK).agg(*aggs)
    wk = Window.partitionBy(*keys).orderBy(_CK)
    cs = cs.withColumn("__off", F.coalesce(F.sum("__n").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def glob(s):
        return F.when(F.col(s).isNotNull(), F.struct(F.col(f"{s}.t").alias("t"), (F.col(f"{s}.r") + F.col("__off")).alias("r"),
                                                      F.col(f"{s}.v").alias("v")))
    prev_w = wk.rowsBetween(Window.unboundedPreceding, -1)
    next_w = Window.partitionBy(*keys).orderBy(F.col(_CK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = cs.select(*keys, _CK, "__off",
                      *[F.last(glob(f"__L_{c}"), True).over(prev_w).alias(f"__cp_{c}") for c in columns],
                      *[F.last(glob(f"__F_{c}"), True).over(next_w).alias(f"__cn_{c}") for c in columns],
                      *[F.last(f"__S_{c}", True).over(prev_w).alias(f"__cs_{c}") for c in ffill])
    j = d.join(_per_chunk(carry, keys), [*keys, _CK])
    gr = (F.col("__off") + F.col("__lr")).cast("double")
    pos = gr if method == "linear" else epoch_us(ts).cast("double")
    j = j.withColumn(_POS, pos).withColumn("__gr", gr)
    w_f = Window.partitionBy(*keys, _CK).orderBy(F.col(ts).asc()).rowsBetween(Window.unboundedPreceding, 0)
    w_b = Window.partitionBy(*keys, _CK).orderBy(F.col(ts).desc()).rowsBetween(Window.unboundedPreceding, 0)

    def cpos(s):
        return F.col(f"{s}.r").cast("double") if method == "linear" else epoch_us(F.col(f"{s}.t")).cast("double")

    sel = []
    for c in columns:
        pv = F.coalesce(F.last(c, True).over(w_f), F.col(f"__cp_{c}.v"))
        pp = F.coalesce(F.last(F.when(F.col(c).isNotNull(), F.col(_POS)), True).over(w_f), cpos(f"__cp_{c}"))
        pr = F.coalesce(F.last(F.when(F.col(c).isNotNull(), F.col("__gr")), True).over(w_f), F.col(f"__cp_{c}.r").cast("double"))
        nv = F.coalesce(F.last(c, True).over(w_b), F.col(f"__cn_{c}.v"))
        np_ = F.coalesce(F.last(F.when(F.col(c).isNotNull(), F.col(_POS)), True).over(w_b), cpos(f"__cn_{c}"))
        nr = F.coalesce(F.last(F.when(F.col(c).isNotNull(), F.col("__gr")), True).over(w_b), F.col(f"__cn_{c}.r").cast("double"))
        sel += [pv.alias(f"__pv_{c}"), pp.alias(f"__pp_{c}"), pr.alias(f"__pr_{c}"),
                nv.alias(f"__nv_{c}"), np_.alias(f"__np_{c}"), nr.alias(f"__nr_{c}")]
    sel += [F.coalesce(F.last(c, True).over(w_f), F.col(f"__cs_{c}.v")).alias(f"__ff_{c}") for c in ffill]
    staged = j.select(*df.columns, _POS, "__gr", *sel)
    out = []
    for c in df.columns:
        if c in ffill:
            out.append(F.col(f"__ff_{c}").alias(c))
            continue
        if c not in columns:
            out.append(F.col(c))
            continue
        pv, pp, nv, np_ = (F.col(f"__pv_{c}"), F.col(f"__pp_{c}"), F.col(f"__nv_{c}"), F.col(f"__np_{c}"))
        inner = pv + (nv - pv) * (F.col(_POS) - pp) / (np_ - pp)
        filled = F.coalesce(F.col(c), inner, pv, nv) if direction == "both" else F.coalesce(F.col(c), inner, pv)
        if limit is not None:
            back = (F.col("__gr") - F.col(f"__pr_{c}")) <= limit
            ok = back if direction == "forward" else back | ((F.col(f"__nr_{c}") - F.col("__gr")) <= limit)
            filled = F.when(F.col(c).isNotNull(), F.col(c)).when(ok, filled)
        out.append(filled.alias(c))
    return staged.select(*out)


def fill_forward_chunked(df: DataFrame, keys, ts: str = "ts", columns: Sequence[str] | None = None,
                         backward: bool = False, chunk="30D") -> DataFrame:
    """T4 (and T11 with ``backward``) over (series, chunk) with carried values."""
    keys = _keys(keys)
    columns = list(columns) if columns is not None else (
        _numeric_cols(df, [*keys, ts]) if backward else _string_cols(df, [*keys, ts]))
    if not columns:
        return df
    d = _with_chunk(df, ts, chunk, keys)
    aggs = []
    for c in columns:
        obs = F.when(F.col(c).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(c).alias("v")))
        aggs += [F.max(obs).alias(f"__L_{c}"), F.min(obs).alias(f"__F_{c}")]
    cs = d.groupBy(*keys, _CK).agg(*aggs)
    wk = Window.partitionBy(*keys).orderBy(_CK)
    prev_w = wk.rowsBetween(Window.unboundedPreceding, -1)
    next_w = Window.partitionBy(*keys).orderBy(F.col(_CK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = cs.select(*keys, _CK, *[F.last(f"__L_{c}", True).over(prev_w).alias(f"__cp_{c}") for c in columns],
                      *[F.last(f"__F_{c}", True).over(next_w).alias(f"__cn_{c}") for c in columns])
    j = d.join(_per_chunk(carry, keys), [*keys, _CK])
    w_f = Window.partitionBy(*keys, _CK).orderBy(F.col(ts).asc()).rowsBetween(Window.unboundedPreceding, 0)
    w_b = Window.partitionBy(*keys, _CK).orderBy(F.col(ts).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = []
    for c in df.columns:
        if c in columns:
            e = F.coalesce(F.last(c, True).over(w_f), F.col(f"__cp_{c}.v"))
            if backward:
                e = F.coalesce(e, F.last(c, True).over(w_b), F.col(f"__cn_{c}.v"))
            out.append(e.alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def enforce_frequency_chunked(df: DataFrame, keys, ts: str = "ts", freq="h", method: str = "linear",
                              limit: int | None = None, chunk="30D", materialize_input: bool = True) -> DataFrame:
    """``enforce_frequency`` with every window partitioned by (series, chunk).

    Each step reads its input twice (per-chunk summary, then the rows), so
    by default the input is written once to the shared checkpoint folder
    instead of recomputing its upstream (e.g. a resampling aggregate) per
    branch."""
    keys = _keys(keys)
    if materialize_input:
        from tempora.session import materialize
        df = materialize(df, "chunked-input")
    g = regularize_chunked(df, keys, ts, freq, chunk)
    return interpolate_chunked(g, keys, ts, method=method, limit=limit, direction="both", chunk=chunk,
                               ffill=_string_cols(g, [*keys, ts]))


def assert_sane(df: DataFrame, keys, ts: str = "ts", order_col: str | None = None) -> DataFrame:
    """T8 guard: raise when a series is not monotonic (in ingest order), has
    duplicate stamps or no constant step.  One aggregate action over the
    per-series check table."""
    chk = sanity_checks(df, keys, ts, order_col)
    bad = chk.agg(F.count_if(~F.col("is_monotonic")).alias("m"), F.count_if(~F.col("is_unique")).alias("u"),
                  F.count_if(~F.col("is_regular")).alias("r")).first()
    if bad["m"]:
        raise ValueError(f"{bad['m']} series are not monotonic increasing")
    if bad["u"]:
        raise ValueError(f"{bad['u']} series contain duplicate stamps")
    if bad["r"]:
        raise ValueError(f"{bad['r']} series have no constant frequency")
    return df
