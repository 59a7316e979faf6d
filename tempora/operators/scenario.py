"""Multi-year projection of feature series under trend rules with
additive seasonality, for many series and scenarios at once.

Plan shape
----------
* per-series stats (count, last stamp, last value of each feature): one
  aggregate, one row per series;
* seasonal profile: centred moving average by prefix sums (running sum +
  constant-offset lag/lead, linear in n instead of n·P), detrended values
  averaged per phase, re-centred; P rows per series;
* future rows are *generated* from the seasonal profile: phase p of a
  series feeds the future rows k ≡ p − n (mod P), so the largest table
  (series × scenarios × periods) is produced in place and never shuffled
  or joined;
* trend rules are a small driver-side spec compiled into CASE expressions.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.expressions import epoch_us, freq_seconds, horner, ts_plus_seconds
from tempora.operators.repair import _keys
from tempora.spec import DAYS_PER_YEAR, TrendRule


def season_period(freq) -> int:
    """Periods per year: int(365.25 days / step) — 8766 hourly, 365 daily."""
    return int(DAYS_PER_YEAR * 86400 // freq_seconds(freq))


def history_state(hist: DataFrame, keys, features: Sequence[str], period: int, ts: str = "ts",
                  step="D") -> DataFrame:
    """One row per series: size, first stamp, whether stamps are missing, and
    per feature whether it can have a seasonal part (``__ok_<f>``): more than
    two periods, no missing stamp, no NULL."""
    keys = _keys(keys)
    us = freq_seconds(step) * 1_000_000
    agg = hist.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.min(ts).alias("__first"), F.max(ts).alias("__end"),
        *[F.count(f).alias(f"__c_{f}") for f in features])
    slots = (epoch_us("__end") - epoch_us("__first")) / F.lit(us) + 1
    gap = F.col("__n") != slots
    ok = (F.col("__n") > 2 * int(period)) & ~gap
    return agg.select(*keys, "__n", "__first", gap.alias("__gap"),
                      *[(ok & (F.col(f"__c_{f}") == F.col("__n"))).alias(f"__ok_{f}") for f in features])


def seasonality_notices(hist: DataFrame, keys, features: Sequence[str], period: int, ts: str = "ts",
                        step="D") -> DataFrame:
    """``(keys…, feature, reason)`` for every series and feature that goes on
    without seasonality: ``short history``, ``missing stamps`` or
    ``missing values``, the first that holds."""
    keys = _keys(keys)
    st = history_state(hist, keys, features, period, ts, step)
    reason = F.when(F.col("__n") <= 2 * int(period), "short history").when(F.col("__gap"), "missing stamps") \
        .otherwise("missing values")
    return st.select(*keys, reason.alias("reason"), F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"__ok_{f}").alias("__ok")) for f in features]))) \
        .filter(~F.col("__ok")).select(*keys, "feature", "reason")


def _profile(hist: DataFrame, keys, features, period, ts, step, group) -> DataFrame:
    """Seasonal profile with windows over ``group``; ``hist`` carries
    ``history_state`` (and ``__home`` for chunks)."""
    P, h = int(period), int(period) // 2
    w = Window.partitionBy(*group).orderBy(ts)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    extra = ["__home"] if "__home" in hist.columns else []
    base = hist.select("*", *[F.sum(f).over(run).alias(f"__S_{f}") for f in features])
    cols = []
    for f in features:
        S = F.col(f"__S_{f}")
        if P % 2 == 0:
            trend = (F.lead(S, h - 1).over(w) - F.lag(S, h).over(w)
                     + F.lit(0.5) * (F.lag(f, h).over(w) + F.lead(f, h).over(w))) / F.lit(float(P))
        else:
            lo = F.coalesce(F.lag(S, h + 1).over(w), F.lit(0.0))
            trend = F.when(F.lag(f, h).over(w).isNotNull(), (F.lead(S, h).over(w) - lo) / F.lit(float(P)))
        cols.append(F.when(F.col(f"__ok_{f}"), F.col(f) - trend).alias(f"__d_{f}"))
    pos = ((epoch_us(ts) - epoch_us("__first")) / F.lit(freq_seconds(step) * 1_000_000)).cast("long")
    det = base.select(*keys, *extra, "__n", (pos % P).alias("phase"), *cols)
    if extra:
        det = det.filter("__home")
    ph = det.groupBy(*keys, "phase").agg(F.first("__n").alias("n"),
                                         *[F.avg(f"__d_{f}").alias(f"__m_{f}") for f in features])
    wk = Window.partitionBy(*keys)                      # one row per phase
    return ph.select(*keys, "phase", "n",
                     *[(F.col(f"__m_{f}") - F.avg(f"__m_{f}").over(wk)).alias(f) for f in features])


def seasonal_profile(hist: DataFrame, keys, features: Sequence[str], period: int,
                     ts: str = "ts", step="D") -> DataFrame:
    """Additive seasonal component per series, feature and phase.

    Returns ``(keys…, phase, n, <f>…)`` for series with n > 2·period and no
    missing stamp; a feature with a NULL has NULL components (see
    ``seasonality_notices``).  Matches a classical decomposition: centred
    moving average (half weights at both ends for an even period), detrend,
    mean per phase, subtract the mean of the phase means.  A row's phase is
    its distance from the first stamp in steps.
    """
    keys = _keys(keys)
    st = history_state(hist, keys, features, period, ts, step).filter((F.col("__n") > 2 * int(period)) & ~F.col("__gap"))
    base = hist.select(*keys, ts, *features).join(st, keys)
    return _profile(base, keys, features, period, ts, step, keys)


def seasonal_profile_chunked(hist: DataFrame, keys, features: Sequence[str], period: int,
                             ts: str = "ts", step="D", chunk="400D") -> DataFrame:
    """``seasonal_profile`` with windows over (series, time chunk), for
    long series on a regular grid.

    Each chunk carries a halo of P/2 + 1 rows on both sides.  Running sums
    restart in every chunk, but the moving average only uses differences of
    running sums inside chunk + halo, so the offsets cancel; the phase means
    stay a partial aggregate.  Same rows as the per-series version.
    """
    from tempora.operators.windows import with_halo
    keys = _keys(keys)
    h = int(period) // 2
    st = history_state(hist, keys, features, period, ts, step).filter((F.col("__n") > 2 * int(period)) & ~F.col("__gap"))
    base = hist.select(*keys, ts, *features).join(st, keys)
    halo = with_halo(base, keys, ts, chunk, step, h + 1, h + 1)
    return _profile(halo, keys, features, period, ts, step, [*keys, "__chunk"])


def _trend_expr(rule: TrendRule | None, last: Column, t: Column) -> Column:
    kind = (rule.type if rule else "constant").lower()
    if kind == "linear":
        return last + t * F.lit(float(rule.slope))
    if kind == "exponential":
        return last * F.pow(F.lit(1.0 + float(rule.growth_rate)), t)
    if kind == "polynomial":
        coeffs = F.array(*[F.lit(float(c)) for c in rule.coeffs])
        return last + horner(coeffs, t)
    return last


def project(hist: DataFrame, keys, features: Sequence[str], years: int = 20,
            rules: Sequence[TrendRule] = (), freq="h", ts: str = "ts",
            scenarios: Sequence[str] | None = None, include_history: bool = True,
            materialize_history: bool = True, chunk=None) -> DataFrame:
    """X1–X9 (+U1, P12): history followed by ``years`` of projected rows.

    Output ``(keys…, scenario, ts, <features>…, is_projected)``.  Future
    calendar: start = last + freq, end = start + years − freq.  Time factor
    t_k = k·years/(periods−1).  Unlisted features are constant with
    seasonality.  A series with missing stamps, or a feature with a NULL, is
    projected without seasonality (``seasonality_notices`` lists them).
    ``chunk`` (e.g. "400D", at least half a period) computes the seasonal
    profile over time chunks instead of whole series.
    """
    keys = _keys(keys)
    if int(years) < 1:
        raise ValueError("years must be at least 1")
    if materialize_history:
        # three branches read the history (last values, seasonal profile,
        # history rows): compute it once
        from tempora.session import materialize
        hist = materialize(hist.select(*keys, ts, *features), "history")
    step = freq_seconds(freq)
    P = season_period(step)
    rules = list(rules)
    scen = list(scenarios or sorted({r.scenario for r in rules}) or ["base"])
    by = {(r.scenario, r.feature): r for r in rules}

    last = hist.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.min(ts).alias("__first_ts"), F.max(ts).alias("__last_ts"),
        *[F.max_by(f, ts).alias(f"__last_{f}") for f in features])
    start = ts_plus_seconds(F.col("__last_ts"), F.lit(step))
    end = ts_plus_seconds(F.timestamp_add("YEAR", F.lit(int(years)), start), F.lit(-step))
    periods = (F.floor((epoch_us(end) - epoch_us(start)) / F.lit(step * 1_000_000)) + 1).cast("long")
    whole = F.col("__n") == (epoch_us("__last_ts") - epoch_us("__first_ts")) / F.lit(step * 1_000_000) + 1
    ks = last.select("*", start.alias("__start"), periods.alias("__periods"), whole.alias("__whole"))

    prof = (seasonal_profile(hist, keys, features, P, ts, step) if chunk is None
            else seasonal_profile_chunked(hist, keys, features, P, ts, step, chunk))
    seasonal = prof.join(ks, keys).select(
        *keys, *[F.col(f).alias(f"__s_{f}") for f in features], *[c for c in ks.columns if c not in keys],
        F.pmod(F.col("phase") - F.col("__n"), F.lit(P)).alias("__k0"))
    seasonal = seasonal.select("*", F.explode(
        F.when(F.col("__k0") <= F.col("__periods") - 1,
               F.sequence(F.col("__k0"), F.col("__periods") - 1, F.lit(P).cast("long")))
         .otherwise(F.array().cast("array<long>"))).alias("__k")).drop("__k0")
    plain = ks.filter((F.col("__n") <= 2 * P) | ~F.col("__whole")).select(
        *keys, *[F.lit(None).cast("double").alias(f"__s_{f}") for f in features],
        *[c for c in ks.columns if c not in keys],
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("__periods") - 1)).alias("__k"))
    fut = seasonal.unionByName(plain)

    t = F.when(F.col("__periods") > 1,
               F.col("__k").cast("double") * F.lit(float(years)) / (F.col("__periods") - 1).cast("double")) \
         .otherwise(F.lit(0.0))
    fut = fut.select("*", F.explode(F.array(*[F.lit(s) for s in scen])).alias("scenario"), t.alias("__t"))
    vals = []
    for f in features:
        branches = None
        for s in scen:
            r = by.get((s, f))
            e = _trend_expr(r, F.col(f"__last_{f}"), F.col("__t"))
            if r is None or r.add_seasonality:
                e = e + F.coalesce(F.col(f"__s_{f}"), F.lit(0.0))
            branches = F.when(F.col("scenario") == s, e) if branches is None else branches.when(F.col("scenario") == s, e)
        vals.append(branches.alias(f))
    future = fut.select(*keys, "scenario", ts_plus_seconds(F.col("__start"), F.col("__k") * F.lit(step)).alias(ts),
                        *vals, F.lit(True).alias("is_projected"))
    if not include_history:
        return future
    past = hist.select(*keys, F.explode(F.array(*[F.lit(s) for s in scen])).alias("scenario"), ts,
                       *features, F.lit(False).alias("is_projected"))
    return past.unionByName(future)


# ---------------------------------------------------------------------------
# scoring (X10)
# ---------------------------------------------------------------------------
class LinearScorer:
    """Row-wise linear scorer y = a + b·x fitted by least squares.

    The fit is one global aggregate returning two numbers, which are then
    inlined as literals: scoring is a pure projection (no join), and
    iterative callers (the intervention rollout) never recompute the fit.
    """

    def __init__(self, intercept: float, slope: float, feature: str, out: str):
        self.intercept, self.slope, self.feature, self.out = intercept, slope, feature, out

    @classmethod
    def fit(cls, df: DataFrame, target: str, feature: str, out: str | None = None) -> "LinearScorer":
        r = df.agg(F.regr_intercept(target, feature).alias("a"), F.regr_slope(target, feature).alias("b")).first()
        return cls(r["a"], r["b"], feature, out or target)

    def transform(self, df: DataFrame) -> DataFrame:
        pred = F.lit(self.intercept) + F.lit(self.slope) * F.col(self.feature)
        cols = [c for c in df.columns if c != self.out]
        return df.select(*cols, pred.alias(self.out))

    __call__ = transform


def score(df: DataFrame, scorer, clamp: bool = False, out: str = "prediction") -> DataFrame:
    """Apply a scorer (LinearScorer, MLlib model wrapper or callable);
    ``clamp`` floors at 0 (single/batch scoring only, P6)."""
    res = scorer(df) if callable(scorer) and not hasattr(scorer, "transform") else scorer.transform(df)
    if clamp:
        res = res.withColumn(out, F.greatest(F.col(out), F.lit(0.0)))
    return res


def scenario_table(hist: DataFrame, keys, features: Sequence[str], target: str, scorer,
                   years: int = 20, rules: Sequence[TrendRule] = (), freq="h", ts: str = "ts",
                   scenarios: Sequence[str] | None = None) -> DataFrame:
    """Project features, then replace the target of history *and*
    future with the model output (no clamp, no rounding)."""
    proj = project(hist.select(*_keys(keys), ts, *features), keys, features, years, rules, freq, ts, scenarios)
    return score(proj, scorer) if not isinstance(scorer, LinearScorer) else scorer.transform(proj)


ScorerFn = Callable[[DataFrame], DataFrame]
