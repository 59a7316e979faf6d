"""Threshold-triggered interventions rolled out over projected
series, for every series and scenario at once.

Rollout
-------
Year windows start every Jan 1 at the time of day of the first projected
row; the leading partial year is never tested, the trailing partial year
is.  A year whose mean prediction is strictly below the threshold gets an
event at its window start; an event lifts the two flow features of every
later row (lift split by steam share, decayed by the feature's trend rule,
floored at 0) and the target is re-predicted.

Scoring is row-wise and an event only touches rows at or after it, so the
mean of year y depends only on events of earlier years.  The driver loop
therefore walks the (≤ 41) year windows in order and scores *only that
year's rows* under the events found so far; the projected table is
written once, partitioned by year, so every step prunes to one partition.
State is a tiny events table, checkpointed each step to cut lineage.
Total work ≈ two scoring passes instead of one full re-score per event.
"""

from __future__ import annotations

import uuid
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.calendar import whole_days
from tempora.operators.repair import _keys
from tempora.session import checkpoint_dir
from tempora.spec import DAYS_PER_YEAR, InterventionRule, TrendRule

_YEAR = "__year"


def year_windows(df: DataFrame, keys, ts: str = "ts", first: str | None = None) -> DataFrame:
    """X11 calendar: adds ``__year`` (window start year) and
    ``window_start`` (Jan 1 of that year at the first row's time of day);
    rows of the leading partial year get NULLs."""
    keys = _keys(keys)
    if first is None:
        stamp, names = "__first_stamp", df.columns
        starts = df.groupBy(*keys).agg(F.min(ts).alias(stamp))     # partial: no series is gathered
        return year_windows(df.join(starts, keys), keys, ts, stamp).select(*names, _YEAR, "window_start")
    first = F.col(first)
    tod_s = F.timestamp_diff("MICROSECOND", F.to_date(first).cast("timestamp_ntz"), first) / F.lit(1e6)
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), tod_s.cast("decimal(18,6)"))
    yr = F.year(F.col(ts) - shift)
    start = F.make_date(yr, F.lit(1), F.lit(1)).cast("timestamp_ntz") + shift
    staged = df.select("*", first.alias("__first"), yr.alias("__y"), start.alias("__ws"))
    ok = F.col("__ws") >= F.col("__first")
    return staged.select(*df.columns, F.when(ok, F.col("__y")).alias(_YEAR),
                         F.when(ok, F.col("__ws")).alias("window_start"))


def _decay(rule: TrendRule | None, first_value: Column, years_from: Column) -> Column:
    kind = (rule.type if rule else "constant").lower()
    if kind == "exponential":
        return F.pow(F.lit(1.0 + float(rule.growth_rate)), years_from)
    if kind == "linear":
        pct = F.when(first_value != 0, F.lit(float(rule.slope)) / first_value).otherwise(F.lit(0.0))
        return F.pow(F.lit(1.0) + pct, years_from)
    return F.lit(1.0)


def _by_scenario(scenarios: Sequence[str], make: Callable[[str], Column]) -> Column:
    e = None
    for s in scenarios:
        e = F.when(F.col("scenario") == s, make(s)) if e is None else e.when(F.col("scenario") == s, make(s))
    return e


def apply_lifts(df: DataFrame, events: DataFrame, keys, ts: str, brine: str, steam: str,
                rules: Sequence[TrendRule], interventions: Sequence[InterventionRule],
                scenarios: Sequence[str]) -> DataFrame:
    """Add the decayed lifts of all earlier-or-same events.

    ``events`` is ``(keys…, scenario, drill_ts)``; per series/scenario it
    holds at most one event per year (≤ 41), so it is collapsed to one
    bounded array per series/scenario and joined on equality keys — the
    range condition ``ts ≥ drill_ts`` is evaluated inside the array, never
    as a non-equi join.  Requires ``__first_<feature>`` columns (first
    projected value, used by linear decay).
    """
    keys = _keys(keys)
    by_rule = {(r.scenario, r.feature): r for r in rules}
    by_int = {r.scenario: r for r in interventions}
    ev = events.groupBy(*keys, "scenario").agg(F.collect_list("drill_ts").alias("__events"))
    j = df.join(ev, [*keys, "scenario"], "left")
    out = []
    for feat, share in ((brine, "brine"), (steam, "steam")):
        def lift(s, feat=feat, share=share):
            ir = by_int.get(s, InterventionRule(scenario=s))
            delta = ir.delta_brine if share == "brine" else ir.delta_steam
            rule = by_rule.get((s, feat))
            first_v = F.col(f"__first_{feat}")
            return F.aggregate(
                F.filter(F.coalesce(F.col("__events"), F.array().cast("array<timestamp_ntz>")), lambda e: e <= F.col(ts)),
                F.lit(0.0),
                lambda acc, e: acc + F.greatest(F.lit(0.0), F.lit(float(delta)) * _decay(
                    rule, first_v, whole_days(e, F.col(ts)).cast("double") / F.lit(DAYS_PER_YEAR))))
        out.append((feat, _by_scenario(scenarios, lift)))
    lifted = {f: (F.col(f) + e) for f, e in out}
    return j.select(*[lifted[c].alias(c) if c in lifted else F.col(c) for c in df.columns])


def rollout(future: DataFrame, keys, scorer: Callable[[DataFrame], DataFrame], target: str,
            brine: str, steam: str, rules: Sequence[TrendRule] = (),
            interventions: Sequence[InterventionRule] = (InterventionRule(),),
            ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Iterated rollout.  ``future`` is ``(keys…, scenario, ts,
    features…)`` (projected rows only); ``scorer`` maps features to a
    ``target`` column.  Returns (adjusted rows with the adjusted features
    and prediction, events ``(keys…, scenario, drill_ts, year)``)."""
    keys = _keys(keys)
    spark = future.sparkSession
    scenarios = sorted({r.scenario for r in interventions})
    by_int = {r.scenario: r for r in interventions}
    gk = [*keys, "scenario"]
    # first values and stamp per series and scenario: partial aggregates, and a
    # join with one row per group, so the projected rows are never sorted
    firsts = future.groupBy(*gk).agg(F.min(ts).alias("__first_ts"), F.min_by(brine, ts).alias(f"__first_{brine}"),
                                     F.min_by(steam, ts).alias(f"__first_{steam}"))
    base = year_windows(future.join(firsts, gk), gk, ts, "__first_ts")
    base = base.withColumn(_YEAR, F.coalesce(F.col(_YEAR), F.lit(-1)))
    # one materialisation of the projected rows, partitioned by window year
    root = checkpoint_dir(spark).rstrip("/")
    path = f"{root}/tempora-rollout-{uuid.uuid4().hex}"
    base.write.mode("overwrite").partitionBy(_YEAR).parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    years = [r[0] for r in rows.select(_YEAR).distinct().filter(F.col(_YEAR) >= 0).orderBy(_YEAR).collect()]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in future.schema.fields if f.name in keys)
    events = spark.createDataFrame([], f"{schema + ', ' if schema else ''}scenario string, drill_ts timestamp_ntz, year int")
    thr = _by_scenario(scenarios, lambda s: F.lit(float(by_int[s].threshold)))
    for i, y in enumerate(years):
        part = rows.filter(F.col(_YEAR) == y)
        scored = scorer(apply_lifts(part, events, keys, ts, brine, steam, rules, interventions, scenarios))
        means = scored.groupBy(*gk).agg(F.avg(target).alias("__mean"), F.first("window_start").alias("drill_ts"))
        new = means.filter(F.col("__mean") < thr).select(*gk, "drill_ts", F.lit(y).alias("year"))
        events = events.unionByName(new)
        events.write.mode("overwrite").parquet(f"{path}/events_{i}")
        events = spark.read.parquet(f"{path}/events_{i}")
    adjusted = scorer(apply_lifts(rows, events, keys, ts, brine, steam, rules, interventions, scenarios))
    drop = [c for c in adjusted.columns if c.startswith("__first_") or c in (_YEAR, "window_start")]
    return adjusted.drop(*drop), events


def result_table(scored: DataFrame, adjusted: DataFrame, keys, ts: str, features: Sequence[str],
                 target: str) -> DataFrame:
    """History + future with original and adjusted features and the
    target without and with interventions (history rows are unchanged)."""
    keys = _keys(keys)
    gk = [*keys, "scenario", ts]
    adj = adjusted.select(*gk, *[F.col(f).alias(f"{f}_adjusted") for f in features],
                          F.col(target).alias(f"{target}_with_intervention"))
    j = scored.join(adj, gk, "left")
    return j.select(*gk, *features,
                    *[F.coalesce(F.col(f"{f}_adjusted"), F.col(f)).alias(f"{f}_adjusted") for f in features],
                    F.col(target).alias(f"{target}_no_intervention"),
                    F.coalesce(F.col(f"{target}_with_intervention"), F.col(target)).alias(f"{target}_with_intervention"),
                    "is_projected")


def event_counts(events: DataFrame, keys) -> DataFrame:
    """Number of interventions per series and scenario."""
    keys = _keys(keys)
    return events.groupBy(*keys, "scenario").agg(F.count(F.lit(1)).alias("interventions"))
