"""Plan shape: no window below a single partition, filters and projections
reach the Parquet scan, one shuffle for the back-test."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fixture_paths import SF0001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _nodes(node):
    """All physical nodes, through adaptive plans and query stages."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _nodes(node.initialPlan())
        return
    yield node
    children = node.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def gathered_windows(df):
    """Windows whose input is one partition: down to the next exchange, that
    exchange deals everything to a single task."""
    found = []
    for node in _nodes(df._jdf.queryExecution().executedPlan()):
        if not node.getClass().getSimpleName().startswith("Window"):
            continue
        below = node
        while below.children().size() == 1 and "Exchange" not in below.getClass().getSimpleName():
            below = below.children().apply(0)
        if "Exchange" in below.getClass().getSimpleName() and "SinglePartition" in below.outputPartitioning().toString():
            found.append(node.simpleString(200))
    return found


def test_the_guard_sees_unpartitioned_windows(spark):
    """Negative control: without a key, and with a constant key."""
    df = spark.range(10)
    for w in (Window.orderBy("id"), Window.partitionBy(F.lit(1)).orderBy("id")):
        assert gathered_windows(df.select(F.row_number().over(w).alias("n")))
    keyed = Window.partitionBy((F.col("id") % 3).alias("k")).orderBy("id")
    assert not gathered_windows(df.select(F.row_number().over(keyed).alias("n")))


def test_no_window_over_a_single_partition(spark, monkeypatch):
    from tempora.operators import model
    from tempora.plans.catalog import QUERIES
    # a plan does not depend on the number of trees; two keep the fits short
    monkeypatch.setitem(model.REGRESSOR_PARAMS, "num_trees", 2)
    monkeypatch.setitem(model.NEXTDAY_PARAMS, "num_trees", 2)
    bad = {name: found for name, fn in QUERIES.items() if (found := gathered_windows(fn(spark, SF0001)))}
    assert not bad


def test_filter_and_columns_pushed_to_scan(spark):
    from __spark_entry__ import queries
    df = queries()["time_range_filter"](spark, SF0001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan).group(1)
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed
    m = re.search(r"ReadSchema: struct<([^>]*)>", plan)
    assert m and "props" not in m.group(1) and "event_id" not in m.group(1)


def test_backtest_single_key_shuffle(spark):
    """Grid, fills, day statistics, baselines and the per-method aggregate
    all run on one hash partitioning by series (two exchanges in total:
    hourly aggregate, then series key)."""
    from __spark_entry__ import queries
    plan = _plan(queries()["baseline_comparison"](spark, SF0001))
    assert plan.count("Exchange hashpartitioning") == 2, plan


def test_cluster_needs_a_shared_folder():
    from tempora import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Cluster:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Cluster())
    assert session.is_local("local") and session.is_local("local[4]") and not session.is_local("local-cluster[2,1,1024]")
