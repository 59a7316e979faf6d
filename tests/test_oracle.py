"""Every registered query with a SQL oracle returns the same rows as DuckDB."""

import pytest

from fixture_paths import SF0001

pytest.importorskip("duckdb")


def test_all_queries_match_duckdb(spark):
    from __spark_entry__ import oracle_sql
    from tools.oracle_check import compare
    res = compare(spark, SF0001, list(oracle_sql()))
    bad = {k: v for k, v in res.items() if "error" in v or (v.get("oracle", 1) is not None and not v.get("ok"))}
    assert not bad, bad


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() > 0
    assert [f.name for f in df.schema.fields] == ["series_id", "method", "rmse", "mae", "n", "rank"]


def test_results_do_not_depend_on_session_zone(spark):
    """Operators use zone-free NTZ arithmetic: a DST zone gives the same rows."""
    from tools.oracle_check import compare
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        res = compare(spark, SF0001, ["hourly_mean_pivot", "calendar_parts", "quarter_mean", "year_window_means",
                                      "naive_backtest"])
        assert spark.conf.get("spark.sql.session.timeZone") == "America/Los_Angeles"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert all(v.get("ok") for v in res.values()), res
