"""p-value helper against numeric integration, and the trend p-value query."""

import math

import numpy as np
import pytest

from tempora.functions.stats import betainc_reg, t_two_sided_p


def _t_tail_numeric(t, dof):
    x = np.linspace(abs(t), abs(t) + 400.0, 400001)
    c = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)
    pdf = c * (1 + x * x / dof) ** (-(dof + 1) / 2)
    return 2 * np.trapezoid(pdf, x)


@pytest.mark.parametrize("t,dof", [(2.228, 10), (0.5, 3), (1.0, 30), (3.5, 7), (-2.0, 15)])
def test_t_pvalue_matches_integration(t, dof):
    assert abs(t_two_sided_p(t, dof) - _t_tail_numeric(t, dof)) < 1e-5


def test_known_values():
    assert abs(t_two_sided_p(2.228, 10) - 0.05) < 1e-3
    assert t_two_sided_p(0.0, 5) == pytest.approx(1.0)
    assert betainc_reg(1.0, 1.0, 0.3) == pytest.approx(0.3)


def test_trend_pvalues_query(spark):
    from pyspark.sql import functions as F
    from tempora.operators import profile
    rng = np.random.default_rng(0)
    from datetime import datetime, timedelta
    rows = [(0, datetime(2024, 1, 1) + timedelta(days=i), float(0.5 * i + rng.normal(0, 5)), 3.0, float(rng.normal()))
            for i in range(60)]
    df = spark.createDataFrame(rows, "series_id long, ts timestamp_ntz, up double, flat double, noise double")
    res = {r.feature: r for r in profile.linear_trend_pvalues(df, ["series_id"], "ts", ["up", "flat", "noise"]).collect()}
    assert res["up"].p_value < 1e-6 and res["flat"].p_value == 1.0 and 0 < res["noise"].p_value <= 1
    # slope t statistic agrees with numpy least squares
    x = np.arange(60.0)
    y = np.array([r[4] for r in rows])
    b, a = np.polyfit(x, y, 1)
    resid = y - (a + b * x)
    se = math.sqrt(resid @ resid / 58 / ((x - x.mean()) @ (x - x.mean())))
    assert res["noise"].t_stat == pytest.approx(b / se, rel=1e-9)
    assert res["noise"].p_value == pytest.approx(_t_tail_numeric(b / se, 58), abs=1e-5)
