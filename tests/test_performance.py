"""The performance report on small and odd curves against pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from saltern.operators import performance as pf

DAY = dt.date(2020, 1, 1)


def curve(spark, values, key=1, start=0):
    rows = [(key, k, DAY + dt.timedelta(3 * k), v, None if v is None else v / 2) for k, v in enumerate(values, start)]
    return spark.createDataFrame(rows, "id long, n long, day date, v double, held double")


def report(spark, df, trades=None, **more):
    return {r.id: r for r in pf.performance(pf.daily(df, "id", "n", "day", "v", "held"), trades, "id", 100.0, 252.0, **more).collect()}


def test_equals_pandas(spark):
    rng = np.random.default_rng(7)
    v = pd.Series(100 * np.exp(np.cumsum(rng.normal(0, 0.02, 250))))
    r = report(spark, curve(spark, v.tolist()), risk_free=0.05)[1]
    ret, rf = v.pct_change().dropna(), 1.05 ** (1 / 252) - 1
    dd = v / v.cummax() - 1
    down = np.sqrt(np.mean(np.minimum(ret - rf, 0) ** 2)) * np.sqrt(252)
    cagr = (v.iloc[-1] / 100) ** (365.25 / (3 * 249)) - 1
    want = {
        "ending_equity": v.iloc[-1], "cagr": cagr, "sharpe": (ret.mean() - rf) / ret.std() * np.sqrt(252), "sortino": (ret - rf).mean() * 252 / down, "downside_deviation": down, "max_drawdown": dd.min(), "calmar": cagr / abs(dd.min()),
        "recovery_factor": (v.iloc[-1] - 100) / (v.cummax() - v).max(), "var_95": ret.quantile(0.05), "cvar_95": ret[ret <= ret.quantile(0.05)].mean(), "skewness": ret.skew(), "excess_kurtosis": ret.kurt(), "positive_day_fraction": (ret > 0).mean(),
        "average_exposure": 0.5, "max_exposure": 0.5, "high_water_mark": v.max(), "annualized_volatility": ret.std() * np.sqrt(252),
    }
    for c, x in want.items():
        assert abs(r[c] - x) < 1e-9 * max(1, abs(x)), c
    longest = now = 0
    for under in (v < v.cummax() * (1 - 1e-12)).tolist():
        now = now + 1 if under else 0
        longest = max(longest, now)
    assert r.max_drawdown_duration_sessions == longest and r.max_drawdown_duration_days == 3 * longest
    assert r.trades == 0 and r.win_rate is None and r.total_fees == 0 and r.turnover_multiple == 0


def test_odd_curves(spark):
    one = curve(spark, [120.0])
    bust = curve(spark, [100.0, 0.0, 0.0, 5.0], 2)
    holes = curve(spark, [100.0, None, -5.0, float("nan"), 110.0], 3)
    flat = curve(spark, [50.0] * 4, 4)
    twice = spark.createDataFrame([(5, 1, DAY, 90.0, 0.0), (5, 2, DAY, 95.0, 0.0), (5, 3, DAY + dt.timedelta(1), 100.0, None)], one.schema)
    df = one.union(bust).union(holes).union(flat).union(twice)
    trades = spark.createDataFrame([(1, 10.0, 0.1, 1.0, 100.0, 110.0), (1, -5.0, -0.05, None, 100.0, None), (1, None, None, 1.0, None, 5.0), (4, 3.0, 0.3, 0.0, 10.0, 13.0)], "id long, net_pnl double, net_return double, total_fees double, entry_trade_value double, exit_trade_value double")
    r = report(spark, df, trades)
    assert r[1].ending_equity == 120 and r[1].sharpe == 0 and r[1].sortino is None and r[1].var_95 is None and r[1].max_drawdown == 0 and r[1].calmar is None
    assert (r[1].trades, r[1].win_rate, r[1].payoff_ratio, r[1].profit_factor, r[1].total_fees, r[1].turnover) == (3, 0.5, 2.0, 2.0, 2.0, 315.0)
    assert r[2].max_drawdown == -1 and r[2].worst_day_return == -1 and r[2].max_drawdown_duration_sessions == 3 and r[2].cagr < -0.99
    assert r[3].best_day_return == pytest.approx(0.1) and r[3].total_return == pytest.approx(0.1)
    assert r[4].annualized_volatility == 0 and r[4].sharpe == 0 and r[4].profit_factor is None and r[4].win_rate == 1 and r[4].skewness is None
    assert r[5].best_day_return == pytest.approx(100 / 95 - 1) and r[5].average_exposure == 0
    assert report(spark, df.where("false")) == {}
    with pytest.raises(ValueError):
        report(spark, df, risk_free=-1.0)


def test_pairs(spark):
    a = curve(spark, [100.0, 79.0, 85.0, 70.0, 100.0], 1)
    b = curve(spark, [100.0, 95.0, 70.0, 60.0, 89.0], 2)
    c = curve(spark, [10.0, 10.0], 3)
    rows = {(r.strategy_a, r.strategy_b): r for r in pf.pair_diagnostics(pf.daily(a.union(b).union(c), "id", "n", "day", "v")).collect()}
    r = rows[1, 2]
    assert set(rows) == {(1, 2), (1, 3), (2, 3)} and r.aligned_days == 4
    x, y = pd.Series([100, 79, 85, 70, 100.0]).pct_change(), pd.Series([100, 95, 70, 60, 89.0]).pct_change()
    assert abs(r.daily_return_corr - x.corr(y)) < 1e-12
    assert (r.both_under_10pct_fraction, r.either_under_10pct_fraction, r.both_under_20pct_fraction, r.either_under_20pct_fraction) == (0.5, 1.0, 0.25, 0.75)
    assert rows[1, 3].aligned_days == 1 and rows[1, 3].daily_return_corr is None
