"""Period joins and rolling pair sums against plain loops."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from saltern.operators.aggregates import exact_quantiles
from saltern.operators import features as ft
from saltern.operators import temporal as tp

DAY = dt.date


@pytest.mark.parametrize("most", [1 << 18, 3])
def test_interval_join(spark, monkeypatch, most):
    monkeypatch.setattr(tp, "MOST_BROADCAST", most)
    periods = [("a", DAY(2020, 1, 5), DAY(2020, 3, 5)), ("b", DAY(2020, 3, 5), DAY(2020, 3, 20)), ("e", DAY(2020, 4, 1), DAY(2020, 4, 1)), ("n", None, DAY(2019, 1, 1)), ("c", DAY(2020, 5, 1), None)]
    days = [(k, x) for k, x in enumerate([None, DAY(1990, 1, 1), DAY(2020, 1, 4), DAY(2020, 1, 5), DAY(2020, 2, 1), DAY(2020, 3, 5), DAY(2020, 3, 20), DAY(2020, 4, 1), DAY(2020, 5, 1), DAY(2099, 1, 1), DAY(2020, 2, 1)])]
    p = spark.createDataFrame(periods, "name string, s date, u date")
    got = {r["k"]: r["name"] for r in tp.interval_join(spark.createDataFrame(days, "k int, day date"), p, "day", "s", "u").collect()}
    want = {k: next((n for n, s, u in periods if x and s and x >= s and (u is None or x < u)), None) for k, x in days}
    assert got == want
    none = tp.interval_join(spark.createDataFrame(days, "k int, day date"), p.limit(0), "day", "s", "u").collect()
    assert len(none) == len(days) and {r["name"] for r in none} == {None}


def test_session_lookup(spark):
    sessions = [(DAY(2020, 1, 6), 0), (DAY(2020, 1, 9), 1), (DAY(2020, 6, 2), 2)]
    days = [None, DAY(1980, 1, 1), DAY(2020, 1, 6), DAY(2020, 1, 7), DAY(2020, 2, 1), DAY(2020, 6, 2), DAY(2020, 6, 3), DAY(2031, 1, 1)]
    got = {r["day"]: r["session"] for r in tp.session_lookup(spark.createDataFrame([(d,) for d in days], "day date"), spark.createDataFrame(sessions, "date date, session int"), "day").collect()}
    assert got == {d: next((s for x, s in sessions if d and x >= d), None) for d in days}


def test_pair_features(spark):
    rng = np.random.default_rng(3)
    rows = []
    for key in (1, 2):
        for i in range(80):
            x, m = (float(1000 * key + v) for v in rng.normal(size=2))
            x = None if rng.random() < 0.1 else math.inf if i == 20 else 7.0 if 40 <= i < 60 else x
            rows.append((key, i, x, None if rng.random() < 0.1 else m))
    p = spark.createDataFrame(rows, "id int, session int, x double, m double")
    q = ft.beta_population(ft.correlation_sample(p, "x", "m", 10, 4), "x", "m", 10, 4)
    got = {(r["id"], r["session"]): r for r in q.collect()}
    assert q.columns == ["id", "session", "x", "m", "pair_corr_10", "pair_beta_10", "beta_10"]
    for key, i, *_ in rows:
        last = [(x, m) for k, j, x, m in rows if k == key and i - 10 < j <= i]
        own = [m for _, m in last if m is not None]
        a = np.array([(x, m) for x, m in last if x is not None and m is not None and math.isfinite(x)]).reshape(-1, 2)
        r = got[key, i]
        if len(a) < 4:
            assert r["pair_corr_10"] is r["pair_beta_10"] is r["beta_10"] is None
            continue
        c = np.cov(a.T)
        if c[0, 0] == 0:
            assert r["pair_corr_10"] is None
        else:
            assert r["pair_corr_10"] == pytest.approx(np.corrcoef(a.T)[0, 1], abs=1e-7)
        assert r["pair_beta_10"] == pytest.approx(c[0, 1] / np.var(own, ddof=1), abs=1e-7)
        assert r["beta_10"] == pytest.approx(c[0, 1] / c[1, 1], abs=1e-7)
    empty = ft.lead_lag(p.where(F.lit(False)), "x", "m", 1, 10, 4)
    assert empty.collect() == []


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_exact_quantiles_equal_numpy(spark, ranges):
    rng = np.random.default_rng(4)
    values = [*rng.normal(size=301).tolist(), *[0.5] * 400, *np.round(rng.normal(size=200), 1).tolist()]
    shares = [0.0, 0.01, 0.5, 0.77, 0.99, 1.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 30, "x double")
    assert np.allclose(exact_quantiles(df, "x", shares, ranges), np.quantile(values, shares), rtol=0, atol=1e-12)
    assert exact_quantiles(df.where("x is null"), "x", shares, ranges) == [None] * 6
    assert exact_quantiles(df.where("x = 0.5"), "x", shares, ranges) == [0.5] * 6


def test_a_profile_holds_no_column_in_one_task(spark):
    from saltern.plans.research_queries import numeric_profile

    plan = numeric_profile(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
