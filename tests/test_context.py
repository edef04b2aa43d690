"""Sector and market context against brute force; streaks against a loop."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from saltern.operators import context
from saltern.operators import features as ft

SECTORS = ["b", "a", "c"]
PANEL = "id string, session long, return_1 double, return_5 double, market_return_1 double, market_return_5 double"


def fixture(seed=5, sessions=90):
    rng = random.Random(seed)
    base = [(s, k, rng.gauss(0, 0.02), rng.gauss(0, 0.05)) for s in range(sessions) for k in ("a", "b", "c")]
    base = [(s, k, None if (s + len(k)) % 31 == 0 else x, y) for s, k, x, y in base if not (k == "c" and s % 17 == 3)]
    by = {(s, k): (x, y) for s, k, x, y in base}
    rows = []
    for name, near in (("u", "a"), ("v", "c"), ("none", None)):
        for s in range(sessions):
            if name == "v" and s % 13 == 5:
                continue  # sessions without a row
            x = (by.get((s, near)) or (None,))[0]
            x = rng.gauss(0, 0.01) + (x or 0.0)
            rows.append((name, s, None if s % 19 == 4 else x, rng.gauss(0, 0.03), rng.gauss(0, 0.01), rng.gauss(0, 0.02)))
    rows.append(("alone", 3, 0.1, None, None, 0.1))
    return rows, base


def brute(rows, base, short, long, lags):
    """Row by row with pandas' own correlation of each window."""
    by = {(s, k): (x, y) for s, k, x, y in base}
    out = {}
    num = lambda v: float("nan") if v is None else v
    for name in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == name), key=lambda r: r[1])
        x = pd.Series([num(r[2]) for r in own])
        stats = {}
        for k in sorted(SECTORS):
            y = pd.Series([num(by.get((r[1], k), (None, None))[0]) for r in own], dtype=float)
            beta = lambda w: x.rolling(w[0], min_periods=w[1]).cov(y) / y.rolling(w[0], min_periods=w[1]).var()
            corr = lambda w, z: x.rolling(w[0], min_periods=w[1]).corr(z)
            stats[k] = [t.shift(1) for t in (corr(long, y), corr(short, y), beta(short), beta(long), *[corr(short, y.shift(g)) for g in lags])]
        for i, r in enumerate(own):
            known = sorted(((-round(stats[k][0][i], 9), k) for k in stats if not math.isnan(stats[k][0][i])))
            if not known or known[0][0] >= 0:
                out[name, r[1]] = None
                continue
            k = known[0][1]
            long_c, short_c, b_short, b_long, *lead = [t[i] for t in stats[k]]
            r1, r5 = by.get((r[1], k), (None, None))
            same = [v[0] for kk in SECTORS if (v := by.get((r[1], kk))) and v[0] is not None]
            strength = None if r1 is None else (sum(v < r1 for v in same) + (sum(v == r1 for v in same) + 1) / 2) / len(same)
            minus = lambda a, b: None if a is None or b is None else a - b
            margin = long_c + known[1][0] if len(known) > 1 else None
            out[name, r[1]] = {
                "sector": k, "corr_long": long_c, "corr_short": short_c, "beta_short": b_short, "beta_long": b_long, "margin": margin, "confident": bool(long_c >= 0.2), "distinct": margin is not None and bool(margin >= 0.05),
                "sector_return_1": r1, "sector_return_5": r5, "over_sector_1": minus(r[2], r1), "over_sector_5": minus(r[3], r5), "sector_over_market_1": minus(r1, r[4]), "strength_1": strength,
                "gap_long": None if r[2] is None or r1 is None else r[2] - b_long * r1, **{f"lead_corr_{g}": v for g, v in zip(lags, lead)},
            }
    return out


def test_sector_context_equals_brute_force(spark):
    rows, base = fixture()
    p = spark.createDataFrame(rows, PANEL).withColumns({"sector": F.lit("mine"), "_best": F.lit(1)})  # names that clash are left out
    b = spark.createDataFrame(base + [(4, "unasked", 9.0, 9.0)], "session long, sector string, return_1 double, return_5 double")
    short, long, lags = (20, 10), (40, 20), (1, 3)
    got = context.sector_context(p, b, SECTORS, (1, 5), short, long, lags).collect()
    want = brute(rows, base, short, long, lags)
    assert len(got) == len(rows) == len(want)
    chosen = 0
    for r in got:
        w = want[r.id, r.session]
        if w is None:
            assert r.sector is None and not r.confident and not r.distinct and r.sector_return_1 is None and r.margin is None
            continue
        chosen += 1
        for k, v in w.items():
            x = r[k]
            same = x is None if v is None or (isinstance(v, float) and math.isnan(v)) else x == v if isinstance(v, (str, bool)) else x is not None and abs(x - v) < 1e-7
            assert same, (r.id, r.session, k, x, v)
    assert chosen > 100


def test_sector_context_of_nothing(spark):
    p, b = spark.createDataFrame([], PANEL), spark.createDataFrame([], "session long, sector string, return_1 double, return_5 double")
    assert context.sector_context(p, b, SECTORS, (1, 5)).collect() == []
    one = spark.createDataFrame([("x", 0, 0.1, 0.1, 0.1, 0.1)], PANEL)
    (r,) = context.sector_context(one, b, ["a"], (1, 5)).collect()
    assert r.id == "x" and r.sector is None and r.confident is False


def test_equal_baskets_take_the_first_name(spark):
    rng = random.Random(1)
    xs = [rng.gauss(0, 1) for _ in range(60)]
    p = spark.createDataFrame([("x", s, x + rng.gauss(0, 0.1), 0.0, 0.0, 0.0) for s, x in enumerate(xs)], PANEL)
    b = spark.createDataFrame([(s, k, x, 0.0) for s, x in enumerate(xs) for k in ("d", "b", "c")], "session long, sector string, return_1 double, return_5 double")
    got = [r for r in context.sector_context(p, b, ["d", "c", "b"], (1, 5), (20, 10), (40, 20), (1,)).collect() if r.sector]
    assert len(got) == 39 or len(got) == 40
    assert {r.sector for r in got} == {"b"} and all(abs(r.margin) < 1e-9 and not r.distinct and r.confident for r in got)
    assert all(r.strength_1 == pytest.approx(2 / 3) for r in got)


def test_rows_are_not_multiplied_by_sectors(spark):
    p = spark.createDataFrame([(1, s, 0.01 * (s % 5)) for s in range(9)], "id long, session long, return_1 double")
    baskets = spark.createDataFrame([(s, k, 0.01 * (s % 3)) for s in range(9) for k in ("a", "b")], "session long, sector string, return_1 double")
    q = context.sector_context(p, baskets, ["a", "b"], (1,), (4, 2), (6, 3), (1,), market=None)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and q.count() == 9


def test_one_shuffle_for_the_rows(spark):
    """Rows meet by id once; what follows stays beside it."""
    rows, base = fixture(sessions=20)
    p = spark.createDataFrame(rows, PANEL).repartition(4, "id")
    b = spark.createDataFrame(base, "session long, sector string, return_1 double, return_5 double")
    plan = context.sector_context(p, b, SECTORS, (1, 5))._jdf.queryExecution().executedPlan().toString()
    by_id = [line for line in plan.splitlines() if "Exchange hashpartitioning(id" in line]
    assert len(by_id) == 1 and "CartesianProduct" not in plan and "BatchEvalPython" not in plan


@pytest.mark.parametrize("outlier", [None, 1e6])
def test_relations_forget_and_equal_pandas(spark, outlier):
    rng = random.Random(3)
    m = [rng.gauss(0, 0.01) for _ in range(160)]
    x = [0.6 * (m[s - 2] if s > 1 else 0) + rng.gauss(0, 0.01) for s in range(160)]
    if outlier:
        x[2] = outlier
    m[50] = x[70] = None
    df = spark.createDataFrame([("k", s, x[s], m[s]) for s in range(160)], "id string, session long, x double, m double")
    got = {r.session: r for r in context.lead_lag_relations(df, "x", "m", (0, 2), (1,), 40, 20).collect()}
    X, M = (pd.Series([float("nan") if v is None else v for v in s]) for s in (x, m))
    lead = X.rolling(40, min_periods=20).corr(M.shift(2))
    beta = X.rolling(40, min_periods=20).cov(M) / M.rolling(40, min_periods=20).var()
    if outlier:  # pandas' own running sums keep a trace, so each window is taken alone
        lead = pd.Series([X[s - 39 : s + 1].corr(M.shift(2)[s - 39 : s + 1]) if s >= 39 else float("nan") for s in range(160)])
        beta = pd.Series([X[s - 39 : s + 1].cov(M[s - 39 : s + 1]) / M[s - 39 : s + 1].var() if s >= 39 else float("nan") for s in range(160)])
    follow = pd.Series([X.shift(1)[max(s - 39, 0) : s + 1].corr(M[max(s - 39, 0) : s + 1]) for s in range(160)])
    for s in range(45, 160):
        r = got[s]
        assert r.corr_market_leads_2 == pytest.approx(lead[s], abs=1e-7) and r.beta_market_leads_0 == pytest.approx(beta[s], abs=1e-7) and r.corr_stock_leads_1 == pytest.approx(follow[s], abs=1e-7)
    assert got[5].corr_market_leads_0 is None and got[130].corr_market_leads_2 > 0.2


def test_response_uses_the_beta_known_before(spark):
    rng = random.Random(8)
    rows = [("k", s, None if s == 33 else rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 2), rng.gauss(0, 2)) for s in range(60)]
    df = spark.createDataFrame(rows, "id string, session long, x double, m double, x20 double, m20 double")
    got = {r.session: r for r in context.market_response(df, "x", "m", {"1": ("x", "m"), "20": ("x20", "m20")}, 20, 10).collect()}
    for s in range(15, 60):
        seen = [(r[2], r[3]) for r in rows[max(s - 20, 0) : s] if r[2] is not None]
        mx, mm = (sum(v[i] for v in seen) / len(seen) for i in (0, 1))
        beta = sum((a - mx) * (b - mm) for a, b in seen) / sum((b - mm) ** 2 for _, b in seen)
        assert got[s].market_beta == pytest.approx(beta, abs=1e-9) and got[s].response_gap_20 == pytest.approx(rows[s][4] - beta * rows[s][5], abs=1e-9)
        assert (got[s].response_gap_1 is None) == (s == 33)
    assert got[9].market_beta is None


def test_streaks_equal_a_loop(spark):
    rng = random.Random(4)
    rows = [(k, s * 2, rng.choice([None, float("nan"), -1.0, -1.0, 1.0, 1.0, 0.0, 1e-16])) for k in "ab" for s in range(80)]
    df = spark.createDataFrame(rows, "id string, session long, x double")
    q = ft.streak_lengths(df, {"signed": F.col("x")}, {"up": F.col("x") == 1, "never": F.col("x").between(5, 9), "always": F.lit(True)})
    assert sorted(q.columns) == ["always", "id", "never", "session", "signed", "up", "x"]
    one = ft.true_streak(ft.signed_streak(df.where("not isnan(x) or x is null"), "x", "s1"), F.col("x") == 1, "u1")
    alone = ft.streak_lengths(df.where("not isnan(x) or x is null"), {"signed": F.col("x")}, {"up": F.col("x") == 1})
    assert sorted((r.id, r.session, r.s1, r.u1) for r in one.collect()) == sorted((r.id, r.session, r.signed, r.up) for r in alone.collect())
    got = {(r.id, r.session): r for r in q.collect()}
    for k in "ab":
        run = before = up = n = 0
        for kk, s, x in rows:
            if kk != k:
                continue
            sign = 0 if x is None or math.isnan(x) or abs(x) <= 1e-15 else int(math.copysign(1, x))
            run = run + 1 if sign == before and n else 1
            before, n = sign, n + 1
            up = up + 1 if x == 1 else 0
            r = got[k, s]
            assert (r.signed, r.up, r.never, r.always) == (sign * run, up, 0, n)
