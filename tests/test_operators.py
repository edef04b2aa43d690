"""Invariants: no look ahead, whole shares, cash, sources that round-trip, streams that equal their batch."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from saltern.operators import features as ft
from saltern.operators import models
from saltern.operators import portfolio as pf
from saltern.operators import temporal as tp
from saltern.sources import market
from saltern.streaming import sessions

START = dt.date(2020, 1, 6)


def panel(spark, n=60, change=None):
    rows = []
    for k in ("a", "b"):
        for s in range(n):
            if (s + (k == "b")) % 17 == 5:
                continue  # a missing session
            px = 100 + ((s * 7 + (k == "b") * 3) % 11) - s / 10
            px *= 3 if change is not None and s >= change else 1
            rows.append((k, s, START + dt.timedelta(days=s), px, px + 2, px - 2, px + 1, 1000.0 + s, px * 1000))
    return spark.createDataFrame(rows, "id string, session long, date date, open double, high double, low double, close double, volume double, turnover double")


def features(p):
    from saltern.plans.panel import with_return

    q = with_return(with_return(p, 1), 5)
    q = ft.streak_history(ft.signed_streak(ft.volatility(ft.moving_average_distance(q, 5, 3), 20, 5), "return_1", "streak"), "streak", "return_1")
    return ft.position_in_range(ft.zscore(q, "turnover", 10, 5), 10, 5)


def test_no_feature_sees_the_future(spark):
    old = {tuple(r) for r in features(panel(spark)).where("session < 40").collect()}
    new = {tuple(r) for r in features(panel(spark, change=40)).where("session < 40").collect()}
    assert old == new


def test_exact_sessions_and_targets(spark):
    q = ft.forward_target(panel(spark), 3)
    for r in q.where("id = 'a'").collect():
        whole = all((r.session + k) % 17 != 5 and r.session + k < 60 for k in (1, 2, 3))
        assert (r.target_3 is not None) == whole


def test_shares_are_whole_and_affordable():
    c = pf.Costs()
    for price in (0.07, 3.3, 101.5, 5000.0):
        for cash in (1.0, 20.0, 999.0, 123456.0):
            q = c.affordable(price, cash)
            assert q >= 0 and (q == 0 or c.buy(price, q)[1] <= cash + 1e-9)
            assert c.buy(price, q + 1)[1] > cash
    assert c.scaled(2).buy(100, 10)[1] > c.buy(100, 10)[1] and c.scaled(0).buy(100, 10)[1] == pytest.approx(1000)


def test_cohorts_keep_cash_without_costs(spark):
    p = panel(spark).withColumns({"eligible": F.lit(True), "score": F.col("close")})
    cfg = spark.createDataFrame([(1, 5000.0, 1, 3, 0.0), (2, 5000.0, 2, 5, 1.0)], "config long, capital double, k int, hold int, cost_factor double")
    out = pf.cohort_backtest(p, cfg, "score").orderBy("config", "session").collect()
    assert {r.config for r in out} == {1, 2} and all(r.cash >= -1e-6 and r.equity >= r.cash - 1e-9 for r in out)
    assert pf.cohort_backtest(p, cfg, "score").orderBy("config", "session").collect() == out


def test_bracket_statuses(spark):
    day = lambda k: START + dt.timedelta(days=k)
    ev = spark.createDataFrame([(k, s, day(10)) for k, s in enumerate("abcdefg")], "event int, symbol string, date date")
    rows = [("a", day(10), 1), ("b", day(10), 1), ("b", day(10), 2), ("c", day(8), 3), ("c", day(15), 3), ("d", day(8), 3), ("d", day(11), 4), ("e", day(2), 5), ("e", day(12), 5), ("f", day(8), 6), ("f", day(8), 7), ("f", day(12), 6)]
    got = {r.event: (r.status, r.id) for r in tp.bracket_join(ev, spark.createDataFrame(rows, "symbol string, date date, id int"), "symbol").collect()}
    assert got == {0: ("mapped", 1), 1: ("ambiguous_exact", None), 2: ("mapped_bracket", 3), 3: ("conflicting_bracket", None), 4: ("unmapped", None), 5: ("ambiguous_left", None), 6: ("unmapped", None)}


def test_factor_applies_before_the_day_only(spark):
    p = panel(spark).where("id = 'a'")
    ev = spark.createDataFrame([("a", START + dt.timedelta(days=20), 0.2), ("a", START + dt.timedelta(days=30), 0.5)], "id string, ex_date date, multiplier double")
    got = {r.session: round(r.factor, 9) for r in tp.adjustment_factor(p, ev).collect()}
    assert got[19] == 0.1 and got[20] == 0.5 and got[29] == 0.5 and got[30] == 1.0


def test_price_files_of_both_layouts(spark, tmp_path):
    (tmp_path / "new.csv").write_text("TradDt,ISIN,TckrSymb,SctySrs,OpnPric,HghPric,LwPric,ClsPric,PrvsClsgPric,TtlTradgVol,TtlTrfVal,TtlNbOfTxsExctd\n2024-07-08, ine002a01018 ,RELY,EQ,1,2,0.5,1.5,1.4,10,15,3\n")
    (tmp_path / "old.csv").write_text("SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP,\nRELY,EQ,1,2,0.5,1.5,1.5,1.4,10,15,08-JUL-2024,\n")
    a = market.price_files(spark, str(tmp_path / "new.csv")).first()
    b = market.price_files(spark, str(tmp_path / "old.csv")).first()
    assert a.security_key == "ISIN:INE002A01018" and b.security_key == "NSE:RELY:EQ"
    assert a.trade_date == b.trade_date == dt.date(2024, 7, 8) and a.close == b.close == 1.5 and b.trades is None
    (tmp_path / "bad.csv").write_text("SYMBOL,OPEN\nX,1\n")
    with pytest.raises(ValueError):
        market.price_files(spark, str(tmp_path / "bad.csv"))


def test_panels_round_trip_with_pruning(spark, tmp_path):
    p = panel(spark, 10)
    market.write_panel(p, str(tmp_path / "p"))
    back = market.read_panel(spark, str(tmp_path / "p"), ["id", "close"], "2020-01-10")
    assert back.count() == p.where("date >= '2020-01-10'").count()
    assert "PartitionFilters: [isnotnull(date" in back._jdf.queryExecution().toString()


def test_streamed_bars_equal_the_batch(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    q = sessions.bars(stream, "ts", "user_id", "value", late="60 days").writeStream.outputMode("complete").format("memory").queryName("streamed").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.sql("select * from streamed").collect()}
    assert got == {tuple(r) for r in sessions.bars(ev, "ts", "user_id", "value").collect()}


def test_persistent_portfolio_conserves_cash_without_costs(spark):
    p = panel(spark).withColumns({"eligible": F.lit(True), "score": F.col("close")})
    cfg = spark.createDataFrame([(1, 5000.0, 1, 1, 5, 0.0, 0.0), (2, 5000.0, 2, 2, 5, 0.5, 1.0)], "config long, capital double, k int, hold_rank int, every int, min_gap double, cost_factor double")
    out = pf.persistent_backtest(p, cfg, "score").orderBy("config", "session").collect()
    assert {r.config for r in out} == {1, 2} and all(r.cash >= -1e-6 for r in out)
    for c in (1, 2):
        run = [r for r in out if r.config == c]
        assert run[-1].n_held == 0 and run[-1].equity == pytest.approx(run[-1].cash)
        assert max(r.n_held for r in run) <= c and any(r.traded > 0 for r in run)
        for a, b in zip(run, run[1:]):  # without trades, cash stays; without holdings, equity is cash
            assert b.traded > 0 or b.n_held == 0 or a.cash == b.cash
            assert b.n_held or b.equity == pytest.approx(b.cash)


def test_a_halted_holding_is_sold_at_its_next_price(spark):
    rows = [("a", s, 10.0, 10.0, 1.0, s == 0, 1.0) for s in (0, 1, 2, 30, 31)] + [("b", s, 1.0, 1.0, 1.0, False, 0.0) for s in range(41)]
    p = spark.createDataFrame(rows, "id string, session long, open double, close double, turnover double, eligible boolean, score double")
    cfg = spark.createDataFrame([(1, 100.0, 1, 3, 0.0)], "config long, capital double, k int, hold int, cost_factor double")
    out = {r.session: r for r in pf.cohort_backtest(p, cfg, "score").collect()}
    assert out[29].n_held == 1 and out[30].n_held == 0 and out[40].equity > 90


def test_wide_portfolios_keep_all_their_candidates(spark):
    rows = [(k, s, 10.0, 10.0, 1.0, True, float(-k)) for k in range(40) for s in range(12)]
    p = spark.createDataFrame(rows, "id long, session long, open double, close double, turnover double, eligible boolean, score double")
    cfg = spark.createDataFrame([(1, 50_000.0, 30, 30, 5, 0.0, 0.0)], "config long, capital double, k int, hold_rank int, every int, min_gap double, cost_factor double")
    assert max(r.n_held for r in pf.persistent_backtest(p, cfg, "score").collect()) == 30


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2)) * [1.0, 7.0]
    y = x @ [0.5, -0.1] + rng.normal(size=300)
    rows = [(int(k), int(k), 2000 + k // 60, float(y[k]), float(x[k, 0]), float(x[k, 1])) for k in range(300)]
    p = spark.createDataFrame(rows, "id long, session long, year int, y double, a double, b double")
    got = {r.session: r.score for r in models.walk_forward(p, ["a", "b"], "y", purge=5, alpha=10.0).collect()}
    assert sorted(got) == list(range(180, 300))
    for year, first in ((2003, 180), (2004, 240)):
        t = slice(0, first - 5)
        z = (x - x[t].mean(0)) / x[t].std(0)
        beta = np.linalg.solve(z[t].T @ z[t] + 10.0 * np.eye(2), z[t].T @ (y[t] - y[t].mean()))
        for k in range(first, first + 60):
            assert got[k] == pytest.approx(y[t].mean() + z[k] @ beta, abs=1e-6)


def test_conditional_streaks_equal_plain_python(spark):
    import random

    rng = random.Random(3)
    rows = [(k, s, rng.choice([None, -2, 0, 1, 2, 3, 9]), rng.choice([None, float("nan"), -0.1, 0.0, 0.2])) for k in "ab" for s in range(80)]
    df = spark.createDataFrame(rows, "id string, session long, state long, x double")
    got = {(r.id, r.session): r for r in ft.conditional_streak_history(df, "state", "x", "h", 3).collect()}
    for key in "ab":
        held, before = {}, 0
        for k, s, state, x in rows:
            if k != key:
                continue
            if x is not None and x == x:
                held.setdefault(before, []).append(x)
            before = max(0, min(5, state or 0))
            known = held.get(before, []) if before else []
            r = got[key, s]
            assert r.h_count == len(known)
            if len(known) < 3:
                assert r.h_mean is None and r.h_up_prob is None
            else:
                assert abs(r.h_mean - sum(known) / len(known)) < 1e-9 and abs(r.h_up_prob - sum(v > 0 for v in known) / len(known)) < 1e-9


def test_identities_and_how_sure_they_are(spark):
    day = lambda k: dt.date(2021, 3, 1) + dt.timedelta(k)
    says = {"one": [None, "A", None, "A", None], "two": [None, "A", None, "A", None, "B", None], "none": [None, None]}
    rows = [(e, day(k), a) for e, anchors in says.items() for k, a in enumerate(anchors)]
    got = tp.identity_resolution(spark.createDataFrame(rows, "e string, d date, isin string"), ["e"], "d", "isin").orderBy("e", "d").collect()
    assert [(r.resolved, r.confidence) for r in got if r.e == "one"] == [("A", 0.98), ("A", 1.0), ("A", 0.99), ("A", 1.0), ("A", 0.98)]
    assert [(r.resolved, r.confidence) for r in got if r.e == "two"] == [("A", 0.85), ("A", 1.0), ("A", 0.95), ("A", 1.0), (None, 0.0), ("B", 1.0), ("B", 0.85)]
    assert [(r.resolved, r.method, r.anchor_before) for r in got if r.e == "none"] == [(None, "unresolved_no_anchor", None)] * 2
    r = next(r for r in got if r.e == "two" and r.d == day(4))
    assert (r.method, r.anchor_before, r.anchor_after, r.episode_start, r.episode_end) == ("unresolved_between_isin_change", day(3), day(5), day(0), day(6))


def test_ambiguous_keys_fall_away(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), ("y", 1), ("y", 2), (None, 3), ("z", None), ("w", 4), ("w", None)], "k string, v int")
    assert sorted(map(tuple, tp.unambiguous(df, "k", "v").collect())) == [("w", 4), ("x", 1)]


def test_shares_of_any_sum_are_found_at_once():
    costs = pf.Costs()
    for cash in (0.0, 17.0, 1234.5, 5e4, 1e12):
        for price in (0.0, 3.7, 1021.9):
            q = max(int((cash - 17.7) / (price * costs.unit_cost()) + 1e-12), 0) if price else 0
            while q and costs.buy(price, q)[1] > cash + 1e-9:
                q -= 1
            assert costs.affordable(price, cash) == q
    rng = random.Random(5)
    for _ in range(200):  # rounding of such sums is worth up to 1e80 shares, which were given back one by one
        price, cash = rng.uniform(900, 2100), 10 ** rng.uniform(17, 100)
        q = costs.affordable(price, cash)
        assert costs.buy(price, q)[1] <= cash < costs.buy(price, int(q * (1 + 1e-12)))[1]
