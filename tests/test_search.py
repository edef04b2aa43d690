"""Target execution, plans and learned stopping on small cases worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from saltern.operators.portfolio import Costs
from saltern.operators.stopping import fitted_q
from saltern.operators.targets import INFEASIBLE, rebalance, simulate_plans

FREE = Costs(*[0.0] * 9)
PRICES = "id string, session long, open double, close double"
TARGETS = "plan long, first long, session long, id string, weight double"


def test_orders_sell_first_and_buy_whole_shares():
    assert rebalance(0.0, {"a": 10}, {"b": 1.0}, {"a": 10.0, "b": 30.0}, FREE) == (10.0, {"b": 3}, 190.0)
    assert rebalance(100.0, {}, {"a": 0.5, "b": 0.5}, {"a": 50.0, "b": 30.0}, FREE) == (20.0, {"a": 1, "b": 1}, 80.0)
    assert rebalance(100.0, {"a": 2}, {}, {"a": 5.0}, FREE) == (110.0, {}, 10.0)
    cash, held, _ = rebalance(1000.0, {}, {"a": 1.0}, {"a": 10.0}, Costs())
    assert held["a"] < 100 and cash >= 0


def test_orders_without_a_price_are_infeasible():
    assert rebalance(10.0, {"a": 1}, {}, {}, FREE) is None
    assert rebalance(10.0, {}, {"a": 1.0}, {"a": math.nan}, FREE) is None
    assert rebalance(0.0, {}, {"a": 1.0}, {"a": 1.0}, FREE) is None


def test_plans_score_growth_less_drawdown(spark):
    closes = {0: 10.0, 1: 10.0, 2: 8.0, 3: 12.0}
    p = spark.createDataFrame([("a", s, 10.0, c) for s, c in closes.items()] + [("b", s, 5.0, 5.0) for s in (0, 1)], PRICES)
    t = spark.createDataFrame([(1, 0, s, "a", 1.0) for s in range(3)] + [(2, 0, s, "b", 1.0) for s in range(3)], TARGETS)
    got = {r.plan: r for r in simulate_plans(p, t, 3, 100.0, FREE, 0.5).collect()}
    # ten shares from the second session on; 100, 100, 80, 120 less what the third open at 10 rebalances (nothing)
    assert got[1].terminal_return == pytest.approx(0.2) and got[1].max_drawdown == pytest.approx(-0.2)
    assert got[1].fitness == pytest.approx(math.log(1.2) - 0.1) and got[1].turnover == pytest.approx(100.0)
    assert got[2].fitness == INFEASIBLE and got[2].turnover is None


def test_events_change_the_shares_before_the_orders(spark):
    p = spark.createDataFrame([("a", 0, 10.0, 10.0), ("a", 1, 10.0, 10.0), ("a", 2, 5.0, 5.0)], PRICES)
    t = spark.createDataFrame([(1, 0, s, "a", 1.0) for s in range(2)], TARGETS)
    e = spark.createDataFrame([("a", 2, 2.0)], "id string, session long, multiplier double")
    assert simulate_plans(p, t, 2, 100.0, FREE, 1.0, e).first().terminal_return == pytest.approx(0.0)
    assert simulate_plans(p, t, 2, 100.0, FREE, 1.0).first().terminal_return == pytest.approx(-0.5)
    assert simulate_plans(p, t.where("false"), 2).count() == 0


def test_holding_is_worth_more_while_values_rise(spark):
    rows = [(e, float(t), float(t), 9.0 - t) for e in range(40) for t in range(10)]
    s = spark.createDataFrame(rows, "episode long, t double, v double, remaining double")
    s = s.withColumns({"next_t": F.col("t") + 1, "next_v": F.col("v") + 1, "next_remaining": F.col("remaining") - 1, "has_next": F.col("remaining") > 0})
    c = fitted_q(s, ["t", "v", "remaining"], ["next_t", "next_v", "next_remaining"], "v", "has_next", iterations=6, trees=5)
    got = {r.t: r for r in c.advantage(s).where("episode = 0").collect()}
    assert all(got[float(t)].hold for t in range(5)) and not got[9.0].hold and got[9.0].advantage is None
    assert len(c.flips) == 6 and c.flips[0] > 0 and all(r.q_hold <= 9.0 + 1e-9 for r in got.values())


def test_states_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(float(t), math.sin(e + t), (e + t) % 3 > 0) for e in range(30) for t in range(10)]
    s = spark.createDataFrame(rows, "t double, v double, has_next boolean").withColumns({"next_t": F.col("t") + 1, "next_v": F.col("v") / 2})
    c = fitted_q(s.mapInArrow(counted, s.schema), ["t", "v"], ["next_t", "next_v"], "v", "has_next", iterations=2, trees=3)
    assert seen.value == len(rows) and len(c.flips) == 2
