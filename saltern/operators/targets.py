"""Target weights executed at the open, and plans of several sessions scored by growth and drawdown."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltern.operators.portfolio import Costs

#: Fitness of a plan that can't be executed.
INFEASIBLE = -1e9


def worth(cash: float, held: dict, prices: dict) -> float | None:
    """Cash and holdings at ``prices``; None if a holding has no positive price."""
    if not all(math.isfinite(prices.get(n, math.nan)) and prices[n] > 0 for n in held):
        return None
    return cash + sum(q * prices[n] for n, q in held.items())


def rebalance(cash: float, held: dict, weights: dict, opens: dict, costs: Costs) -> tuple[float, dict, float] | None:
    """Cash, holdings and traded value after orders towards ``weights``; None if a name involved has no price.

    Whole shares of the worth before trading. Sales come first, so that they fund purchases; these go by falling weight
    and then by name, each as far as cash goes.
    """
    before = worth(cash, held, opens)
    if not before or before < 0 or worth(0.0, weights, opens) is None:
        return None
    wanted = {n: max(0, math.floor(before * w / (opens[n] * (1 + costs.slippage)))) for n, w in weights.items()}
    after, traded = {n: math.floor(q + 1e-12) for n, q in held.items()}, 0.0
    for name, now in list(after.items()):
        if (surplus := now - wanted.get(name, 0)) > 0:
            fill, got = costs.sell(opens[name], surplus)
            cash, traded, after[name] = cash + got, traded + fill * surplus, now - surplus
    for name in sorted(weights, key=lambda n: (-weights[n], str(n))):
        q = min(wanted[name] - after.get(name, 0), costs.affordable(opens[name], cash))
        if q > 0:
            fill, paid = costs.buy(opens[name], q)
            cash, traded, after[name] = cash - paid, traded + fill * q, after.get(name, 0) + q
    return None if cash < -1e-6 else (max(cash, 0.0), {n: q for n, q in after.items() if q}, traded)


def simulate_plans(panel: DataFrame, targets: DataFrame, horizon: int, capital: float = 50_000.0, costs: Costs | None = None, penalty: float = 1.0, events: DataFrame | None = None) -> DataFrame:
    """plan, fitness, terminal_return, max_drawdown, turnover of each plan.

    ``targets`` (plan, first, session, id, weight): the weights decided at a session's close and executed at the next
    open, over ``horizon`` sessions from ``first``; a session without any sells everything. ``events`` (id, session,
    multiplier) change the shares held before that session's orders. Fitness is the growth's logarithm less ``penalty``
    times the deepest drawdown; a plan that meets a missing price has fitness ``INFEASIBLE`` and no turnover.

    Plans are independent: one group holds the rows of its own names over its own sessions, whatever the panel's size.
    """
    costs = costs or Costs()
    spans = targets.select("plan", "first", "id").distinct().select("plan", "first", "id", F.explode(F.sequence(F.col("first"), F.col("first") + horizon)).alias("session"))
    rows = spans.join(panel.select("id", "session", "open", "close"), ["id", "session"], "left")
    rows = rows.join(targets.select("plan", "session", "id", "weight"), ["plan", "session", "id"], "left")
    if events is None:
        rows = rows.withColumn("multiplier", F.lit(1.0))
    else:
        rows = rows.join(events.groupBy("id", "session").agg(F.product("multiplier").alias("multiplier")), ["id", "session"], "left").fillna(1.0, ["multiplier"])

    def fold(df: pd.DataFrame) -> pd.DataFrame:
        plan, first = df["plan"].iloc[0], int(df["first"].iloc[0])
        days = {int(s): g for s, g in df.groupby("session")}
        cash, held, target, path, traded = capital, {}, {}, [capital], 0.0
        out = (plan, INFEASIBLE, -1.0, -1.0, None)
        for s in range(first, first + horizon + 1):
            day = days[s]
            if s > first:
                times = dict(zip(day["id"], day["multiplier"], strict=True))
                done = rebalance(cash, {n: q * times.get(n, 1.0) for n, q in held.items()}, target, dict(zip(day["id"], day["open"], strict=True)), costs)
                value = done and worth(*done[:2], dict(zip(day["id"], day["close"], strict=True)))
                if not value or value < 0:
                    break
                cash, held, traded = done[0], done[1], traded + done[2]
                path.append(value)
            said = day[day["weight"].notna()]
            target = dict(zip(said["id"], said["weight"], strict=True))
        else:
            curve = pd.Series(path)
            deepest = float((curve / curve.cummax() - 1).min())
            out = (plan, math.log(max(path[-1] / path[0], 1e-12)) - penalty * abs(deepest), path[-1] / path[0] - 1, deepest, traded)
        return pd.DataFrame([out], columns=["plan", "fitness", "terminal_return", "max_drawdown", "turnover"])

    return rows.groupBy("plan").applyInPandas(fold, "plan long, fitness double, terminal_return double, max_drawdown double, turnover double")
