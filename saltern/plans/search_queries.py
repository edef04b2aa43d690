"""Plans of several sessions and learned stopping; simulated or fitted, so without a DuckDB text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from saltern.operators import portfolio as pf
from saltern.operators.stopping import fitted_q
from saltern.operators.targets import simulate_plans
from saltern.plans.panel import rounded
from saltern.plans.portfolio_queries import episode_values, scored
from saltern.plans.registry import Registry

REG = Registry()
HORIZON, SLOTS = 5, 3


@REG.add("plan_fitness")
def plan_fitness(spark, d):
    """From each fifth session on: the best names of each session at equal weights, held for ``HORIZON`` sessions.

    Plans look ahead by nature, so they choose among names that have a price in each of their sessions.
    """
    p = scored(spark, d).select("id", "session", "open", "close", "turnover", "eligible", "return_5")
    first = (F.floor(F.col("session") / HORIZON) * HORIZON).cast("long")
    touched = p.select("id", F.explode(F.array_compact(F.array(first, F.when(F.col("session") == first, first - HORIZON)))).alias("plan"))
    whole = touched.groupBy("id", "plan").agg(F.count("*").alias("n")).where(F.col("n") == HORIZON + 1)
    able = p.where("eligible").withColumn("plan", first).join(whole, ["id", "plan"], "left_semi")
    best = pf.top_k(able, "return_5", SLOTS).select("id", "session")
    targets = best.select(first.alias("plan"), first.alias("first"), "session", "id", F.lit(1.0 / SLOTS).alias("weight"))
    return rounded(simulate_plans(p, targets, HORIZON))


def transitions(spark, d):
    """States of the events' episodes with the state after each."""
    w = Window.partitionBy("episode").orderBy("t")
    seen, size = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("episode")
    s = episode_values(spark, d).select("episode", F.col("t").cast("double").alias("t"), "v", F.max("v").over(seen).alias("peak"), (F.count("*").over(size) - F.col("t")).cast("double").alias("remaining"))
    return s.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in ("t", "v", "peak", "remaining")], (F.col("remaining") > 0).alias("has_next"))


STATE = ["t", "v", "peak", "remaining"]


def controller(spark, d):
    s = transitions(spark, d)
    return s, fitted_q(s, STATE, [f"next_{c}" for c in STATE], "v", "has_next")


@REG.add("fqi")
def fqi(spark, d):
    s, c = controller(spark, d)
    return rounded(c.advantage(s).select("episode", "t", "v", "q_exit", "q_hold", "advantage", "hold"))
