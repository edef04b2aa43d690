"""When to stop: fitted-Q iteration over stored transitions, with Spark ML forests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltern.functions.frames import settled


@dataclass
class Controller:
    """The fitted values of exiting and of holding; ``flips`` tells what share of states each iteration decided anew."""

    features: list[str]
    exit_model: RandomForestRegressionModel
    hold_model: RandomForestRegressionModel
    flips: list[float]

    def advantage(self, states: DataFrame, remaining: str = "remaining") -> DataFrame:
        """``states`` with q_exit, q_hold, advantage (null at the horizon, where nothing can be held) and hold."""
        rows = VectorAssembler(inputCols=self.features, outputCol="_x", handleInvalid="keep").transform(states)
        rows = _value(self.hold_model, "_x", "q_hold", _value(self.exit_model, "_x", "q_exit", rows)).drop("_x")
        gain = F.when(F.coalesce(F.col(remaining), F.lit(0)) > 0, F.col("q_hold") - F.col("q_exit"))
        return rows.withColumn("advantage", gain).withColumn("hold", F.coalesce(gain > 0, F.lit(False)))


def _value(model: RandomForestRegressionModel, x: str, name: str, rows: DataFrame) -> DataFrame:
    return model.copy().setFeaturesCol(x).setPredictionCol(name).transform(rows)


def steps(transitions: DataFrame, features: list[str], next_features: list[str], exit_value: str, has_next: str) -> DataFrame:
    """(x, ahead, exit, more): the state, the one after it, the value of exiting now, whether there is one after it.

    States with a null feature or no exit value are left out. Where no state follows, or a feature of it is null, the
    state's own stands in.
    """
    after = [F.when(F.col(has_next), F.coalesce(n, f)).otherwise(F.col(f)) for f, n in zip(features, next_features, strict=True)]
    flat = transitions.select(
        *[F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(features)],
        *[c.cast("double").alias(f"ahead{k}") for k, c in enumerate(after)],
        F.col(exit_value).cast("double").alias("exit"),
        F.coalesce(F.col(has_next), F.lit(False)).alias("more"),
    )
    for name in ("x", "ahead"):
        flat = VectorAssembler(inputCols=[f"{name}{k}" for k in range(len(features))], outputCol=name, handleInvalid="skip").transform(flat)
    return flat.where("exit is not null").select("x", "ahead", "exit", "more")


def fitted_q(transitions: DataFrame, features: list[str], next_features: list[str], exit_value: str, has_next: str, iterations: int = 3, trees: int = 20, depth: int = 5, seed: int = 7) -> Controller:
    """The value of exiting, fitted once, and of holding, fitted again and again from the better of both one step on.

    Before the first iteration, holding is worth what exiting is. Targets stay within the 0.5 and 99.5 percent quantiles
    of the exit values seen; the last state of an episode is worth its exit. The loop is over iterations only, each one
    fit and one scan; plans don't grow, as each starts from the same rows. A fit reads its input several times, so the
    states, with what exiting is worth on them, and each iteration's targets are computed once.
    """
    learner = RandomForestRegressor(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    rows = settled(steps(transitions, features, next_features, exit_value, has_next))
    bounds = rows.agg(F.percentile_approx("exit", [0.005, 0.995], 100_000).alias("q")).first()["q"]
    clipped = lambda c: F.greatest(F.lit(bounds[0]), F.least(c, F.lit(bounds[1])))
    leave = learner.fit(rows.withColumnRenamed("exit", "label"))
    rows = _value(leave, "ahead", "leave_ahead", _value(leave, "x", "leave", rows)).select("x", "ahead", "more", "leave", "leave_ahead")
    rows = settled(rows.withColumns({"hold": F.col("leave"), "hold_ahead": F.col("leave_ahead")}))
    hold, flips = leave, []
    for k in range(iterations):
        later = F.greatest("leave_ahead", "hold_ahead")
        label = clipped(F.when(F.col("more"), later).otherwise(F.col("leave")))
        hold = learner.fit(rows.select("x", label.alias("label")))
        rows = _value(hold, "x", "after", rows)
        changed = F.avg(((F.col("hold") > F.col("leave")) != (F.col("after") > F.col("leave"))).cast("double"))
        if k + 1 < iterations:
            rows = settled(_value(hold, "ahead", "later", rows.drop("hold_ahead")))
            flips.append(rows.agg(changed).first()[0])
            rows = rows.drop("hold").withColumnsRenamed({"after": "hold", "later": "hold_ahead"})
        else:
            flips.append(rows.agg(changed).first()[0])
    return Controller(features, leave, hold, flips)
