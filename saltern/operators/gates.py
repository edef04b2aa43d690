"""A yearly logistic gate over session features, applied as a filter of sessions."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltern.functions.frames import settled


def fit_gate(daily: DataFrame, features: list[str], label: str, c: float = 1.0, least: int = 100) -> PipelineModel:
    """Median imputation, scaling, and a logistic regression whose classes weigh the same in sum.

    The loss is the weighted sum of the rows' plus half the squares of the coefficients over ``c``. Raises ValueError on fewer
    than ``least`` labelled rows or on one class alone.
    """
    rows = daily.where(F.col(label).isNotNull()).withColumn("_label", F.col(label).cast("double"))
    n = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}  # two rows
    total = sum(n.values())
    if total < least or len(n) != 2:
        raise ValueError(f"{total} labelled rows of {len(n)} classes, but {least} of 2 are needed")
    weight = F.when(F.col("_label") == 1.0, total / (2.0 * n[1.0])).otherwise(total / (2.0 * n[0.0]))
    filled = [f"_{f}_filled" for f in features]
    stages = [
        Imputer(strategy="median", inputCols=features, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True),
        # Spark minimises the weighted mean, and weights add up to the number of rows
        LogisticRegression(featuresCol="_x", labelCol="_label", weightCol="_weight", regParam=1.0 / (c * total), standardization=False, maxIter=500, tol=1e-12),
    ]
    return Pipeline(stages=stages).fit(rows.withColumn("_weight", weight))


def probability(model: PipelineModel, features: list[str]) -> Column:
    """The chance of the label as an expression of the features, from the fitted numbers alone.

    A fitted classifier keeps its session, which can't be sent to tasks once something in it observes a plan.
    """
    imputer, _, scaler, logistic = model.stages
    fill = imputer.surrogateDF.first()
    z = F.lit(float(logistic.intercept))
    for f, mean, dev, c in zip(features, scaler.mean, scaler.std, logistic.coefficients, strict=True):
        x = F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), F.lit(float(fill[f])))
        z = z + ((x - float(mean)) / float(dev) * float(c) if dev > 0 else F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def gate_by_year(daily: DataFrame, features: list[str], label: str, purge: int, first_years: int = 2, c: float = 1.0, least: int = 100) -> DataFrame:
    """session, year, probability: each year judged by the gate of all sessions that end ``purge`` before it.

    ``daily`` has a row for each session (session, year, features, label), so the loop is over years of a small table, which
    is computed once, not again by every pass of every year's fit. A year whose training rows are too few has no gate and
    no rows.
    """
    daily = settled(daily.select("session", "year", *features, label))
    bounds = daily.groupBy("year").agg(F.min("session").alias("first")).orderBy("year").collect()
    out = None
    for r in bounds[first_years:]:
        try:
            model = fit_gate(daily.where(F.col("session") < r["first"] - purge), features, label, c, least)
        except ValueError:
            continue
        judged = daily.where(F.col("year") == r["year"]).select("session", "year", probability(model, features).alias("probability"))
        out = judged if out is None else out.unionByName(judged)
    return daily.select("session", "year").where("false").withColumn("probability", F.lit(0.0)) if out is None else out


def gated(panel: DataFrame, gate: DataFrame, least: float = 0.5, session: str = "session") -> DataFrame:
    """The rows of sessions whose gate is open; a session that no gate judged is closed."""
    # a row a session
    return panel.join(F.broadcast(gate.where(F.col("probability") >= least).select(session)), session, "left_semi")
