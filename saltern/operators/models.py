"""Walk-forward model evaluation with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ridge(features: list[str], target: str, penalty: float) -> Pipeline:
    """Median imputation, scaling, ridge regression; ``penalty`` as Spark takes it, see ``spark_penalty``."""
    filled = [f"{f}_filled" for f in features]
    return Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=features, outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_x", withMean=True),
            LinearRegression(featuresCol="_x", labelCol=target, predictionCol="score", regParam=penalty, elasticNetParam=0.0, solver="normal"),
        ]
    )


def spark_penalty(alpha: float, n: int, deviation: float) -> float:
    """What a penalty ``alpha`` of the coefficients' squares beside the residuals' sum of squares is to Spark.

    Spark takes the mean of squares, and a label divided by its population standard deviation.
    """
    return alpha * deviation / n


def walk_forward(panel: DataFrame, features: list[str], target: str, purge: int, first_years: int = 3, alpha: float = 10.0) -> DataFrame:
    """Scores of each year from a ridge model of all years before it, whose last ``purge`` sessions are left out.

    The loop is over years, a handful; each fit is a Spark job over the rows of its years. The panel's columns in use are
    persisted, as every fit and the scores read them; lost parts are computed again. A year without training rows has no
    scores; a constant target is predicted as it is.
    """
    rows = panel.select("id", "session", "year", target, *features).persist()
    bounds = rows.groupBy("year").agg(F.min("session").alias("first")).orderBy("year").collect()
    out = None
    for row in bounds[first_years:]:
        train = rows.where((F.col("session") < row["first"] - purge) & F.col(target).isNotNull())
        size = train.agg(F.count("*").alias("n"), F.coalesce(F.stddev_pop(target), F.lit(0.0)).alias("deviation")).first()
        if not size["n"]:
            continue
        model = ridge(features, target, spark_penalty(alpha, size["n"], size["deviation"])).fit(train)
        scored = model.transform(rows.where(F.col("year") == row["year"])).select("id", "session", "year", "score")
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        return panel.where("false").select("id", "session", "year", F.lit(0.0).alias("score"))
    return out
