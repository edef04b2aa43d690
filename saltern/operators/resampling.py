"""Joint block bootstrap of aligned return series, as joins and aggregations: nothing is collected but one row count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drawn(seed: int, stream: str, rep: Column, block: Column, starts: int) -> Column:
    """A number from 0 to ``starts`` - 1 that the seed, stream, replicate and block decide."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stream), rep.cast("string"), block.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(starts))


def aligned(returns: DataFrame, order: str, series: str, x: str) -> DataFrame:
    """place (from 0), values: a map from series to return, at the places in order where every series has one."""
    whole = returns.where(F.col(x).isNotNull())
    wanted = whole.agg(F.count_distinct(series).alias("wanted"))
    by = whole.groupBy(order).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(series, x)))).alias("values"))
    by = by.join(F.broadcast(wanted), F.size("values") == F.col("wanted"))  # one row
    # one row a session: a dimension
    return by.select((F.row_number().over(Window.orderBy(order)) - 1).alias("place"), "values")


def resampled(places: DataFrame, n: int, reps: int, block: int, seed: int, stream: str) -> DataFrame:
    """rep, at, series, r: every series of a replicate follows the same blocks of consecutive places."""
    block = max(1, min(block, n))
    rows = places.sparkSession.range(reps).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(-(-n // block) - 1))).alias("block"))
    rows = rows.withColumn("start", drawn(seed, stream, F.col("rep"), F.col("block"), n - block + 1))
    rows = rows.select("rep", "start", "block", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("step"))
    rows = rows.select("rep", (F.col("block") * block + F.col("step")).alias("at"), (F.col("start") + F.col("step")).alias("place")).where(F.col("at") < n)
    # at most one row a session, some 73,000 in two centuries
    return rows.join(F.broadcast(places), "place").select("rep", "at", F.explode("values").alias("series", "r"))


def replicate_metrics(rows: DataFrame, per_year: float, risk_free: float) -> DataFrame:
    """rep, series, mean, cagr, sharpe, max_drawdown of each replicate."""
    w = Window.partitionBy("rep", "series").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("level", F.sum(F.log1p("r")).over(w))
    rows = rows.withColumn("top", F.greatest(F.max("level").over(w), F.lit(0.0)))
    daily = (1.0 + risk_free) ** (1.0 / per_year) - 1.0
    g = rows.groupBy("rep", "series").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("dev"), F.sum(F.log1p("r")).alias("total"), F.min(F.exp(F.col("level") - F.col("top")) - 1).alias("max_drawdown"))
    sharpe = F.when(F.col("dev") > 0, (F.col("mean") - daily) / F.col("dev") * per_year**0.5)
    return g.select("rep", "series", "mean", (F.exp(F.col("total") * per_year / F.col("n")) - 1).alias("cagr"), sharpe.alias("sharpe"), "max_drawdown")


def joint_bootstrap(returns: DataFrame, order: str, series: str, x: str, benchmark: str, reps: int = 1000, block: int = 20, seed: int = 8675309, per_year: float = 252.0, risk_free: float = 0.0) -> DataFrame:
    """series, metric, p2_5, median, p97_5: intervals of cagr, sharpe, max_drawdown and excess_cagr over the benchmark.

    Rows without a return are left out; replicates need one aligned row at least, else there are no rows.
    """
    places = aligned(returns, order, series, x)
    n = places.count()
    if not n:
        return returns.sparkSession.createDataFrame([], "series string, metric string, p2_5 double, median double, p97_5 double")
    m = replicate_metrics(resampled(places, n, reps, block, seed, "own"), per_year, risk_free)
    base = m.where(F.col("series") == benchmark).select("rep", F.col("cagr").alias("base"))
    own = m.where(F.col("series") != benchmark).join(base, "rep").withColumn("excess_cagr", F.col("cagr") - F.col("base"))
    metrics = ["cagr", "sharpe", "max_drawdown", "excess_cagr"]
    long = own.select("series", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in metrics])).alias("m")).select("series", "m.*")
    quantile = lambda q: F.percentile("v", F.lit(q))
    return long.groupBy("series", "metric").agg(quantile(0.025).alias("p2_5"), quantile(0.5).alias("median"), quantile(0.975).alias("p97_5"))


def familywise_test(returns: DataFrame, order: str, series: str, x: str, benchmark: str, reps: int = 1000, block: int = 20, seed: int = 8675309, per_year: float = 252.0) -> DataFrame:
    """observed_max, p_value, reps: whether the best mean active return could be the best of series that have none.

    Active returns are centred, blocks are drawn jointly, and the largest mean of a replicate is held against the observed
    one: (1 + replicates as large) / (replicates + 1).
    """
    places = aligned(returns, order, series, x)
    n = places.count()
    active = F.transform_values(F.map_filter("values", lambda k, _: k != benchmark), lambda _, v: v - F.col("values")[benchmark])
    moved = places.select("place", active.alias("values"))
    long = moved.select("place", F.explode("values").alias("series", "a"))
    means = long.groupBy("series").agg(F.avg("a").alias("m"))
    observed = means.agg(F.max(F.col("m") * per_year).alias("observed_max"))
    centred = long.join(F.broadcast(means), "series").groupBy("place").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("series", (F.col("a") - F.col("m")).alias("a"))))).alias("values"))
    null = resampled(centred, n, reps, block, seed, "null") if n else centred.select("place", F.explode("values").alias("series", "r")).withColumn("rep", F.lit(0))
    most = null.groupBy("rep", "series").agg((F.avg("r") * per_year).alias("m")).groupBy("rep").agg(F.max("m").alias("most"))
    # one row
    held = most.join(F.broadcast(observed), F.round("most", 12) >= F.round("observed_max", 12), "right").groupBy("observed_max").agg(F.count("rep").alias("as_large"))
    return held.select("observed_max", ((F.col("as_large") + 1) / F.lit(reps + 1.0)).alias("p_value"), F.lit(reps).cast("long").alias("reps"))
