"""How a score orders what comes after, session by session, and over sessions; priorities of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltern.functions.frames import correlation, mean_rank


def decile_spread(p: DataFrame, score: str, target: str, least: int = 20, within: str = "session") -> DataFrame:
    """For each session with ``least`` rows that have both: n, ic, top, bottom, universe, top_excess, top_minus_bottom.

    ``ic`` is the rank correlation to nine places, so that what rounding leaves of zero has no sign; top and bottom are the means of ``target`` over the rows whose mean-rank share is from 0.9 on
    and up to 0.1, null where there are none. Null and NaN rows don't count; ties share their places.
    """
    both = p.where(F.col(score).isNotNull() & F.col(target).isNotNull() & ~F.isnan(F.col(score).cast("double")) & ~F.isnan(F.col(target).cast("double")))
    q = both.select(within, F.col(target).alias("_t"), mean_rank(score, within).alias("_sr"), mean_rank(target, within).alias("_tr"), F.count("*").over(Window.partitionBy(within)).alias("_n")).where(F.col("_n") >= least)
    share = F.col("_sr") / F.col("_n")
    part = lambda c: F.avg(F.when(c, F.col("_t")))
    # shares are quotients of halves and counts; the edges themselves belong to both parts
    g = q.groupBy(within).agg(F.count("*").alias("n"), F.round(correlation("_sr", "_tr"), 9).alias("ic"), part(share >= 0.9 - 1e-12).alias("top"), part(share <= 0.1 + 1e-12).alias("bottom"), F.avg("_t").alias("universe"))
    return g.withColumns({"top_excess": F.col("top") - F.col("universe"), "top_minus_bottom": F.col("top") - F.col("bottom")})


def spread_summary(spreads: DataFrame) -> DataFrame:
    """One row over ``decile_spread``: sessions, mean, median and deviation of ic, icir (null without deviation), share of positive ic, mean spreads."""
    dev = F.stddev_samp("ic")
    positive = F.avg(F.when(F.col("ic").isNotNull(), (F.col("ic") > 0).cast("double")))
    return spreads.agg(F.count("*").alias("n_sessions"), F.avg("ic").alias("mean_ic"), F.median("ic").alias("median_ic"), dev.alias("ic_deviation"), F.when(dev > 0, F.avg("ic") / dev).alias("icir"), positive.alias("positive_share"), F.avg("top_excess").alias("mean_top_excess"), F.avg("top_minus_bottom").alias("mean_top_minus_bottom"))


#: Names of review priorities.
PRIORITIES = ("P0_economic_and_identity_risk", "P1_identity_risk", "P1_economic_relevance", "P2", "P3")


def review_priority(band: Column, ambiguous: Column, bands: tuple[str, str, str]) -> Column:
    """What to look at first: rows of the first band that are ambiguous, then ambiguous ones, then the first band, then the second."""
    risky = F.coalesce(ambiguous, F.lit(False))
    both, risk, size, second, rest = PRIORITIES
    return F.when(risky & (band == bands[0]), both).when(risky, risk).when(band == bands[0], size).when(band == bands[1], second).otherwise(rest)
