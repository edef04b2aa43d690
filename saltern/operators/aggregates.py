"""Aggregations that are more than one built-in call."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltern.functions.frames import correlation, mean_rank, settled

#: Bands of economic relevance.
BANDS = ("A_top_80pct", "B_next_15pct", "C_tail_5pct")


def bars(df: DataFrame, keys: list[str], x: str, order: list[str]) -> DataFrame:
    """Open, high, low, close and count of ``x`` by key, in a total order."""
    place = F.struct(*order)
    return df.groupBy(*keys).agg(F.min_by(x, place).alias("open"), F.max(x).alias("high"), F.min(x).alias("low"), F.max_by(x, place).alias("close"), F.count("*").alias("n"))


def pareto(df: DataFrame, key: str, x: str, cuts: tuple[float, float] = (0.8, 0.95), ranges: int = 64) -> DataFrame:
    """Cumulative share of the total by descending size, and its band: by the share of the rows before it.

    The running sum over all rows is done in two steps, so no task orders the whole table: value ranges, cut at
    approximate quantiles, are summed, and each range starts from the sum of those above it.
    """
    edges = df.approxQuantile(x, [k / ranges for k in range(1, ranges)], 0.01) if ranges > 1 else []
    above = sum((F.when(F.col(x) < e, 1).otherwise(0) for e in sorted(set(edges))), F.lit(0))
    ranged = df.withColumn("_range", above)  # equal values share a range; range 0 holds the largest
    sums = ranged.groupBy("_range").agg(F.sum(x).alias("_sum"))  # one row for each range
    before = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"), F.sum("_sum").over(Window.partitionBy()).alias("_all"))
    own = F.sum(x).over(Window.partitionBy("_range").orderBy(F.desc(x), F.asc(key)).rowsBetween(Window.unboundedPreceding, 0))
    share = (F.col("_before") + own) / F.col("_all")
    out = ranged.join(F.broadcast(before), "_range").select(key, share.alias("share"), (F.col(x) / F.col("_all")).alias("_own"))
    earlier = F.col("share") - F.col("_own")
    return out.withColumn("band", F.when(earlier < cuts[0], BANDS[0]).when(earlier < cuts[1], BANDS[1]).otherwise(BANDS[2])).drop("_own")


def exact_quantiles(df: DataFrame, x: str, shares: list[float], ranges: int = 64) -> list[float | None]:
    """The interpolated quantiles of the values of ``x`` that are not null, as the built-in ``percentile`` has them.

    That one holds all distinct values in one task. Here equal values are counted, the counts of ranges, cut at approximate
    quantiles, tell which ranges hold the wanted places, and only these are ordered, each in a task of its own.
    """
    counts = settled(df.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("v")).agg(F.count("*").alias("n")))
    edges = counts.approxQuantile("v", [k / ranges for k in range(1, ranges)], 0.001) if ranges > 1 else []
    ranged = counts.withColumn("r", sum((F.when(F.col("v") > e, 1).otherwise(0) for e in sorted(set(edges))), F.lit(0)))
    below, held = 0, {}
    for r in ranged.groupBy("r").agg(F.sum("n").alias("n")).orderBy("r").collect():  # a row for each range
        held[r.r] = below, below + r.n
        below += r.n
    if not below:
        return [None] * len(shares)
    at = [share * (below - 1) for share in shares]
    places = sorted({k for h in at for k in (floor(h), ceil(h))})
    asked = [(r, first) for r, (first, end) in held.items() if any(first <= k < end for k in places)]
    start = sum((F.when(F.col("r") == r, first).otherwise(0) for r, first in asked), F.lit(0))
    end = start + F.sum("n").over(Window.partitionBy("r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    found = ranged.where(F.col("r").isin([r for r, _ in asked])).select("v", "n", end.alias("end"))
    hit = F.lit(False)
    for k in places:
        hit = hit | ((F.col("end") > k) & (F.col("end") - F.col("n") <= k))
    rows = found.where(hit).collect()  # one for each place at most
    value = {k: r.v for k in places for r in rows if r.end - r.n <= k < r.end}
    return [value[floor(h)] if floor(h) == h else value[floor(h)] * (ceil(h) - h) + value[ceil(h)] * (h - floor(h)) for h in at]


def skewness(x: str | Column) -> Column:
    """Bias-corrected, null below three values or without spread."""
    n = F.count(x).cast("double")
    return F.when((n >= 3) & (F.stddev_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def kurtosis(x: str | Column) -> Column:
    """Bias-corrected excess, null below four values or without spread."""
    n = F.count(x).cast("double")
    return F.when((n >= 4) & (F.stddev_pop(x) > 0), (n - 1) / (F.when(n > 2, n - 2) * F.when(n > 3, n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column: rows, values, share, mean, deviation, extremes."""
    parts = []
    for c in columns:
        parts.append(F.struct(F.lit(c).alias("feature"), F.count("*").alias("n_rows"), F.count(c).alias("n_values"), (F.count(c) / F.count("*")).alias("coverage"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("deviation"), F.min(c).alias("least"), F.max(c).alias("most")))
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def rank_correlations(df: DataFrame, columns: list[str], within: str) -> DataFrame:
    """Mean over groups of the rank correlation of each pair of columns, over rows with all of them."""
    whole = df.dropna(subset=columns)
    ranked = whole.select(within, *[mean_rank(c, within).alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    by = ranked.groupBy(within).agg(*[correlation(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = by.select(F.explode(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"`{a}|{b}`").alias("c")) for a, b in pairs])).alias("x")).select("x.*")
    return long.groupBy("first", "second").agg(F.avg("c").alias("rank_correlation"), F.count("c").alias("n_groups"))


def pooled_rank_correlations(df: DataFrame, columns: list[str], least: int = 100, threshold: float = 0.0, ranges: int = 64) -> DataFrame:
    """first, second, n, rank_correlation of each pair of columns over the rows that have both; null below ``least`` of them.

    Pairs below ``threshold`` in size are left out, unless it is zero. Ranks are those among a pair's own rows (ties share
    the mean of their places). A row goes out once for each pair it has; no task ranks a whole column, as values
    meet within ranges, cut at approximate quantiles, and a range starts from the count of those below. The columns are computed
    once, for the quantiles, the counts and the ranks.
    """
    df = settled(df.select(*columns))
    edges = df.approxQuantile(columns, [k / ranges for k in range(1, ranges)], 0.01) if ranges > 1 else [[]] * len(columns)
    number = lambda c: F.col(c).cast("double")
    bucket = lambda c, cuts: F.size(F.filter(F.array(*[F.lit(e) for e in sorted(set(cuts))]) if cuts else F.array().cast("array<double>"), lambda e: e < number(c)))
    values = [F.when(number(c).isNotNull() & ~F.isnan(number(c)), F.struct(number(c).alias("v"), bucket(c, cuts).alias("r"))) for c, cuts in zip(columns, edges, strict=True)]
    rows = df.select(*[v.alias(f"c{k}") for k, v in enumerate(values)])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    each = F.array(*[F.when(F.col(f"c{i}").isNotNull() & F.col(f"c{j}").isNotNull(), F.struct(F.lit(k).alias("pair"), F.col(f"c{i}").alias("a"), F.col(f"c{j}").alias("b"))) for k, (i, j) in enumerate(pairs)])
    long = rows.select(F.explode(F.array_compact(each)).alias("x")).select("x.pair", F.col("x.a.v").alias("a"), F.col("x.a.r").alias("ra"), F.col("x.b.v").alias("b"), F.col("x.b.r").alias("rb"))

    def ranked(rows: DataFrame, x: str, r: str, name: str) -> DataFrame:
        below = long.groupBy("pair", r).agg(F.count("*").alias("_n"))  # a row for each range of a pair
        before = F.coalesce(F.sum("_n").over(Window.partitionBy("pair").orderBy(r).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.join(F.broadcast(below.select("pair", r, before.alias("_below"))), ["pair", r])
        place = F.rank().over(Window.partitionBy("pair", r).orderBy(x)) + (F.count("*").over(Window.partitionBy("pair", r, x)) - 1) / 2
        return rows.withColumn(name, F.col("_below") + place).drop("_below")

    both = ranked(ranked(long, "a", "ra", "_ra"), "b", "rb", "_rb")
    found = both.groupBy("pair").agg(F.count("*").alias("n"), correlation("_ra", "_rb").alias("c"))
    c = F.when((F.col("n") >= least) & ~F.isnan("c"), F.col("c"))
    names = df.sparkSession.createDataFrame([(k, columns[i], columns[j]) for k, (i, j) in enumerate(pairs)], "pair int, first string, second string")
    out = F.broadcast(names).join(found, "pair", "left").select("first", "second", F.coalesce("n", F.lit(0)).alias("n"), c.alias("rank_correlation"))
    return out.where(F.abs("rank_correlation") >= threshold) if threshold else out
