"""Costs, selections, simulations and performance of portfolios."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltern.functions.frames import correlation, ratio


@dataclass(frozen=True)
class Costs:
    """Rates of traded value, and fixed fees of an order."""

    tax_buy: float = 0.001
    tax_sell: float = 0.001
    stamp_buy: float = 0.00015
    regulator: float = 0.000001
    exchange: float = 0.0000307
    gst: float = 0.18
    brokerage: float = 15.0
    depository_sell: float = 0.0
    slippage: float = 0.0005

    def scaled(self, factor: float) -> Costs:
        """All but the tax on fees times ``factor``."""
        return Costs(*[x * factor if k != "gst" else x for k, x in self.__dict__.items()])

    def buy(self, price, quantity):
        """Fill price and cash that leaves, for numbers or columns."""
        fill = price * (1 + self.slippage)
        value = fill * quantity
        fees = self.brokerage + value * (self.exchange + self.regulator)
        return fill, value * (1 + self.tax_buy + self.stamp_buy) + fees + self.gst * fees

    def sell(self, price, quantity):
        """Fill price and cash that comes in."""
        fill = price * (1 - self.slippage)
        value = fill * quantity
        fees = self.brokerage + value * (self.exchange + self.regulator)
        return fill, value * (1 - self.tax_sell) - fees - self.gst * fees - self.depository_sell

    def unit_cost(self) -> float:
        """Cash for one unit of price, without the fixed part."""
        return (1 + self.slippage) * (1 + self.tax_buy + self.stamp_buy + (self.exchange + self.regulator) * (1 + self.gst))

    def affordable(self, price: float, cash: float) -> int:
        """The most whole shares that ``cash`` buys, at most those of the closed form."""
        fits = lambda n: n == 0 or self.buy(price, n)[1] <= cash + 1e-9
        q = max(int((cash - self.brokerage * (1 + self.gst)) / (price * self.unit_cost()) + 1e-12), 0) if price > 0 else 0
        if fits(q):
            return q
        # rounding costs a number of shares that grows with the sum: steps double, then the last is halved
        step = 1
        while not fits(max(q - step, 0)):
            step *= 2
        low, high = max(q - step, 0), q
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if fits(middle) else (low, middle)
        return low

    def affordable_column(self, price: Column, cash: Column) -> Column:
        """The closed form and one step down, which rounding can need."""
        q = F.greatest(F.floor((cash - self.brokerage * (1 + self.gst)) / (price * self.unit_cost()) + 1e-12), F.lit(0))
        return F.when(price > 0, F.when((q > 0) & (self.buy(price, q)[1] > cash + 1e-9), q - 1).otherwise(q)).otherwise(0).cast("long")


def top_k(p: DataFrame, score: str, k: int, within: str = "session", ties: tuple[str, ...] = ("turnover", "id")) -> DataFrame:
    """The k best eligible rows of each session; ties by larger turnover, then smaller id."""
    w = Window.partitionBy(within).orderBy(F.desc(score), F.desc(ties[0]), F.asc(ties[1]))
    return p.where(F.col(score).isNotNull() & ~F.isnan(score)).withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)


def cohort_backtest(panel: DataFrame, configs: DataFrame, score: str) -> DataFrame:
    """One equity curve for each configuration (config, capital, k, hold, cost_factor), folded session by session.

    A configuration buys its top k at the next open with equal slots, sells at the close ``hold`` sessions on, and
    starts anew when it is flat; shares are whole; positions that can't be sold at the end are worth nothing. Runs are
    independent, so they spread over tasks; each task's panel holds the few rows that can be bought or held: the best
    candidates of each session and the rows of their names up to the first price at or after the due exit, however late.
    """
    widest = configs.agg(F.max("k").alias("k"), F.max("hold").alias("hold")).first()
    chosen = top_k(panel.where("eligible"), score, widest["k"] or 0).select("id", F.col("session").alias("at"), "place")
    rows = panel.select("id", "session", "open", "close").join(chosen.withColumnRenamed("at", "session"), ["id", "session"], "left")
    # a row can be traded if none of the name's rows lies between the due exit of its last choice and itself
    earlier = Window.partitionBy("id").orderBy("session").rowsBetween(Window.unboundedPreceding, -1)
    due = F.max(F.when(F.col("place").isNotNull(), F.col("session") + (widest["hold"] or 0))).over(earlier)
    rows = rows.withColumn("_due", due).withColumn("_before", F.max("session").over(earlier))
    rows = rows.where(F.col("place").isNotNull() | (F.col("_before") < F.col("_due"))).drop("_due", "_before")
    runs = configs.crossJoin(panel.agg(F.max("session").alias("last")))  # one row for each configuration
    grouped = rows.crossJoin(F.broadcast(runs))

    def fold(df: pd.DataFrame) -> pd.DataFrame:
        run = df.iloc[0]
        costs = Costs().scaled(float(run["cost_factor"]))
        by = {s: g for s, g in df.sort_values(["session", "place", "id"]).groupby("session")}
        cash, held, pending, out = float(run["capital"]), {}, [], []
        for s in range(int(min(by)), int(run["last"]) + 1):
            today = by.get(s)
            prices = {} if today is None else {r.id: (r.open, r.close) for r in today.itertuples()}
            for name, budget in pending:
                if name in prices and prices[name][0] > 0:
                    q = costs.affordable(prices[name][0], min(budget, cash))
                    if q:
                        cash -= costs.buy(prices[name][0], q)[1]
                        held[name] = [q, s + int(run["hold"]) - 1, prices[name][1]]
            pending = []
            for name in list(held):
                if name in prices:
                    held[name][2] = prices[name][1]
                    if s >= held[name][1]:
                        cash += costs.sell(prices[name][1], held[name][0])[1]
                        del held[name]
            value = sum(q * px for q, _, px in held.values())
            out.append((run["config"], s, cash + value, cash, len(held)))
            if not held and today is not None and s + int(run["hold"]) < int(run["last"]):
                best = today[today["place"] <= run["k"]].sort_values("place")
                pending = [(n, cash / int(run["k"])) for n in best["id"]]
        if held and out:
            out[-1] = (run["config"], out[-1][1], cash, cash, 0)
        return pd.DataFrame(out, columns=["config", "session", "equity", "cash", "n_held"])

    return grouped.groupBy("config").applyInPandas(fold, "config long, session long, equity double, cash double, n_held long")


def drawdowns(curve: DataFrame, key: str, at: str, x: str) -> DataFrame:
    """Running peak, drawdown and rows since the last peak."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    q = curve.withColumn("peak", F.max(x).over(w)).withColumn("drawdown", F.col(x) / F.col("peak") - 1)
    under = F.col(x) < F.col("peak") * (1 - 1e-12)
    q = q.withColumn("_g", F.sum((~under).cast("int")).over(w))
    rows = Window.partitionBy(key, "_g").orderBy(at)
    return q.withColumn("under_water", F.when(under, F.row_number().over(rows) - F.when(F.col("_g") == 0, 0).otherwise(1)).otherwise(0).cast("long")).drop("_g")


def curve_metrics(curve: DataFrame, key: str, at: str, x: str, per_year: float) -> DataFrame:
    """One row for each curve: growth, deviation, Sharpe, Sortino, drawdown, tail and win statistics."""
    w = Window.partitionBy(key).orderBy(at)
    q = drawdowns(curve, key, at, x).withColumn("ret", F.col(x) / F.lag(x).over(w) - 1)
    s = q.groupBy(key).agg(
        F.count("ret").alias("n"),
        F.min_by(x, at).alias("first"),
        F.max_by(x, at).alias("final"),
        F.avg("ret").alias("mean"),
        F.stddev_samp("ret").alias("dev"),
        F.sqrt(F.avg(F.when(F.col("ret").isNotNull(), F.pow(F.least(F.col("ret"), F.lit(0.0)), 2)))).alias("down"),
        F.min("drawdown").alias("max_drawdown"),
        F.max("under_water").alias("longest_under_water"),
        F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"),
        F.percentile("ret", F.lit(0.05)).alias("var_95"),
    )
    years = F.col("n") / per_year
    growth = F.when((F.col("n") > 0) & (F.col("first") > 0), F.pow(F.col("final") / F.col("first"), 1 / years) - 1)
    return s.select(
        key,
        "n",
        (F.col("final") / F.col("first") - 1).alias("total_return"),
        growth.alias("cagr"),
        (F.col("dev") * per_year**0.5).alias("volatility"),
        (ratio("mean", "dev", 1e-12) * per_year**0.5).alias("sharpe"),
        (ratio("mean", "down", 1e-12) * per_year**0.5).alias("sortino"),
        "max_drawdown",
        "longest_under_water",
        "win_rate",
        "var_95",
    )


def benchmark_relative(curve: DataFrame, key: str, x: str, m: str, per_year: float) -> DataFrame:
    """Beta, annual alpha, tracking error, information ratio and correlation over rows with both returns; null below three."""
    both = curve.where(F.col(x).isNotNull() & F.col(m).isNotNull())
    s = both.groupBy(key).agg(F.count("*").alias("n"), F.covar_samp(x, m).alias("cov"), F.var_samp(m).alias("var"), F.avg(x).alias("mx"), F.avg(m).alias("mm"), F.stddev_samp(F.col(x) - F.col(m)).alias("te"), correlation(x, m).alias("corr"))
    enough = F.col("n") >= 3
    beta = F.when(enough & (F.col("var") > 1e-12), F.col("cov") / F.col("var"))
    return s.select(key, "n", beta.alias("beta"), ((F.col("mx") - beta * F.col("mm")) * per_year).alias("alpha"), F.when(enough, F.col("te") * per_year**0.5).alias("tracking_error"), F.when(enough, ratio(F.col("mx") - F.col("mm"), "te", 1e-12) * per_year**0.5).alias("information_ratio"), F.when(enough, F.col("corr")).alias("correlation"))


def block_bootstrap(returns: DataFrame, x: str, order: str, reps: int, block: int, seed: int) -> DataFrame:
    """rep, mean and sharpe (by row) of each replicate of a moving-block bootstrap of one series, drawn as in ``resampling``."""
    from saltern.operators.resampling import aligned, resampled

    places = aligned(returns.select(order, F.lit("own").alias("series"), F.col(x).alias("r")), order, "series", "r")
    n = places.count()
    rows = resampled(places, n, reps, block, seed, "own") if n else places.select(F.lit(0).cast("long").alias("rep"), F.lit(0.0).alias("r"))
    return rows.groupBy("rep").agg(F.avg("r").alias("mean"), F.try_divide(F.avg("r"), F.stddev_samp("r")).alias("sharpe"))


def persistent_backtest(panel: DataFrame, configs: DataFrame, score: str, widest: int | None = None) -> DataFrame:
    """Rank-buffer portfolios, one curve for each configuration (config, capital, k, hold_rank, every, min_gap, cost_factor).

    Every ``every`` sessions the eligible names are ranked. A holding stays while its rank is within ``hold_rank``, or
    while no candidate leads it by ``min_gap`` of percentile; the others are sold, and free slots filled in order of
    rank. Orders trade at the next session's open, sales before purchases; what has no price then stays pending one
    session and expires. The last session sells everything at its close. Runs spread over tasks; each gets the
    candidates that any configuration can hold and their rows, not the whole panel: names that were ever within
    ``widest``, twice the largest ``k`` unless given, as ``k`` holdings leave the ``k`` best others within it.
    """
    if widest is None:
        widest = 2 * (configs.agg(F.max("k")).first()[0] or 0)
    ranks = panel.where("eligible").select("id", "session", mean_share(score).alias("pct"), place_of(score).alias("place"))
    near = ranks.where(F.col("place") <= widest)
    rows = panel.join(near.select("id").distinct(), "id", "left_semi").select("id", "session", "open", "close")
    rows = rows.join(ranks, ["id", "session"], "left")
    grouped = rows.crossJoin(F.broadcast(configs))

    def fold(df: pd.DataFrame) -> pd.DataFrame:
        run = df.iloc[0]
        k, buffer, every, gap = int(run["k"]), int(run["hold_rank"]), int(run["every"]), float(run["min_gap"])
        costs = Costs().scaled(float(run["cost_factor"]))
        by = {s: g for s, g in df.sort_values(["session", "id"]).groupby("session")}
        first, last = int(min(by)), int(max(by))
        cash, held, sells, buys, out = float(run["capital"]), {}, [], [], []
        for s in range(first, last + 1):
            today = by.get(s)
            prices = {} if today is None else {r.id: (r.open, r.close) for r in today.itertuples()}
            traded = 0.0
            for name in sells:
                if name in held and name in prices:
                    got = costs.sell(prices[name][0], held[name][0])[1]
                    cash, traded = cash + got, traded + got
                    del held[name]
            for name, budget in buys:
                if name in prices and prices[name][0] > 0 and name not in held and len(held) < k:
                    q = costs.affordable(prices[name][0], min(budget, cash))
                    if q:
                        paid = costs.buy(prices[name][0], q)[1]
                        cash, traded = cash - paid, traded + paid
                        held[name] = [q, prices[name][1]]
            sells, buys = [], []
            for name in held:
                if name in prices:
                    held[name][1] = prices[name][1]
            equity = cash + sum(q * px for q, px in held.values())
            if s == last:
                for name, (q, px) in held.items():
                    cash += costs.sell(px, q)[1]
                equity, held = cash, {}
            elif today is not None and (s - first) % every == 0:
                ranked = today[today["place"].notna()].sort_values("place")
                pct, place = dict(zip(ranked["id"], ranked["pct"], strict=True)), dict(zip(ranked["id"], ranked["place"], strict=True))
                fresh = [n for n in ranked["id"] if n not in held][:k]
                for name in sorted(held, key=lambda n: place.get(n, 1e9), reverse=True):
                    rival = fresh[len(sells)] if len(sells) < len(fresh) else None
                    if place.get(name, 1e9) > buffer and (name not in pct or (rival and pct[rival] - pct[name] >= gap)):
                        sells.append(name)
                free = k - len(held) + len(sells)
                buys = [(n, equity / k) for n in fresh[:free]]
            out.append((run["config"], s, equity, cash, len(held), traded))
        return pd.DataFrame(out, columns=["config", "session", "equity", "cash", "n_held", "traded"])

    return grouped.groupBy("config").applyInPandas(fold, "config long, session long, equity double, cash double, n_held long, traded double")


def mean_share(score: str) -> Column:
    from saltern.functions.frames import percentile_rank

    return percentile_rank(score, "session")


def place_of(score: str) -> Column:
    w = Window.partitionBy("session").orderBy(F.desc_nulls_last(score), F.desc("turnover"), F.asc("id"))
    return F.when(F.col(score).isNotNull(), F.row_number().over(w))
