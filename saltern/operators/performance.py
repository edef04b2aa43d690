"""The full report of equity curves and their trades, and how curves go together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltern.functions.frames import correlation
from saltern.operators.aggregates import kurtosis, skewness


def daily(curve: DataFrame, key: str, at: str, date: str, x: str, invested: str | None = None) -> DataFrame:
    """key, date, at, value, invested, ret, drawdown, under (rows since the last peak), under_days (days since then).

    Values that are null or below zero go; of several rows of a date the last by ``at`` counts. A return needs a value
    above zero before it.
    """
    own = F.col(invested).cast("double") if invested else F.lit(None).cast("double")
    rows = curve.select(F.col(key).alias("key"), F.col(date).alias("date"), F.col(at).alias("at"), F.col(x).cast("double").alias("value"), own.alias("invested"))
    rows = rows.where((F.col("value") >= 0) & F.col("date").isNotNull() & ~F.isnan("value"))
    rows = rows.groupBy("key", "date").agg(F.max_by(F.struct("at", "value", "invested"), "at").alias("r")).select("key", "date", "r.*")
    w = Window.partitionBy("key").orderBy("date")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    before, peak = F.lag("value").over(w), F.max("value").over(run)
    q = rows.withColumns({"ret": F.when(before > 0, F.col("value") / before - 1), "peak": peak})
    q = q.withColumn("_under", F.col("value") < F.col("peak") * (1 - 1e-12))
    q = q.withColumn("_g", F.sum((~F.col("_under")).cast("int")).over(run))  # a stretch below a peak starts at its last row there
    stretch = Window.partitionBy("key", "_g").orderBy("date")
    under = F.when(F.col("_under"), F.row_number().over(stretch) - 1).otherwise(0)
    days = F.when(F.col("_under"), F.datediff("date", F.first("date").over(stretch))).otherwise(0)
    return q.withColumns({"drawdown": F.when(F.col("peak") > 0, F.col("value") / F.col("peak") - 1), "under": under, "under_days": days}).drop("_under", "_g")


def curve_report(rows: DataFrame, initial: float, per_year: float, risk_free: float = 0.0) -> DataFrame:
    """One row for each key of ``daily`` rows: growth, risk, tails, drawdowns, exposure."""
    if risk_free <= -1:
        raise ValueError("the risk-free rate must be above -100 %")
    rf = (1.0 + risk_free) ** (1.0 / per_year) - 1.0
    share = F.coalesce(F.when(F.col("value") > 0, F.col("invested") / F.col("value")), F.lit(0.0))
    low = F.when(F.col("ret").isNotNull(), F.least(F.col("ret") - rf, F.lit(0.0)))
    s = rows.groupBy("key").agg(
        F.max_by("value", "date").alias("ending_equity"),
        F.datediff(F.max("date"), F.min("date")).alias("_days"),
        F.count("ret").alias("n_returns"),
        F.avg("ret").alias("_mean"),
        F.stddev_samp("ret").alias("_dev"),
        F.sqrt(F.avg(low * low)).alias("_down"),
        F.percentile("ret", F.lit(0.05)).alias("var_95"),
        F.collect_list("ret").alias("_rets"),  # a value a session
        F.when(F.count("ret") >= 3, skewness("ret")).alias("skewness"),
        F.when(F.count("ret") >= 4, kurtosis("ret")).alias("excess_kurtosis"),
        F.max("ret").alias("best_day_return"),
        F.min("ret").alias("worst_day_return"),
        F.avg((F.col("ret") > 0).cast("double")).alias("positive_day_fraction"),
        F.min("drawdown").alias("max_drawdown"),
        F.max("under").cast("long").alias("max_drawdown_duration_sessions"),
        F.max("under_days").cast("long").alias("max_drawdown_duration_days"),
        F.max("value").alias("high_water_mark"),
        F.max(F.col("peak") - F.col("value")).alias("_fall"),
        F.count("invested").alias("_has"),
        F.avg(share).alias("_exposure"),
        F.max(share).alias("_most"),
    )
    years = F.greatest(F.col("_days") / 365.25, F.lit(1 / 365.25))
    s = s.withColumns({"years": years, "cagr": F.when(F.col("ending_equity") > 0, F.pow(F.col("ending_equity") / initial, 1 / years) - 1).otherwise(-1.0), "net_profit": F.col("ending_equity") - initial})
    moves = (F.col("n_returns") >= 2) & (F.col("_dev") > 0)
    tail = F.filter("_rets", lambda v: v <= F.col("var_95"))
    root = per_year**0.5
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return s.select(
        "key",
        F.lit(float(initial)).alias("starting_capital"),
        "ending_equity",
        "net_profit",
        (F.col("ending_equity") / initial - 1).alias("total_return"),
        "cagr",
        zero(F.col("_mean") * per_year).alias("annualized_arithmetic_return"),
        F.when(moves, F.col("_dev") * root).otherwise(0.0).alias("annualized_volatility"),
        F.when(moves, F.try_divide(F.col("_mean") - rf, "_dev") * root).otherwise(0.0).alias("sharpe"),
        zero(F.col("_down") * root).alias("downside_deviation"),
        F.when(F.col("_down") > 0, (F.col("_mean") - rf) * root / F.col("_down")).alias("sortino"),
        "max_drawdown",
        "max_drawdown_duration_sessions",
        "max_drawdown_duration_days",
        "high_water_mark",
        F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")).alias("calmar"),
        F.when(F.col("_fall") > 0, F.col("net_profit") / F.col("_fall")).alias("recovery_factor"),
        "var_95",
        F.try_divide(F.aggregate(tail, F.lit(0.0), lambda a, v: a + v), F.size(tail)).alias("cvar_95"),
        "skewness",
        "excess_kurtosis",
        "best_day_return",
        "worst_day_return",
        "positive_day_fraction",
        F.when(F.col("_has") > 0, F.col("_exposure")).otherwise(1.0).alias("average_exposure"),
        F.when(F.col("_has") > 0, F.col("_most")).otherwise(1.0).alias("max_exposure"),
        "years",
    )


def trade_report(trades: DataFrame, key: str) -> DataFrame:
    """One row for each key: how trades (net_pnl, net_return, total_fees, entry_trade_value, exit_trade_value) went."""
    pnl = F.col("net_pnl").cast("double")
    won, lost = F.when(pnl > 0, pnl), F.when(pnl < 0, pnl)
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    s = trades.groupBy(F.col(key).alias("key")).agg(
        F.count(F.lit(1)).alias("trades"),
        F.avg((pnl > 0).cast("double")).alias("win_rate"),
        F.avg(won).alias("average_win"),
        F.avg(lost).alias("average_loss"),
        F.avg(pnl).alias("expectancy_per_trade"),
        F.coalesce(F.sum(won), F.lit(0.0)).alias("_won"),
        F.sum(lost).alias("_lost"),
        F.avg(F.col("net_return").cast("double")).alias("average_trade_return"),
        F.sum(value("total_fees")).alias("total_fees"),
        F.sum(value("entry_trade_value") + value("exit_trade_value")).alias("turnover"),
    )
    payoff = F.col("average_win") / F.abs("average_loss")
    return s.withColumns({"payoff_ratio": payoff, "profit_factor": F.when(F.abs("_lost") > 0, F.col("_won") / F.abs("_lost"))}).drop("_won", "_lost")


def performance(rows: DataFrame, trades: DataFrame | None, key: str, initial: float, per_year: float = 252.0, risk_free: float = 0.0) -> DataFrame:
    """``curve_report`` of ``daily`` rows beside ``trade_report``; a curve without trades has none of them and no fees or turnover."""
    report = curve_report(rows, initial, per_year, risk_free)
    none = rows.sparkSession.createDataFrame([], "key long, net_pnl double, net_return double, total_fees double, entry_trade_value double, exit_trade_value double")
    made = trade_report(none, "key").withColumn("key", F.col("key").cast(report.schema["key"].dataType)) if trades is None else trade_report(trades, key)
    out = report.join(made, "key", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("trades", "total_fees", "turnover")})
    multiple = F.col("turnover") / initial
    return out.withColumns({"fees_pct_initial_capital": F.col("total_fees") / initial, "turnover_multiple": multiple, "annualized_turnover_multiple": multiple / F.col("years")}).drop("years").withColumnRenamed("key", key)


def pair_diagnostics(rows: DataFrame, depths: tuple[int, ...] = (10, 20)) -> DataFrame:
    """strategy_a, strategy_b, aligned_days, daily_return_corr, and the shares of days on which both, or either, are at least
    10 (20) percent under their peak. Rows are those of ``daily`` with a return; pairs meet by date; the correlation
    needs three days. There is a row for each two curves, so their number is a grid's, not the data's."""
    side = lambda s: rows.where("ret is not null").select("date", F.col("key").alias(f"strategy_{s}"), F.col("ret").alias(f"ret_{s}"), F.col("drawdown").alias(f"dd_{s}"))
    both = side("a").join(side("b"), "date").where("strategy_a < strategy_b")

    def fraction(condition: Column) -> Column:
        return F.avg(condition.cast("double"))

    under = lambda s, k: F.coalesce(F.col(f"dd_{s}") <= -k / 100, F.lit(False))
    parts = [F.count("*").alias("aligned_days"), F.when(F.count("*") >= 3, correlation("ret_a", "ret_b")).alias("daily_return_corr")]
    for k in depths:
        parts += [fraction(under("a", k) & under("b", k)).alias(f"both_under_{k}pct_fraction"), fraction(under("a", k) | under("b", k)).alias(f"either_under_{k}pct_fraction")]
    return both.groupBy("strategy_a", "strategy_b").agg(*parts)
