"""Features of a security-by-session panel. Inputs have ``id``, ``session`` and the named columns; no look ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltern.functions.frames import MOMENTS, col, exact_lag, exact_lead, flag, last_rows, many_pair_moments, median, pair_correlation, pair_moments, percentile_rank, ratio, rolling, rows_of

KEY, ORDER = "id", "session"


def own_rows():
    return rows_of(KEY, ORDER)


def gap_intraday_range(p: DataFrame) -> DataFrame:
    before = exact_lag("close", 1, ORDER, own_rows())
    return p.withColumns({"gap": ratio(F.col("open"), before) - 1, "intraday": ratio("close", "open") - 1, "range_pct": ratio(F.col("high") - F.col("low"), "open")})


def moving_average_distance(p: DataFrame, size: int, least: int) -> DataFrame:
    return p.withColumn(f"ma_distance_{size}", ratio(F.col("close"), rolling(F.avg, "close", size, least, KEY, ORDER)) - 1)


def volatility(p: DataFrame, size: int, least: int, x: str = "return_1") -> DataFrame:
    return p.withColumn(f"volatility_{size}", rolling(F.stddev_samp, x, size, least, KEY, ORDER))


def median_turnover(p: DataFrame, size: int, least: int) -> DataFrame:
    return p.withColumn(f"turnover_median_{size}", rolling(median, "turnover", size, least, KEY, ORDER))


def zscore(p: DataFrame, x: str, size: int, least: int) -> DataFrame:
    mean, dev = rolling(F.avg, x, size, least, KEY, ORDER), rolling(F.stddev_samp, x, size, least, KEY, ORDER)
    return p.withColumn(f"{x}_z{size}", ratio(F.col(x) - mean, dev, 1e-12))


def completeness(p: DataFrame, size: int) -> DataFrame:
    """Rows among the last ``size`` sessions, and whether all are there."""
    recent = own_rows().rangeBetween(-(size - 1), 0)
    n = F.count("*").over(recent)
    return p.withColumns({f"present_{size}": n, f"complete_{size}": n == size, "history": F.row_number().over(own_rows()).cast("long")})


def forward_target(p: DataFrame, k: int) -> DataFrame:
    """Return from the next session's open to the close k sessions ahead, if all sessions in between are present."""
    w = own_rows()
    entry, leave = exact_lead("open", 1, ORDER, w), exact_lead("close", k, ORDER, w)
    return p.withColumn(f"target_{k}", F.when(leave.isNotNull() & (entry > 0), leave / entry - 1))


def target_rank(p: DataFrame, k: int) -> DataFrame:
    return p.withColumn(f"target_rank_{k}", percentile_rank(f"target_{k}", ORDER))


def universe(p: DataFrame, history: int, price: float, turnover: float, active: float, sessions: int, size: int) -> DataFrame:
    """The eligibility flags and their conjunction; unknown values fail."""
    q = completeness(median_turnover(p, size, size // 2), sessions)
    seen = F.count("*").over(own_rows().rangeBetween(-(size - 1), 0)) / F.least(F.lit(size), F.col("session") + 1)
    q = q.withColumns(
        {
            "enough_history": flag(F.col("history") >= history),
            "enough_price": flag(F.col("close") >= price),
            "enough_turnover": flag(F.col(f"turnover_median_{size}") >= turnover),
            "enough_active": flag(seen >= active),
            "enough_sessions": flag(F.col(f"complete_{sessions}")),
        }
    )
    every = ["enough_history", "enough_price", "enough_turnover", "enough_active", "enough_sessions"]
    return q.withColumn("eligible", F.expr(" and ".join(every)))


def geometry(p: DataFrame, signed: bool) -> DataFrame:
    """Shape of a bar; ``signed`` keeps the body's sign."""
    span, body = F.col("high") - F.col("low"), F.col("close") - F.col("open")
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return p.withColumns(
        {
            "body_to_range": ratio(body if signed else F.abs(body), span, 1e-12),
            "upper_wick": ratio(F.col("high") - top, span, 1e-12),
            "lower_wick": ratio(bottom - F.col("low"), span, 1e-12),
            "close_position": ratio(F.col("close") - F.col("low"), span, 1e-12),
        }
    )


def position_in_range(p: DataFrame, size: int, least: int) -> DataFrame:
    top, low = rolling(F.max, "high", size, least, KEY, ORDER), rolling(F.min, "low", size, least, KEY, ORDER)
    return p.withColumns({f"position_{size}": ratio(F.col("close") - low, top - low, 1e-12), f"drawdown_{size}": ratio(F.col("close"), top) - 1})


def signed_streak(p: DataFrame, x: str, name: str) -> DataFrame:
    """Length of the current run of one sign, with that sign; zero where the value is null or vanishes."""
    w = own_rows()
    sign = F.when(F.col(x).isNull() | (F.abs(F.col(x)) <= 1e-15), 0).otherwise(F.signum(x)).cast("int")
    q = p.withColumn("_s", sign)
    q = q.withColumn("_g", F.sum((F.col("_s") != F.coalesce(F.lag("_s").over(w), F.lit(9))).cast("int")).over(w))
    return q.withColumn(name, (F.col("_s") * F.row_number().over(rows_of([KEY, "_g"], ORDER))).cast("long")).drop("_s", "_g")


def true_streak(p: DataFrame, condition: Column, name: str) -> DataFrame:
    """Consecutive rows, up to this one, in which the condition holds."""
    q = p.withColumn("_c", flag(condition).cast("int"))
    q = q.withColumn("_g", F.sum(1 - F.col("_c")).over(own_rows()))
    return q.withColumn(name, F.when(F.col("_c") == 1, F.sum("_c").over(rows_of([KEY, "_g"], ORDER))).otherwise(0).cast("long")).drop("_c", "_g")


def streak_lengths(p: DataFrame, signed: dict[str, Column], true: dict[str, Column]) -> DataFrame:
    """Many streaks from one ordering of each security's rows: what ``signed_streak`` and ``true_streak`` give one by one.

    ``signed`` maps names to values whose sign runs, ``true`` maps names to conditions. A run begins where the sign changes
    or after the last row that fails, so its length is a difference of row numbers. Null, NaN and tiny values have sign 0;
    a condition fails where it is null, and sees NaN as Spark does, above all numbers.
    """
    w = own_rows()
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    sign = lambda x: F.when(x.isNull() | F.isnan(x.cast("double")) | (F.abs(x) <= 1e-15), 0).otherwise(F.signum(x)).cast("int")
    q = p.withColumns({"_at": F.row_number().over(w)} | {f"_s_{n}": sign(x) for n, x in signed.items()} | {f"_c_{n}": flag(c) for n, c in true.items()})
    q = q.withColumns({f"_p_{n}": F.coalesce(F.lag(f"_s_{n}").over(w), F.lit(9)) for n in signed} | {"_0": F.lit(0)})
    begun = {f"_b_{n}": F.max(F.when(F.col(f"_s_{n}") != F.col(f"_p_{n}"), F.col("_at"))).over(run) for n in signed}
    failed = {f"_f_{n}": F.max(F.when(~F.col(f"_c_{n}"), F.col("_at"))).over(run) for n in true}
    q = q.withColumns(begun | failed)
    out = {n: (F.col(f"_s_{n}") * (F.col("_at") - F.col(f"_b_{n}") + 1)).cast("long") for n in signed}
    out |= {n: (F.col("_at") - F.coalesce(F.col(f"_f_{n}"), F.col("_0"))).cast("long") for n in true}
    return q.withColumns(out).drop("_at", "_0", *[f"_{k}_{n}" for n in signed for k in "spb"], *[f"_{k}_{n}" for n in true for k in "cf"])


def price_streaks(p: DataFrame) -> DataFrame:
    """The five signed and six consecutive streaks of a bar panel, against the row before whatever session it is of.

    A price that is null or NaN has no sign and meets no condition.
    """
    names = ("open", "high", "low", "close")
    q = p.withColumns({f"_now_{c}": F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in names})
    q = q.withColumns({f"_before_{c}": F.lag(f"_now_{c}").over(own_rows()) for c in names[1:]})
    (o, h, l, c), (ph, pl, pc) = [F.col(f"_now_{n}") for n in names], [F.col(f"_before_{n}") for n in names[1:]]
    change, intraday = ratio(c, pc) - 1, F.when(o > 0, c / o - 1)
    up = {"close_streak": change, "intraday_streak": intraday, "high_streak": h - ph, "low_streak": l - pl, "gap_streak": ratio(o, pc) - 1}
    runs = {"up_close": change > 0, "down_close": change < 0, "bullish": intraday > 0, "bearish": intraday < 0, "higher_high": h > ph, "lower_low": l < pl}
    return streak_lengths(q, up, {f"{n}_run": x for n, x in runs.items()}).drop(*[f"_now_{n}" for n in names], *[f"_before_{n}" for n in names[1:]])


def streak_history(p: DataFrame, streak: str, x: str, least: int = 3) -> DataFrame:
    """How the next return went after earlier rows of the same streak: mean and share above zero, known before this row."""
    after = p.withColumn("_next", exact_lead(x, 1, ORDER, own_rows()))
    # the outcome of a row becomes known one row later, so this row's own is left out
    before = rows_of([KEY, streak], ORDER).rowsBetween(Window.unboundedPreceding, -1)
    n = F.count("_next").over(before)
    mean = F.when(n >= least, F.avg("_next").over(before))
    won = F.when(n >= least, F.avg((F.col("_next") > 0).cast("double")).over(before))
    return after.withColumns({"history_n": n, "history_mean": mean, "history_win": won}).drop("_next")


def conditional_streak_history(p: DataFrame, state: str, x: str, name: str, least: int = 5, most: int = 5) -> DataFrame:
    """What ``x`` was after earlier rows of the state that this row is in: columns ``name`` and _mean, _up_prob and _count.

    States are cut to 0 to ``most``, null counts as 0, and rows in state 0 have no history (count 0). A value belongs to the
    state of the row before it, so that of this row is known when the row is. Mean and share above zero are null below
    ``least`` values; a null or NaN value counts nowhere.
    """
    w = own_rows()
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    cut = lambda c: F.greatest(F.least(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(float(most))), F.lit(0.0)).cast("int")
    value = F.when(~F.isnan(F.col(x).cast("double")), F.col(x).cast("double"))
    q = p.withColumns({"_now": cut(F.col(state)), "_before": F.coalesce(F.lag(cut(F.col(state))).over(w), F.lit(0)), "_x": value})
    matched = lambda b, c: F.when((F.col("_before") == b) & F.col("_x").isNotNull(), c)
    sums = {}
    for b in range(1, most + 1):
        sums |= {f"_n{b}": F.count(matched(b, F.col("_x"))).over(run), f"_s{b}": F.sum(matched(b, F.col("_x"))).over(run), f"_u{b}": F.count(matched(b, F.when(F.col("_x") > 0, 1))).over(run)}
    q = q.withColumns(sums)

    def own(letter: str) -> Column:
        c = F.lit(None)
        for b in range(1, most + 1):
            c = F.when(F.col("_now") == b, F.col(f"_{letter}{b}")).otherwise(c)
        return c

    n = F.coalesce(own("n"), F.lit(0))
    out = {f"{name}_mean": F.when(n >= least, own("s") / n), f"{name}_up_prob": F.when(n >= least, own("u") / n), f"{name}_count": n.cast("long")}
    return q.withColumns(out).drop("_now", "_before", "_x", *sums)


def tendency(p: DataFrame, x: str, size: int, least: int) -> DataFrame:
    up = F.when(F.col(x).isNotNull(), (F.col(x) > 0).cast("double"))
    return p.withColumn(f"up_share_{size}", rolling(F.avg, up, size, least, KEY, ORDER))


def beta_population(p: DataFrame, x: str, m: str, size: int, least: int) -> DataFrame:
    """Population covariance over population variance of the market, over rows that have both."""
    q = pair_moments(p, x, m, size, KEY, ORDER, "_k_")
    beta = F.when((F.col("_k_n") >= least) & (F.col("_k_mm") > 1e-12 * F.col("_k_n")), F.col("_k_xm") / F.col("_k_mm"))
    return q.withColumn(f"beta_{size}", beta).drop(*[f"_k_{k}" for k in MOMENTS])


def correlation_mixed(p: DataFrame, x: str, m: str, size: int, least: int) -> DataFrame:
    """Population covariance over the product of sample deviations, means over each column's own values, within one.

    The moments of both and of each column alone come from one ordering, so the work doesn't grow with the window. A value
    that is not finite is missing.
    """
    q = many_pair_moments(p, {"_k_": (x, m), "_x_": (x, x), "_m_": (m, m)}, size, KEY, ORDER)
    cov = F.try_divide(F.col("_k_xm"), F.col("_k_n")) + F.col("_k_ax") * F.col("_k_am") - F.col("_x_ax") * F.col("_m_ax")
    dev = F.sqrt(F.try_divide(F.col("_x_xx"), F.col("_x_n") - 1)) * F.sqrt(F.try_divide(F.col("_m_xx"), F.col("_m_n") - 1))
    raw = F.when((F.col("_k_n") >= least) & (dev > 1e-12), F.try_divide(cov, dev))
    q = q.withColumn("_raw", raw).withColumn(f"corr_{size}", F.when(F.col("_raw") > 1, 1.0).when(F.col("_raw") < -1, -1.0).otherwise(F.col("_raw")))
    return q.drop("_raw", *[f"{k}{c}" for k in ("_k_", "_x_", "_m_") for c in MOMENTS])


def correlation_sample(p: DataFrame, x: str, m: str, size: int, least: int) -> DataFrame:
    """Pairwise sample correlation and beta; the beta's variance is over the other column's own values."""
    enough = F.col("_k_n") >= least
    cov, var = F.try_divide(F.col("_k_xm"), F.col("_k_n") - 1), F.try_divide(F.col("_k_mm_own"), F.col("_k_n_own") - 1)
    q = pair_moments(p, x, m, size, KEY, ORDER, "_k_").withColumns({"_cov": cov, "_var": var})
    out = {f"pair_corr_{size}": F.when(enough, pair_correlation("_k_")), f"pair_beta_{size}": F.when(enough & (F.col("_var") > 1e-12), F.col("_cov") / F.col("_var"))}
    return q.withColumns(out).drop("_cov", "_var", *[f"_k_{k}" for k in MOMENTS])


def lead_lag(p: DataFrame, x: str, m: str, lag: int | tuple[int, ...], size: int, least: int) -> DataFrame:
    """Correlation with the other series some rows ago; several lags share one ordering."""
    lags = (lag,) if isinstance(lag, int) else tuple(lag)
    before = {f"_before_{k}": F.lag(m, k).over(own_rows()) for k in lags}
    q = many_pair_moments(p.withColumns(before), {f"_k_{k}_": (x, f"_before_{k}") for k in lags}, size, KEY, ORDER)
    out = {f"lead_corr_{k}": F.when(F.col(f"_k_{k}_n") >= least, pair_correlation(f"_k_{k}_")) for k in lags}
    return q.withColumns(out).drop(*before, *[f"_k_{k}_{c}" for k in lags for c in MOMENTS])


def relative_strength(p: DataFrame, x: str, m: str) -> DataFrame:
    return p.withColumn(f"{x}_relative", F.col(x) - F.col(m))


def illiquidity(p: DataFrame, size: int, least: int) -> DataFrame:
    """Mean of absolute return per million of turnover, and the deviation of log turnover."""
    per = ratio(F.abs("return_1") * 1e6, "turnover")
    logs = F.log1p(F.greatest(F.col("turnover"), F.lit(0.0)))
    return p.withColumns({f"illiquidity_{size}": rolling(F.avg, per, size, least, KEY, ORDER), f"turnover_deviation_{size}": rolling(F.stddev_samp, logs, size, least, KEY, ORDER)})


def downside(p: DataFrame, x: str, size: int, least: int) -> DataFrame:
    low = F.when(F.col(x).isNotNull(), F.least(F.col(x), F.lit(0.0)))
    return p.withColumn(f"downside_{size}", F.sqrt(rolling(F.avg, low * low, size, least, KEY, ORDER)))


def calendar(p: DataFrame, date: str = "date") -> DataFrame:
    """Monday is 0; month, quarter and (March) year ends are those of the calendar, in both senses of the year end."""
    last = F.col(date) == F.last_day(date)
    month = F.month(date)
    return p.withColumns(
        {
            "day_of_week": F.weekday(date),
            "month": month,
            "is_month_end": last,
            "is_quarter_end": last & (month % 3 == 0),
            "march": month == 3,
            "march_end": last & (month == 3),
            "week_label": F.next_day(F.date_sub(date, 1), "Fri"),
        }
    )


def percentile_in_history(p: DataFrame, x: str, size: int, least: int) -> DataFrame:
    """Mean-rank share of the current value among the last ``size`` of one series; for dimension-sized series."""
    w = Window.orderBy(ORDER).rowsBetween(-(size - 1), 0)
    seen = F.collect_list(x).over(w)
    less = F.size(F.filter(seen, lambda v: v < F.col(x)))
    equal = F.size(F.filter(seen, lambda v: v == F.col(x)))
    return p.withColumn(f"{x}_percentile", F.when((F.size(seen) >= least) & F.col(x).isNotNull(), (less + (equal + 1) / 2) / F.size(seen)))


def sequences(p: DataFrame, x: list[str], size: int) -> DataFrame:
    """The last ``size`` rows of the features as one array, where all sessions are there."""
    w = own_rows()
    whole = F.lag(ORDER, size - 1).over(w) == F.col(ORDER) - (size - 1)
    return p.withColumn("sequence", F.when(whole, F.collect_list(F.array(*[col(c) for c in x])).over(last_rows(KEY, ORDER, size))))
