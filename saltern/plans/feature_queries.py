"""Panel features and universe rules over the supplier panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltern.functions.frames import percentile_rank
from saltern.operators import features as ft
from saltern.plans.panel import MARKET, RETURNS, SUPPLIER_PANEL, market, returns, rounded, supplier_panel
from saltern.plans.registry import Registry, r

REG = Registry()
W = "WINDOW w AS (PARTITION BY id ORDER BY session)"


def rows(n: int) -> str:
    return f"(PARTITION BY id ORDER BY session ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def guarded(agg: str, x: str, n: int, least: int) -> str:
    return f"CASE WHEN count({x}) OVER {rows(n)} >= {least} THEN {agg} OVER {rows(n)} END"


@REG.add("panel_build", f"WITH {SUPPLIER_PANEL} SELECT id, date, session, {r('open', 'open', 9)}, {r('high', 'high', 9)}, {r('low', 'low', 9)}, {r('close', 'close', 9)}, {r('volume', 'volume', 9)}, {r('turnover', 'turnover', 9)} FROM panel")
def panel_build(spark, d):
    # prices are cents over whole quantities: nine places leave no ties to round
    return rounded(supplier_panel(spark, d).select("id", "date", "session", "open", "high", "low", "close", "volume", "turnover"), 9)


@REG.add("session_index", f"WITH {SUPPLIER_PANEL} SELECT date, session, count(*) AS n FROM panel GROUP BY date, session")
def session_index(spark, d):
    return supplier_panel(spark, d).groupBy("date", "session").agg(F.count("*").alias("n"))


@REG.add("exact_session_returns", f"WITH {RETURNS} SELECT id, session, {r('return_1', 'return_1')}, {r('return_5', 'return_5')}, {r('return_20', 'return_20')} FROM returns")
def exact_session_returns(spark, d):
    return rounded(returns(spark, d).select("id", "session", "return_1", "return_5", "return_20"))


@REG.add(
    "gap_intraday_range",
    f"""WITH {SUPPLIER_PANEL} SELECT id, session, {r("CASE WHEN lag(session) OVER w = session - 1 AND abs(lag(close) OVER w) > 0 THEN open / lag(close) OVER w - 1 END", "gap")},
    {r("CASE WHEN abs(open) > 0 THEN close / open - 1 END", "intraday")}, {r("CASE WHEN abs(open) > 0 THEN (high - low) / open END", "range_pct")} FROM panel {W}""",
)
def gap_intraday_range(spark, d):
    return rounded(ft.gap_intraday_range(supplier_panel(spark, d)).select("id", "session", "gap", "intraday", "range_pct"))


_MA = lambda n, least: r(f"close / ({guarded('avg(close)', 'close', n, least)}) - 1", f"ma_distance_{n}")


@REG.add("rolling_ma_distance", f"WITH {SUPPLIER_PANEL} SELECT id, session, {_MA(5, 3)}, {_MA(20, 10)}, {_MA(60, 30)} FROM panel")
def rolling_ma_distance(spark, d):
    p = supplier_panel(spark, d)
    for n, least in ((5, 3), (20, 10), (60, 30)):
        p = ft.moving_average_distance(p, n, least)
    return rounded(p.select("id", "session", "ma_distance_5", "ma_distance_20", "ma_distance_60"))


@REG.add("rolling_volatility", f"WITH {RETURNS} SELECT id, session, {r(guarded('stddev_samp(return_1)', 'return_1', 20, 10), 'volatility_20')}, {r(guarded('stddev_samp(return_1)', 'return_1', 60, 30), 'volatility_60')} FROM returns")
def rolling_volatility(spark, d):
    p = ft.volatility(ft.volatility(returns(spark, d), 20, 10), 60, 30)
    return rounded(p.select("id", "session", "volatility_20", "volatility_60"))


@REG.add("rolling_median_turnover", f"WITH {SUPPLIER_PANEL} SELECT id, session, {r(guarded('median(turnover)', 'turnover', 20, 10), 'turnover_median_20')} FROM panel")
def rolling_median_turnover(spark, d):
    return rounded(ft.median_turnover(supplier_panel(spark, d), 20, 10).select("id", "session", "turnover_median_20"))


@REG.add(
    "zscores",
    f"""WITH {SUPPLIER_PANEL}, m AS (SELECT id, session, turnover, {guarded("avg(turnover)", "turnover", 20, 10)} AS a, {guarded("stddev_samp(turnover)", "turnover", 20, 10)} AS s FROM panel)
    SELECT id, session, {r("CASE WHEN abs(s) > 1e-12 THEN (turnover - a) / s END", "turnover_z20")} FROM m""",
)
def zscores(spark, d):
    return rounded(ft.zscore(supplier_panel(spark, d), "turnover", 20, 10).select("id", "session", "turnover_z20"))


@REG.add(
    "completeness",
    f"""WITH {SUPPLIER_PANEL} SELECT id, session, count(*) OVER g AS present_20, count(*) OVER g = 20 AS complete_20, row_number() OVER w AS history
    FROM panel WINDOW w AS (PARTITION BY id ORDER BY session), g AS (PARTITION BY id ORDER BY session RANGE BETWEEN 19 PRECEDING AND CURRENT ROW)""",
)
def completeness(spark, d):
    return ft.completeness(supplier_panel(spark, d), 20).select("id", "session", "present_20", "complete_20", "history")


def _target(k: int) -> str:
    return f"CASE WHEN lead(session, 1) OVER w = session + 1 AND lead(open, 1) OVER w > 0 AND lead(session, {k}) OVER w = session + {k} THEN lead(close, {k}) OVER w / lead(open, 1) OVER w - 1 END"


TARGETS = f"{SUPPLIER_PANEL}, targets AS (SELECT *, {_target(3)} AS target_3, {_target(5)} AS target_5 FROM panel {W})"


@REG.add(
    "forward_targets",
    f"""WITH {TARGETS} SELECT id, session, {r("target_3", "target_3")}, {r("target_5", "target_5")},
    {r("CASE WHEN target_5 IS NOT NULL THEN (rank() OVER (PARTITION BY session ORDER BY target_5 NULLS LAST) + (count(target_5) OVER (PARTITION BY session, target_5) - 1) / 2.0) / count(target_5) OVER (PARTITION BY session) END", "target_rank_5")} FROM targets""",
)
def forward_targets(spark, d):
    p = ft.target_rank(ft.forward_target(ft.forward_target(supplier_panel(spark, d), 3), 5), 5)
    return rounded(p.select("id", "session", "target_3", "target_5", "target_rank_5"))


UNIVERSE = f"""{SUPPLIER_PANEL}, u0 AS (SELECT id, session, close, {guarded("median(turnover)", "turnover", 20, 10)} AS tm,
    count(*) OVER (PARTITION BY id ORDER BY session RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 AS complete,
    count(*) OVER (PARTITION BY id ORDER BY session RANGE BETWEEN 19 PRECEDING AND CURRENT ROW) / least(20, session + 1) AS seen, row_number() OVER w AS history FROM panel {W}),
universe AS (SELECT id, session, coalesce(history >= 30, false) AS enough_history, coalesce(close >= 10, false) AS enough_price, coalesce(tm >= 30000, false) AS enough_turnover,
    coalesce(seen >= 0.7, false) AS enough_active, coalesce(complete, false) AS enough_sessions FROM u0)"""


def universe_panel(spark, d):
    return ft.universe(supplier_panel(spark, d), 30, 10, 30000, 0.7, 5, 20)


@REG.add("universe_flags", f"WITH {UNIVERSE} SELECT *, enough_history AND enough_price AND enough_turnover AND enough_active AND enough_sessions AS eligible FROM universe")
def universe_flags(spark, d):
    return universe_panel(spark, d).select("id", "session", "enough_history", "enough_price", "enough_turnover", "enough_active", "enough_sessions", "eligible")


@REG.add(
    "training_flags",
    f"""WITH {UNIVERSE}, t AS (SELECT id, session, {_target(3)} AS target_3 FROM panel {W})
    SELECT u.id, u.session, target_3 IS NOT NULL AS target_usable, target_3 IS NOT NULL AND enough_history AND enough_price AND enough_turnover AND enough_active AND enough_sessions AS training_eligible FROM universe u JOIN t USING (id, session)""",
)
def training_flags(spark, d):
    p = ft.forward_target(universe_panel(spark, d), 3)
    return p.select("id", "session", F.col("target_3").isNotNull().alias("target_usable"), (F.col("target_3").isNotNull() & F.col("eligible")).alias("training_eligible"))


@REG.add(
    "split_masks",
    f"""WITH {SUPPLIER_PANEL}, c AS (SELECT max(session) FILTER (date <= DATE '1998-12-31') AS a, max(session) FILTER (date <= DATE '1999-12-31') AS b FROM panel)
    SELECT id, session, date <= DATE '1998-12-31' AND session <= a - 20 AS is_train, date > DATE '1998-12-31' AND date <= DATE '1999-12-31' AND session <= b - 20 AS is_validation, date > DATE '1999-12-31' AS is_test FROM panel, c""",
)
def split_masks(spark, d):
    p = supplier_panel(spark, d)
    last = lambda day: F.max(F.when(F.col("date") <= F.lit(day).cast("date"), F.col("session")))
    cuts = p.agg(last("1998-12-31").alias("a"), last("1999-12-31").alias("b"))  # one row
    q = p.crossJoin(F.broadcast(cuts))
    a, b = F.lit("1998-12-31").cast("date"), F.lit("1999-12-31").cast("date")
    day = F.col("date")
    return q.select("id", "session", ((day <= a) & (F.col("session") <= F.col("a") - 20)).alias("is_train"), ((day > a) & (day <= b) & (F.col("session") <= F.col("b") - 20)).alias("is_validation"), (day > b).alias("is_test"))


def _geometry(signed: bool) -> str:
    body = "close - open" if signed else "abs(close - open)"
    part = lambda x, n: r(f"CASE WHEN abs(high - low) > 1e-12 THEN ({x}) / (high - low) END", n)
    return f"WITH {SUPPLIER_PANEL} SELECT id, session, {part(body, 'body_to_range')}, {part('high - greatest(open, close)', 'upper_wick')}, {part('least(open, close) - low', 'lower_wick')}, {part('close - low', 'close_position')} FROM panel"


@REG.add("ohlc_geometry_absolute", _geometry(False))
def ohlc_geometry_absolute(spark, d):
    return rounded(ft.geometry(supplier_panel(spark, d), False).select("id", "session", "body_to_range", "upper_wick", "lower_wick", "close_position"))


@REG.add("ohlc_geometry_signed", _geometry(True))
def ohlc_geometry_signed(spark, d):
    return rounded(ft.geometry(supplier_panel(spark, d), True).select("id", "session", "body_to_range", "upper_wick", "lower_wick", "close_position"))


@REG.add(
    "position_in_range",
    f"""WITH {SUPPLIER_PANEL}, x AS (SELECT id, session, close, {guarded("max(high)", "high", 20, 10)} AS t, {guarded("min(low)", "low", 20, 10)} AS b FROM panel)
    SELECT id, session, {r("CASE WHEN abs(t - b) > 1e-12 THEN (close - b) / (t - b) END", "position_20")}, {r("CASE WHEN abs(t) > 0 THEN close / t - 1 END", "drawdown_20")} FROM x""",
)
def position_in_range(spark, d):
    return rounded(ft.position_in_range(supplier_panel(spark, d), 20, 10).select("id", "session", "position_20", "drawdown_20"))


STREAKS = f"""{RETURNS}, s0 AS (SELECT *, CASE WHEN return_1 IS NULL OR abs(return_1) <= 1e-15 THEN 0 ELSE sign(return_1) END AS s FROM returns),
s1 AS (SELECT *, sum(CASE WHEN s <> coalesce(ps, 9) THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY session) AS g FROM (SELECT *, lag(s) OVER (PARTITION BY id ORDER BY session) AS ps FROM s0)),
streaks AS (SELECT *, CAST(s * row_number() OVER (PARTITION BY id, g ORDER BY session) AS BIGINT) AS streak FROM s1)"""


@REG.add("signed_streaks", f"WITH {STREAKS} SELECT id, session, streak FROM streaks")
def signed_streaks(spark, d):
    return ft.signed_streak(returns(spark, d), "return_1", "streak").select("id", "session", "streak")


@REG.add(
    "consecutive_streaks",
    f"""WITH {RETURNS}, a AS (SELECT id, session, CASE WHEN coalesce(return_1 > 0, false) THEN 1 ELSE 0 END AS c FROM returns),
    b AS (SELECT *, sum(1 - c) OVER (PARTITION BY id ORDER BY session) AS g FROM a)
    SELECT id, session, CAST(CASE WHEN c = 1 THEN sum(c) OVER (PARTITION BY id, g ORDER BY session) ELSE 0 END AS BIGINT) AS rising FROM b""",
)
def consecutive_streaks(spark, d):
    return ft.true_streak(returns(spark, d), F.col("return_1") > 0, "rising").select("id", "session", "rising")


@REG.add(
    "streak_history",
    f"""WITH {STREAKS}, n AS (SELECT id, session, streak, CASE WHEN lead(session) OVER w = session + 1 THEN lead(return_1) OVER w END AS nx FROM streaks {W}),
    h AS (SELECT id, session, count(nx) OVER b AS history_n, avg(nx) OVER b AS m, avg(CASE WHEN nx > 0 THEN 1.0 WHEN nx <= 0 THEN 0.0 END) OVER b AS v FROM n
        WINDOW b AS (PARTITION BY id, streak ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT id, session, history_n, {r("CASE WHEN history_n >= 3 THEN m END", "history_mean")}, {r("CASE WHEN history_n >= 3 THEN v END", "history_win")} FROM h""",
)
def streak_history(spark, d):
    p = ft.signed_streak(returns(spark, d), "return_1", "streak")
    return rounded(ft.streak_history(p, "streak", "return_1").select("id", "session", "history_n", "history_mean", "history_win"))


def _conditional(name: str, sign: str) -> tuple[str, str, str]:
    """Of one direction: the state, its cumulative counts, and the columns of the row's own state."""
    state = f"CAST(greatest(least({sign} streak, 5), 0) AS INTEGER) AS {name}_now"
    sums = ", ".join(f"count(CASE WHEN {name}_before = {k} THEN return_1 END) OVER w AS {name}_n{k}, sum(CASE WHEN {name}_before = {k} THEN return_1 END) OVER w AS {name}_s{k}, count(CASE WHEN {name}_before = {k} AND return_1 > 0 THEN 1 END) OVER w AS {name}_u{k}" for k in range(1, 6))
    own = lambda x: "CASE " + name + "_now " + " ".join(f"WHEN {k} THEN {name}_{x}{k}" for k in range(1, 6)) + " END"
    enough = lambda x: f"CASE WHEN {own('n')} >= 5 THEN {own(x)} / CAST({own('n')} AS DOUBLE) END"
    return state, sums, f"coalesce({own('n')}, 0) AS {name}_count, {r(enough('s'), f'{name}_mean')}, {r(enough('u'), f'{name}_up_prob')}"


_UP, _DOWN = _conditional("after_up", ""), _conditional("after_down", "-")


@REG.add(
    "conditional_streak_history",
    f"""WITH {STREAKS}, a AS (SELECT id, session, return_1, {_UP[0]}, {_DOWN[0]} FROM streaks), b AS (SELECT *, coalesce(lag(after_up_now) OVER w, 0) AS after_up_before, coalesce(lag(after_down_now) OVER w, 0) AS after_down_before FROM a {W}),
    c AS (SELECT *, {_UP[1]}, {_DOWN[1]} FROM b {W}) SELECT id, session, {_UP[2]}, {_DOWN[2]} FROM c""",
)
def conditional_streak_history(spark, d):
    """Returns after earlier streaks of the length that today's has, up and down, from five of them on."""
    p = ft.signed_streak(returns(spark, d), "return_1", "streak").withColumn("fall", -F.col("streak"))
    p = ft.conditional_streak_history(ft.conditional_streak_history(p, "streak", "return_1", "after_up"), "fall", "return_1", "after_down")
    return rounded(p.select("id", "session", *[f"after_{w}_{c}" for w in ("up", "down") for c in ("count", "mean", "up_prob")]))


@REG.add("tendencies", f"WITH {RETURNS}, u AS (SELECT id, session, CASE WHEN return_1 > 0 THEN 1.0 WHEN return_1 <= 0 THEN 0.0 END AS up FROM returns) SELECT id, session, {r(guarded('avg(up)', 'up', 20, 10), 'up_share_20')} FROM u")
def tendencies(spark, d):
    return rounded(ft.tendency(returns(spark, d), "return_1", 20, 10).select("id", "session", "up_share_20"))


def with_market(spark, d):
    return returns(spark, d).join(F.broadcast(market(spark, d).select("session", "market_return")), "session", "left")


JOINED = f"{MARKET}, j AS (SELECT returns.*, market_return AS m FROM returns LEFT JOIN market USING (session))"


@REG.add(
    "beta_population",
    f"""WITH {JOINED}, b AS (SELECT id, session, CASE WHEN m IS NOT NULL THEN return_1 END AS x, CASE WHEN return_1 IS NOT NULL THEN m END AS y FROM j),
    c AS (SELECT id, session, CASE WHEN count(x) OVER k >= 30 THEN avg(x * y) OVER k - avg(x) OVER k * avg(y) OVER k END AS cv, CASE WHEN count(x) OVER k >= 30 THEN greatest(avg(y * y) OVER k - avg(y) OVER k * avg(y) OVER k, 0) END AS vr FROM b WINDOW k AS {rows(60)})
    SELECT id, session, {r("CASE WHEN abs(vr) > 1e-12 THEN cv / vr END", "beta_60")} FROM c""",
)
def beta_population(spark, d):
    return rounded(ft.beta_population(with_market(spark, d).select("id", "session", "return_1", "market_return"), "return_1", "market_return", 60, 30).select("id", "session", "beta_60"))


@REG.add(
    "corr_mixed",
    f"""WITH {JOINED}, c AS (SELECT id, session, count(return_1 * m) OVER k AS n, avg(return_1 * m) OVER k - avg(return_1) OVER k * avg(m) OVER k AS cv, stddev_samp(return_1) OVER k * stddev_samp(m) OVER k AS dv FROM j WINDOW k AS {rows(60)}),
    e AS (SELECT id, session, CASE WHEN n >= 30 AND dv > 1e-12 THEN cv / dv END AS q FROM c) SELECT id, session, {r("CASE WHEN q > 1 THEN 1 WHEN q < -1 THEN -1 ELSE q END", "corr_60")} FROM e""",
)
def corr_mixed(spark, d):
    return rounded(ft.correlation_mixed(with_market(spark, d).select("id", "session", "return_1", "market_return"), "return_1", "market_return", 60, 30).select("id", "session", "corr_60"))


@REG.add(
    "corr_sample",
    f"""WITH {JOINED} SELECT id, session, {r("CASE WHEN count(return_1 * m) OVER k >= 30 THEN corr(return_1, m) OVER k END", "pair_corr_60")},
    {r("CASE WHEN count(return_1 * m) OVER k >= 30 AND var_samp(m) OVER k > 1e-12 THEN covar_samp(return_1, m) OVER k / var_samp(m) OVER k END", "pair_beta_60")} FROM j WINDOW k AS {rows(60)}""",
)
def corr_sample(spark, d):
    return rounded(ft.correlation_sample(with_market(spark, d).select("id", "session", "return_1", "market_return"), "return_1", "market_return", 60, 30).select("id", "session", "pair_corr_60", "pair_beta_60"))


@REG.add(
    "lead_lag",
    f"""WITH {JOINED}, l AS (SELECT id, session, return_1 AS x, lag(m, 1) OVER w AS y, lag(m, 2) OVER w AS z FROM j {W})
    SELECT id, session, {r("CASE WHEN count(x * y) OVER k >= 30 THEN corr(x, y) OVER k END", "lead_corr_1")}, {r("CASE WHEN count(x * z) OVER k >= 30 THEN corr(x, z) OVER k END", "lead_corr_2")} FROM l WINDOW k AS {rows(60)}""",
)
def lead_lag(spark, d):
    p = with_market(spark, d).select("id", "session", "return_1", "market_return")
    return rounded(ft.lead_lag(p, "return_1", "market_return", (1, 2), 60, 30).select("id", "session", "lead_corr_1", "lead_corr_2"))


@REG.add("relative_strength", f"WITH {JOINED} SELECT id, session, {r('return_1 - m', 'return_1_relative')} FROM j")
def relative_strength(spark, d):
    return rounded(ft.relative_strength(with_market(spark, d), "return_1", "market_return").select("id", "session", "return_1_relative"))


@REG.add(
    "market_context",
    f"""WITH {MARKET} SELECT session, {r("market_return", "market_return")}, {r("CASE WHEN count(market_return) OVER k >= 10 THEN stddev_samp(market_return) OVER k END", "market_volatility_20")},
    {r("CASE WHEN count(market_return) OVER k >= 10 THEN avg(market_return) OVER k END", "market_mean_20")} FROM market WINDOW k AS (ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
)
def market_context(spark, d):
    m = market(spark, d).withColumn("id", F.lit(0))  # a dimension: one row for each session
    w = lambda agg: ft.rolling(agg, "market_return", 20, 10, "id", "session")
    return rounded(m.select("session", "market_return", w(F.stddev_samp).alias("market_volatility_20"), w(F.avg).alias("market_mean_20")))


@REG.add(
    "vol_regime_percentile",
    f"""WITH {MARKET}, k AS (SELECT a.session, a.market_return AS v, count(b.market_return) AS n, count(*) FILTER (b.market_return < a.market_return) AS l, count(*) FILTER (b.market_return = a.market_return) AS e
        FROM (SELECT *, row_number() OVER (ORDER BY session) AS i FROM market) a JOIN (SELECT *, row_number() OVER (ORDER BY session) AS i FROM market) b ON b.i BETWEEN a.i - 51 AND a.i GROUP BY ALL)
    SELECT session, {r("CASE WHEN n >= 26 THEN (l + (e + 1) / 2.0) / n END", "market_return_percentile")} FROM k""",
)
def vol_regime_percentile(spark, d):
    return rounded(ft.percentile_in_history(market(spark, d), "market_return", 52, 26).select("session", "market_return_percentile"))


@REG.add(
    "liquidity_risk",
    f"""WITH {RETURNS}, x AS (SELECT id, session, CASE WHEN abs(turnover) > 0 THEN abs(return_1) * 1e6 / turnover END AS i, ln(1 + greatest(turnover, 0)) AS g, least(return_1, 0) AS q, return_1 FROM returns)
    SELECT id, session, {r(guarded("avg(i)", "i", 20, 10), "illiquidity_20")}, {r(guarded("stddev_samp(g)", "g", 20, 10), "turnover_deviation_20")},
    {r("sqrt(" + guarded("avg(CASE WHEN return_1 IS NOT NULL THEN q * q END)", "return_1", 20, 10) + ")", "downside_20")} FROM x""",
)
def liquidity_risk(spark, d):
    p = ft.downside(ft.illiquidity(returns(spark, d), 20, 10), "return_1", 20, 10)
    return rounded(p.select("id", "session", "illiquidity_20", "turnover_deviation_20", "downside_20"))


@REG.add(
    "calendar_features",
    """WITH x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) SELECT date, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month, date = last_day(date) AS is_month_end,
    date = last_day(date) AND month(date) % 3 = 0 AS is_quarter_end, month(date) = 3 AS march, date = last_day(date) AND month(date) = 3 AS march_end,
    CAST(date + CAST((12 - isodow(date)) % 7 AS INTEGER) AS DATE) AS week_label FROM x""",
)
def calendar_features(spark, d):
    from saltern.plans.panel import table

    return ft.calendar(table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct())


@REG.add(
    "xs_rank",
    f"""WITH {RETURNS} SELECT id, session, {r("CASE WHEN return_5 IS NOT NULL THEN (rank() OVER (PARTITION BY session ORDER BY return_5 NULLS LAST) + (count(return_5) OVER (PARTITION BY session, return_5) - 1) / 2.0) / count(return_5) OVER (PARTITION BY session) END", "return_5_rank")},
    {r("CASE WHEN volume IS NOT NULL THEN (rank() OVER (PARTITION BY session ORDER BY volume NULLS LAST) + (count(volume) OVER (PARTITION BY session, volume) - 1) / 2.0) / count(volume) OVER (PARTITION BY session) END", "volume_rank")} FROM returns""",
)
def xs_rank(spark, d):
    p = returns(spark, d)
    return rounded(p.select("id", "session", percentile_rank("return_5", "session").alias("return_5_rank"), percentile_rank("volume", "session").alias("volume_rank")))


@REG.add("ordinal_rank", f"WITH {RETURNS} SELECT id, session, row_number() OVER (PARTITION BY session ORDER BY return_5 DESC NULLS LAST, id) AS place FROM returns WHERE return_5 IS NOT NULL")
def ordinal_rank(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("session").orderBy(F.desc_nulls_last("return_5"), "id")
    return returns(spark, d).where("return_5 is not null").select("id", "session", F.row_number().over(w).cast("long").alias("place"))


@REG.add(
    "sequence_windows",
    f"""WITH {RETURNS}, s AS (SELECT id, session, string_agg(CAST(CAST(round(volume) AS BIGINT) AS VARCHAR), ',') OVER (PARTITION BY id ORDER BY session ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS sequence, lag(session, 4) OVER (PARTITION BY id ORDER BY session) = session - 4 AS whole FROM returns)
    SELECT id, session, sequence FROM s WHERE whole""",
)
def sequence_windows(spark, d):
    p = ft.sequences(returns(spark, d), ["volume"], 5).where("sequence is not null")
    return p.select("id", "session", F.array_join(F.transform("sequence", lambda x: F.round(x[0]).cast("long").cast("string")), ",").alias("sequence"))
