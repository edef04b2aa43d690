"""Rankings, portfolios, performance and research diagnostics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from saltern.functions.frames import correlation, mean_rank, percentile_rank
from saltern.operators import features as ft
from saltern.operators import portfolio as pf
from saltern.plans.feature_queries import REG as _FEATURES
from saltern.plans.feature_queries import TARGETS, UNIVERSE, guarded, rows, universe_panel
from saltern.plans.panel import MARKET, RETURNS, SUPPLIER_PANEL, market, returns, rounded, sql_return, supplier_panel, table, with_return
from saltern.plans.registry import Registry, r

REG = Registry()
assert _FEATURES

C = pf.Costs()
_BUY = f"(close * {1 + C.slippage})"
_SELL = f"(close * {1 - C.slippage})"


def _buy_cash(q: str) -> str:
    v = f"({_BUY} * {q})"
    fees = f"({C.brokerage} + {v} * {C.exchange + C.regulator})"
    return f"({v} * {1 + C.tax_buy + C.stamp_buy} + {fees} + {C.gst} * {fees})"


def _sell_cash(q: str) -> str:
    v = f"({_SELL} * {q})"
    fees = f"({C.brokerage} + {v} * {C.exchange + C.regulator})"
    return f"({v} * {1 - C.tax_sell} - {fees} - {C.gst} * {fees} - {C.depository_sell})"


@REG.add("transaction_costs_buy_sell", f"WITH {SUPPLIER_PANEL} SELECT id, session, {r(_BUY, 'buy_fill', 8)}, round({_buy_cash('10')}, 4) + 0.0 AS buy_cash, {r(_SELL, 'sell_fill', 8)}, round({_sell_cash('10')}, 4) + 0.0 AS sell_cash FROM panel")
def transaction_costs_buy_sell(spark, d):
    p = supplier_panel(spark, d)
    (bf, bc), (sf, sc) = C.buy(F.col("close"), F.lit(10)), C.sell(F.col("close"), F.lit(10))
    return rounded(p.select("id", "session", bf.alias("buy_fill"), F.round(bc, 4).alias("buy_cash"), sf.alias("sell_fill"), F.round(sc, 4).alias("sell_cash")), 8)


@REG.add(
    "affordable_quantity",
    f"""WITH {SUPPLIER_PANEL}, a AS (SELECT *, 50000.0 + 10 * id AS cash FROM panel), q AS (SELECT *, greatest(floor((cash - {C.brokerage * (1 + C.gst)}) / (close * {C.unit_cost()!r}) + 1e-12), 0) AS q FROM a)
    SELECT id, session, CAST(CASE WHEN close > 0 THEN CASE WHEN q > 0 AND {_buy_cash("q")} > cash + 1e-9 THEN q - 1 ELSE q END ELSE 0 END AS BIGINT) AS quantity FROM q""",
)
def affordable_quantity(spark, d):
    p = supplier_panel(spark, d)
    return p.select("id", "session", C.affordable_column(F.col("close"), 50000.0 + 10 * F.col("id")).alias("quantity"))


SCORED = f"""{UNIVERSE}, scores AS (SELECT u.*, p.turnover, p.r5 AS return_5, p.r20 AS return_20, p.v AS vol FROM (SELECT *, enough_history AND enough_price AND enough_turnover AND enough_active AND enough_sessions AS eligible FROM universe) u
JOIN (SELECT id, session, turnover, {sql_return(5)} AS r5, {sql_return(20)} AS r20, {guarded("stddev_samp(r1)", "r1", 20, 10)} AS v FROM (SELECT *, {sql_return(1)} AS r1 FROM panel WINDOW w AS (PARTITION BY id ORDER BY session)) WINDOW w AS (PARTITION BY id ORDER BY session)) p USING (id, session))"""


def scored(spark, d):
    p = universe_panel(spark, d)
    for k in (1, 5, 20):
        p = with_return(p, k)
    return ft.volatility(p, 20, 10)


@REG.add(
    "topk_strategies",
    f"""WITH {SCORED}, s AS (SELECT session, id, turnover, 'momentum_20' AS strategy, return_20 AS score FROM scores WHERE eligible UNION ALL SELECT session, id, turnover, 'reversal_5', -return_5 FROM scores WHERE eligible
        UNION ALL SELECT session, id, turnover, 'risk_adjusted_20', CASE WHEN abs(vol) > 1e-12 THEN return_20 / vol END FROM scores WHERE eligible)
    SELECT strategy, session, id, place FROM (SELECT *, row_number() OVER (PARTITION BY strategy, session ORDER BY score DESC, turnover DESC, id) AS place FROM s WHERE score IS NOT NULL) WHERE place <= 5""",
)
def topk_strategies(spark, d):
    p = scored(spark, d).where("eligible")
    ratio = F.when(F.abs("volatility_20") > 1e-12, F.col("return_20") / F.col("volatility_20"))
    options = F.array(*[F.struct(F.lit(n).alias("strategy"), s.alias("score")) for n, s in (("momentum_20", F.col("return_20")), ("reversal_5", -F.col("return_5")), ("risk_adjusted_20", ratio))])
    long = p.select("session", "id", "turnover", F.inline(options))
    w = Window.partitionBy("strategy", "session").orderBy(F.desc("score"), F.desc("turnover"), "id")
    return long.where("score is not null").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5").select("strategy", "session", "id", "place")


_MOMENTUM = f"""{SCORED}, t AS (SELECT id, session, CASE WHEN lead(session, 1) OVER w = session + 1 AND lead(open, 1) OVER w > 0 AND lead(session, 3) OVER w = session + 3 THEN lead(close, 3) OVER w / lead(open, 1) OVER w - 1 END AS target FROM panel WINDOW w AS (PARTITION BY id ORDER BY session)),
ranked AS (SELECT s.id, s.session, s.turnover, s.return_5 AS score, t.target FROM scores s JOIN t USING (id, session) WHERE eligible AND return_5 IS NOT NULL AND target IS NOT NULL),
x AS (SELECT *, {{score_rank}} AS sr, {{target_rank}} AS tr, row_number() OVER (PARTITION BY session ORDER BY score DESC, turnover DESC, id) AS place FROM ranked)"""
_MR = lambda c: f"rank() OVER (PARTITION BY session ORDER BY {c}) + (count(*) OVER (PARTITION BY session, {c}) - 1) / 2.0"
MOMENTUM = _MOMENTUM.format(score_rank=_MR("score"), target_rank=_MR("target"))


def momentum_rows(spark, d):
    p = ft.forward_target(scored(spark, d), 3).where("eligible and return_5 is not null and target_3 is not null")
    p = p.select("id", "session", "turnover", F.col("return_5").alias("score"), F.col("target_3").alias("target"))
    place = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("score"), F.desc("turnover"), "id"))
    return p.select("*", mean_rank("score", "session").alias("sr"), mean_rank("target", "session").alias("tr"), place.cast("long").alias("place"))


def momentum_by_session(spark, d, names: int):
    """Lines to panel, sessions, returns, universe, scores, top five, targets, and each session's rank correlation."""
    g = momentum_rows(spark, d).groupBy("session").agg(F.count("*").alias("n"), correlation("sr", "tr").alias("ic"), F.avg(F.when(F.col("place") <= 5, F.col("target"))).alias("top_5"), F.avg("target").alias("every")).where(F.col("n") >= names)
    return rounded(g.select("session", "n", "ic", "top_5", (F.col("top_5") - F.col("every")).alias("excess")))


@REG.add(
    "momentum_pipeline",
    f"""WITH {MOMENTUM}, g AS (SELECT session, count(*) AS n, corr(sr, tr) AS ic, avg(target) FILTER (place <= 5) AS top, avg(target) AS every FROM x GROUP BY session HAVING count(*) >= 10)
    SELECT session, n, {r("CASE WHEN isfinite(ic) THEN ic END", "ic")}, {r("top", "top_5")}, {r("top - every", "excess")} FROM g""",
)
def momentum_pipeline(spark, d):
    return momentum_by_session(spark, d, 10)


@REG.add(
    "ic_summary",
    f"""WITH {MOMENTUM}, g AS (SELECT session, corr(sr, tr) AS c FROM x GROUP BY session HAVING count(*) >= 10), f AS (SELECT round(c, 9) AS c FROM g WHERE isfinite(c))
    SELECT count(*) AS n_sessions, {r("avg(c)", "mean_ic")}, {r("median(c)", "median_ic")}, {r("avg(c) / stddev_samp(c)", "icir")}, {r("avg(CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END)", "positive_share")} FROM f""",
)
def ic_summary(spark, d):
    g = momentum_rows(spark, d).groupBy("session").agg(F.count("*").alias("n"), F.round(correlation("sr", "tr"), 9).alias("c")).where("n >= 10 and c is not null")
    return rounded(g.agg(F.count("*").alias("n_sessions"), F.avg("c").alias("mean_ic"), F.median("c").alias("median_ic"), (F.avg("c") / F.stddev_samp("c")).alias("icir"), F.avg((F.col("c") > 0).cast("double")).alias("positive_share")))


@REG.add(
    "deciles",
    f"""WITH {MOMENTUM}, p AS (SELECT session, target, least(greatest(ceil(sr / count(*) OVER (PARTITION BY session) * 10 - 1e-9), 1), 10) AS decile FROM x), g AS (SELECT session, decile, avg(target) AS m, count(*) AS n FROM p GROUP BY 1, 2)
    SELECT CAST(decile AS BIGINT) AS decile, count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_rows, {r("avg(m)", "mean_target")} FROM g GROUP BY 1""",
)
def deciles(spark, d):
    p = momentum_rows(spark, d).withColumn("share", F.col("sr") / F.count("*").over(Window.partitionBy("session")))
    g = p.withColumn("decile", F.least(F.greatest(F.ceil(F.col("share") * 10 - 1e-9), F.lit(1)), F.lit(10)).cast("long")).groupBy("session", "decile").agg(F.avg("target").alias("m"), F.count("*").alias("n"))
    return rounded(g.groupBy("decile").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_rows"), F.avg("m").alias("mean_target")))


@REG.add(
    "top_tail",
    f"""WITH {MOMENTUM}, k AS (SELECT unnest([1, 3, 5, 10]) AS k), g AS (SELECT k, session, avg(target) FILTER (place <= k) AS top, avg(target) AS every FROM x, k GROUP BY 1, 2)
    SELECT CAST(k AS BIGINT) AS k, {r("avg(top)", "mean_top")}, {r("avg(top - every)", "mean_excess")}, {r("avg(CASE WHEN top > every THEN 1.0 ELSE 0.0 END)", "win_share")} FROM g GROUP BY 1""",
)
def top_tail(spark, d):
    g = momentum_rows(spark, d).groupBy("session").agg(F.avg("target").alias("every"), *[F.avg(F.when(F.col("place") <= k, F.col("target"))).alias(f"t{k}") for k in (1, 3, 5, 10)])
    long = g.select("every", F.inline(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"t{k}").alias("top")) for k in (1, 3, 5, 10)])))
    return rounded(long.groupBy("k").agg(F.avg("top").alias("mean_top"), F.avg(F.col("top") - F.col("every")).alias("mean_excess"), F.avg((F.col("top") > F.col("every")).cast("double")).alias("win_share")))


@REG.add(
    "persistence",
    f"""WITH {MOMENTUM}, a AS (SELECT a.session, corr(a.sr, b.sr) AS c, count(*) AS n FROM x a JOIN x b ON a.id = b.id AND b.session = a.session + 1 GROUP BY 1)
    SELECT session, n, {r("CASE WHEN n >= 10 AND isfinite(c) THEN c END", "rank_correlation")} FROM a""",
)
def persistence(spark, d):
    x = momentum_rows(spark, d)
    after = x.select("id", (F.col("session") - 1).alias("session"), F.col("sr").alias("next"))
    g = x.join(after, ["id", "session"]).groupBy("session").agg(correlation("sr", "next").alias("c"), F.count("*").alias("n"))
    return rounded(g.select("session", "n", F.when(F.col("n") >= 10, F.col("c")).alias("rank_correlation")))


@REG.add(
    "topk_overlap",
    f"""WITH {MOMENTUM}, top5 AS (SELECT session, id FROM x WHERE place <= 5), o AS (SELECT a.session, count(*) AS both_n FROM top5 a JOIN top5 b ON a.id = b.id AND b.session = a.session + 1 GROUP BY 1), n AS (SELECT session, count(*) AS n FROM top5 GROUP BY 1)
    SELECT a.session, coalesce(both_n, 0) AS n_both, {r("coalesce(both_n, 0) / (a.n + b.n - coalesce(both_n, 0))", "jaccard")} FROM n a JOIN n b ON b.session = a.session + 1 LEFT JOIN o ON o.session = a.session""",
)
def topk_overlap(spark, d):
    sets = momentum_rows(spark, d).where("place <= 5").groupBy("session").agg(F.collect_set("id").alias("now"))  # five ids at most
    after = sets.select((F.col("session") - 1).alias("session"), F.col("now").alias("then"))
    both = F.size(F.array_intersect("now", "then"))
    j = sets.join(after, "session")
    return rounded(j.select("session", both.cast("long").alias("n_both"), (both / F.size(F.array_union("now", "then"))).alias("jaccard")))


@REG.add(
    "consensus_rank",
    f"""WITH {SCORED}, p AS (SELECT id, session, {{a}} AS a, {{b}} AS b FROM scores) SELECT id, session, {r("CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END", "consensus")} FROM p""".format(
        a="CASE WHEN return_5 IS NOT NULL THEN (rank() OVER (PARTITION BY session ORDER BY return_5 NULLS LAST) + (count(return_5) OVER (PARTITION BY session, return_5) - 1) / 2.0) / count(return_5) OVER (PARTITION BY session) END",
        b="CASE WHEN return_20 IS NOT NULL THEN (rank() OVER (PARTITION BY session ORDER BY return_20 NULLS LAST) + (count(return_20) OVER (PARTITION BY session, return_20) - 1) / 2.0) / count(return_20) OVER (PARTITION BY session) END",
    ),
)
def consensus_rank(spark, d):
    p = scored(spark, d).select("id", "session", percentile_rank("return_5", "session").alias("a"), percentile_rank("return_20", "session").alias("b"))
    return rounded(p.select("id", "session", F.coalesce((F.col("a") + F.col("b")) / 2, "a", "b").alias("consensus")))


@REG.add("ensemble_score", f"""WITH {MOMENTUM} SELECT id, session, {r("0.7 * sr / count(*) OVER (PARTITION BY session) + 0.3 * (rank() OVER (PARTITION BY session ORDER BY turnover) + (count(*) OVER (PARTITION BY session, turnover) - 1) / 2.0) / count(*) OVER (PARTITION BY session)", "score")} FROM x""")
def ensemble_score(spark, d):
    x = momentum_rows(spark, d)
    return rounded(x.select("id", "session", (0.7 * percentile_rank("score", "session") + 0.3 * percentile_rank("turnover", "session")).alias("score")))


CURVES = f"{RETURNS}, curves AS (SELECT id, session, date, close AS equity, close / lag(close) OVER (PARTITION BY id ORDER BY session) - 1 AS ret FROM returns)"


def curves(spark, d):
    return supplier_panel(spark, d).select("id", "session", "date", F.col("close").alias("equity"))


_DD = f"""{CURVES}, d0 AS (SELECT *, max(equity) OVER (PARTITION BY id ORDER BY session) AS peak FROM curves), d1 AS (SELECT *, equity / peak - 1 AS drawdown, equity < peak * (1 - 1e-12) AS under, sum(CASE WHEN equity < peak * (1 - 1e-12) THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY session) AS g FROM d0),
dd AS (SELECT *, CASE WHEN under THEN row_number() OVER (PARTITION BY id, g ORDER BY session) - 1 ELSE 0 END AS under_water FROM d1)"""


@REG.add("drawdown_curve", f"WITH {_DD} SELECT id, session, {r('peak', 'peak')}, {r('drawdown', 'drawdown')}, under_water FROM dd")
def drawdown_curve(spark, d):
    return rounded(pf.drawdowns(curves(spark, d), "id", "session", "equity").select("id", "session", "peak", "drawdown", "under_water"))


@REG.add(
    "drawdown_episodes",
    f"""WITH {_DD}, e AS (SELECT id, g, min(drawdown) AS depth, arg_min(session, drawdown) AS trough, count(*) FILTER (under) AS n_under, min(session) AS peak_session FROM dd GROUP BY id, g HAVING count(*) FILTER (under) > 0)
    SELECT id, peak_session, n_under, {r("depth", "depth")}, place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(depth, 9), g) AS place FROM e) WHERE place <= 3""",
)
def drawdown_episodes(spark, d):
    q = pf.drawdowns(curves(spark, d), "id", "session", "equity")
    w = Window.partitionBy("id").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    q = q.withColumn("g", F.sum((F.col("under_water") == 0).cast("int")).over(w))
    e = q.groupBy("id", "g").agg(F.min("drawdown").alias("depth"), F.count(F.when(F.col("under_water") > 0, 1)).alias("n_under"), F.min("session").alias("peak_session")).where("n_under > 0")
    best = Window.partitionBy("id").orderBy(F.round("depth", 9), "g")
    return rounded(e.withColumn("place", F.row_number().over(best).cast("long")).where("place <= 3").select("id", "peak_session", "n_under", "depth", "place"))


@REG.add(
    "curve_metrics",
    f"""WITH {_DD}, s AS (SELECT id, count(ret) AS n, arg_min(equity, session) AS f, arg_max(equity, session) AS l, avg(ret) AS m, stddev_samp(ret) AS s, sqrt(avg(CASE WHEN ret IS NOT NULL THEN least(ret, 0) * least(ret, 0) END)) AS dn, min(drawdown) AS max_drawdown, max(under_water) AS longest_under_water,
        avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret <= 0 THEN 0.0 END) AS win_rate, quantile_cont(ret, 0.05) AS var_95 FROM dd GROUP BY id)
    SELECT id, n, {r("l / f - 1", "total_return")}, {r("CASE WHEN n > 0 AND f > 0 THEN pow(l / f, CAST(52 AS DOUBLE) / n) - 1 END", "cagr")}, {r("s * sqrt(52)", "volatility")}, {r("CASE WHEN s > 1e-12 THEN m / s * sqrt(52) END", "sharpe")}, {r("CASE WHEN dn > 1e-12 THEN m / dn * sqrt(52) END", "sortino")},
    {r("max_drawdown", "max_drawdown")}, longest_under_water, {r("win_rate", "win_rate")}, {r("var_95", "var_95")} FROM s""",
)
def curve_metrics(spark, d):
    return rounded(pf.curve_metrics(curves(spark, d), "id", "session", "equity", 52))


@REG.add(
    "rolling_sharpe",
    f"""WITH {CURVES} SELECT id, session, {r("CASE WHEN count(ret) OVER k >= 26 AND stddev_samp(ret) OVER k > 1e-12 THEN avg(ret) OVER k / stddev_samp(ret) OVER k * sqrt(52) END", "sharpe_52")} FROM curves WINDOW k AS {rows(52)}""",
)
def rolling_sharpe(spark, d):
    w = Window.partitionBy("id").orderBy("session")
    q = curves(spark, d).withColumn("ret", F.col("equity") / F.lag("equity").over(w) - 1)
    k = w.rowsBetween(-51, 0)
    dev = F.stddev_samp("ret").over(k)
    return rounded(q.select("id", "session", F.when((F.count("ret").over(k) >= 26) & (dev > 1e-12), F.avg("ret").over(k) / dev * 52**0.5).alias("sharpe_52")))


@REG.add(
    "rolling_return_summary",
    f"""WITH {CURVES}, k AS (SELECT id, equity / lag(equity, 52) OVER (PARTITION BY id ORDER BY session) - 1 AS v FROM curves)
    SELECT id, count(v) AS n, {r("min(v)", "worst")}, {r("median(v)", "median")}, {r("max(v)", "best")}, {r("avg(CASE WHEN v > 0 THEN 1.0 WHEN v <= 0 THEN 0.0 END)", "positive_share")} FROM k GROUP BY id""",
)
def rolling_return_summary(spark, d):
    v = F.col("equity") / F.lag("equity", 52).over(Window.partitionBy("id").orderBy("session")) - 1
    k = curves(spark, d).select("id", v.alias("v"))
    up = F.when(F.col("v").isNotNull(), (F.col("v") > 0).cast("double"))
    return rounded(k.groupBy("id").agg(F.count("v").alias("n"), F.min("v").alias("worst"), F.median("v").alias("median"), F.max("v").alias("best"), F.avg(up).alias("positive_share")))


@REG.add(
    "calendar_returns",
    f"""WITH {CURVES}, y AS (SELECT id, CAST(year(date) AS INTEGER) AS year, arg_min(equity, session) AS f, arg_max(equity, session) AS l, count(*) AS n FROM curves GROUP BY 1, 2)
    SELECT id, year, n, n < 40 AS partial_year, {r("l / coalesce(lag(l) OVER (PARTITION BY id ORDER BY year), f) - 1", "year_return")} FROM y""",
)
def calendar_returns(spark, d):
    y = curves(spark, d).groupBy("id", F.year("date").alias("year")).agg(F.min_by("equity", "session").alias("f"), F.max_by("equity", "session").alias("l"), F.count("*").alias("n"))
    before = F.lag("l").over(Window.partitionBy("id").orderBy("year"))
    return rounded(y.select("id", "year", "n", (F.col("n") < 40).alias("partial_year"), (F.col("l") / F.coalesce(before, "f") - 1).alias("year_return")))


@REG.add(
    "benchmark_relative",
    f"""WITH {MARKET}, s AS (SELECT id, count(*) AS n, covar_samp(return_1, market_return) AS cv, var_samp(market_return) AS vr, avg(return_1) AS mx, avg(market_return) AS mm, stddev_samp(return_1 - market_return) AS te, corr(return_1, market_return) AS cr FROM returns JOIN market USING (session) WHERE return_1 IS NOT NULL GROUP BY id),
    b AS (SELECT *, CASE WHEN n >= 3 AND vr > 1e-12 THEN cv / vr END AS beta FROM s)
    SELECT id, n, {r("beta", "beta")}, {r("(mx - beta * mm) * 52", "alpha")}, {r("CASE WHEN n >= 3 THEN te * sqrt(52) END", "tracking_error")}, {r("CASE WHEN n >= 3 AND te > 1e-12 THEN (mx - mm) / te * sqrt(52) END", "information_ratio")}, {r("CASE WHEN n >= 3 THEN cr END", "correlation")} FROM b""",
)
def benchmark_relative(spark, d):
    p = returns(spark, d).join(F.broadcast(market(spark, d).select("session", "market_return")), "session")
    return rounded(pf.benchmark_relative(p, "id", "return_1", "market_return", 52))


@REG.add(
    "stopping_labels",
    """WITH e AS (SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value / 100 - 0.5 AS v FROM events),
    f AS (SELECT *, max(v) OVER (PARTITION BY episode ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS future FROM e)
    SELECT episode, t, round(coalesce(future, v), 6) + 0.0 AS hold_best, round(coalesce(future - v, 0), 6) + 0.0 AS advantage, coalesce(future > v, false) AS hold FROM f""",
)
def stopping_labels(spark, d):
    e = episode_values(spark, d)
    future = F.max("v").over(Window.partitionBy("episode").orderBy("t").rowsBetween(1, Window.unboundedFollowing))
    return rounded(e.select("episode", "t", F.coalesce(future, "v").alias("hold_best"), F.coalesce(future - F.col("v"), F.lit(0.0)).alias("advantage"), F.coalesce(future > F.col("v"), F.lit(False)).alias("hold")))


def episode_values(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("episode"), F.row_number().over(w).cast("long").alias("t"), (F.col("value") / 100 - 0.5).alias("v"))


@REG.add(
    "regret",
    """WITH g AS (SELECT o_custkey AS state, o_orderkey AS action, o_totalprice AS q, max(o_totalprice) OVER k AS best, min(o_totalprice) OVER k AS worst FROM orders WINDOW k AS (PARTITION BY o_custkey))
    SELECT state, action, round(best - q, 6) + 0.0 AS regret, round(CASE WHEN best - worst > 1e-12 THEN (best - q) / (best - worst) END, 6) + 0.0 AS normalised FROM g""",
)
def regret(spark, d):
    k = Window.partitionBy("state")
    g = table(spark, d, "orders").select(F.col("o_custkey").alias("state"), F.col("o_orderkey").alias("action"), F.col("o_totalprice").alias("q"))
    best, span = F.max("q").over(k), F.max("q").over(k) - F.min("q").over(k)
    return rounded(g.select("state", "action", (best - F.col("q")).alias("regret"), F.when(span > 1e-12, (best - F.col("q")) / span).alias("normalised")))


@REG.add(
    "ndcg",
    """WITH g AS (SELECT o_custkey AS state, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS truth, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
    h AS (SELECT state, place, truth, pow(2, (n - truth + 1) // 2) - 1 AS gain FROM g WHERE n >= 2), s AS (SELECT state, sum(CASE WHEN place <= 5 THEN gain / log2(place + 1) ELSE 0 END) AS dcg, sum(CASE WHEN truth <= 5 THEN gain / log2(truth + 1) ELSE 0 END) AS ideal FROM h GROUP BY state)
    SELECT state, round(CASE WHEN ideal > 0 THEN dcg / ideal END, 6) + 0.0 AS ndcg_5 FROM s""",
)
def ndcg(spark, d):
    k = Window.partitionBy("o_custkey")
    g = table(spark, d, "orders").select(F.col("o_custkey").alias("state"), F.row_number().over(k.orderBy("o_orderdate", "o_orderkey")).alias("place"), F.row_number().over(k.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("truth"), F.count("*").over(k).alias("n")).where("n >= 2")
    gain = F.pow(F.lit(2.0), F.floor((F.col("n") - F.col("truth") + 1) / 2)) - 1
    part = lambda c: F.sum(F.when(F.col(c) <= 5, gain / F.log2(F.col(c) + 1)).otherwise(0.0))
    s = g.groupBy("state").agg(part("place").alias("dcg"), part("truth").alias("ideal"))
    return rounded(s.select("state", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).alias("ndcg_5")))


@REG.add(
    "pairwise_pairs",
    """WITH g AS (SELECT o_custkey AS state, o_orderkey AS action, o_totalprice AS q, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders)
    SELECT a.state, a.action AS better, b.action AS worse, round(a.q - b.q, 6) + 0.0 AS margin FROM g a JOIN g b ON a.state = b.state AND a.place < b.place AND b.place <= 4""",
)
def pairwise_pairs(spark, d):
    w = Window.partitionBy("state").orderBy(F.desc("q"), "action")
    g = table(spark, d, "orders").select(F.col("o_custkey").alias("state"), F.col("o_orderkey").alias("action"), F.col("o_totalprice").alias("q")).withColumn("place", F.row_number().over(w)).where("place <= 4")
    # at most four actions of a state, so six pairs
    a, b = g.alias("a"), g.alias("b")
    j = a.join(b, (F.col("a.state") == F.col("b.state")) & (F.col("a.place") < F.col("b.place")))
    return rounded(j.select(F.col("a.state").alias("state"), F.col("a.action").alias("better"), F.col("b.action").alias("worse"), (F.col("a.q") - F.col("b.q")).alias("margin")))


@REG.add(
    "annual_winners",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, arg_max(o_custkey, (t, -o_custkey)) AS winner, round(max(t), 4) + 0.0 AS total FROM (SELECT date_trunc('year', o_orderdate) AS o_orderdate, o_custkey, round(sum(o_totalprice), 4) AS t FROM orders GROUP BY 1, 2) GROUP BY 1""",
)
def annual_winners(spark, d):
    t = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), "o_custkey").agg(F.round(F.sum("o_totalprice"), 4).alias("t"))
    return rounded(t.groupBy("year").agg(F.max_by("o_custkey", F.struct("t", -F.col("o_custkey"))).alias("winner"), F.round(F.max("t"), 4).alias("total")))


@REG.add(
    "pnl_attribution",
    """SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag, round(sum(l_extendedprice * (0.05 - l_discount)), 3) + 0.0 AS pnl, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((1, 2), (1), (2), ())""",
)
def pnl_attribution(spark, d):
    li = table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    return rounded(li.cube("year", "l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * (0.05 - F.col("l_discount"))), 3).alias("pnl"), F.count("*").alias("n")))


def _configs(spark):
    return spark.createDataFrame([(k, 50_000.0, k % 3 * 5 + 5, hold, f) for k, (hold, f) in enumerate((h, f) for h in (3, 5, 10) for f in (0.0, 1.0))], "config long, capital double, k int, hold int, cost_factor double")


@REG.add("cohort_backtest")
def cohort_backtest(spark, d):
    p = scored(spark, d).select("id", "session", "open", "close", "turnover", "eligible", "return_20")
    return rounded(pf.cohort_backtest(p, _configs(spark), "return_20"))


@REG.add(
    "block_bootstrap",
    f"""WITH {MARKET}, places AS (SELECT market_return AS r, row_number() OVER (ORDER BY session) - 1 AS place FROM market WHERE market_return IS NOT NULL), n AS (SELECT count(*) AS n FROM places),
    draw AS (SELECT rep, b, CAST('0x' || substr(md5('8675309|own|' || rep || '|' || b), 1, 8) AS BIGINT) % (n - least(20, n) + 1) AS start FROM (SELECT *, unnest(range(0, CAST(ceil(n / 20) AS BIGINT))) AS b FROM range(200) t(rep), n)),
    drawn AS (SELECT rep, r FROM (SELECT rep, start + s AS place FROM draw, range(20) u(s), n WHERE b * 20 + s < n) JOIN places USING (place))
    SELECT rep, {r("avg(r)", "mean")}, {r("CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) END", "sharpe")} FROM drawn GROUP BY rep""",
)
def block_bootstrap(spark, d):
    return rounded(pf.block_bootstrap(market(spark, d), "market_return", "session", 200, 20, 8675309))


@REG.add("ridge_walkforward")
def ridge_walkforward(spark, d):
    from saltern.operators.models import walk_forward

    p = ft.forward_target(scored(spark, d), 5).withColumn("year", F.year("date"))
    return rounded(walk_forward(p, ["return_1", "return_5", "return_20", "volatility_20"], "target_5", purge=20))


@REG.add("persistent_backtest")
def persistent_backtest(spark, d):
    p = scored(spark, d).select("id", "session", "open", "close", "turnover", "eligible", "return_5")
    runs = [(k, 50_000.0, 5, buffer, 5, gap, f) for k, (buffer, gap, f) in enumerate((b, g, f) for b in (5, 10) for g in (0.0, 0.1) for f in (0.0, 1.0))]
    cfg = spark.createDataFrame(runs, "config long, capital double, k int, hold_rank int, every int, min_gap double, cost_factor double")
    return rounded(pf.persistent_backtest(p, cfg, "return_5"))


@REG.add("portfolio_metrics")
def portfolio_metrics(spark, d):
    """Performance of each simulated curve."""
    return rounded(pf.curve_metrics(pf.persistent_backtest(*_persistent(spark, d)), "config", "session", "equity", 52))


def _persistent(spark, d):
    p = scored(spark, d).select("id", "session", "open", "close", "turnover", "eligible", "return_5")
    return p, spark.createDataFrame([(1, 50_000.0, 5, 10, 5, 0.1, 1.0)], "config long, capital double, k int, hold_rank int, every int, min_gap double, cost_factor double"), "return_5"
