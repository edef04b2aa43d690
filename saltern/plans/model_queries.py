"""Models from additive sums, rankers, gates, importance, resampling and checked joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from saltern.functions.frames import percentile_rank
from saltern.operators import checked, gates, linear, performance, rankers, resampling, slots
from saltern.operators import features as ft
from saltern.operators.aggregates import pooled_rank_correlations
from saltern.plans.feature_queries import _target
from saltern.plans.panel import RETURNS, SUPPLIER_PANEL, market, returns, rounded, supplier_panel, table
from saltern.plans.registry import Registry, r
from saltern.plans.relational_queries import REGION_OF, regions

REG = Registry()
FEATURES = ["return_1", "return_5", "return_20"]
PURGE = 5
MODEL = f"{RETURNS}, m AS (SELECT *, CAST(year(date) AS INTEGER) AS year, {_target(5)} AS target_5 FROM returns WINDOW w AS (PARTITION BY id ORDER BY session))"


def model_rows(spark, d):
    return ft.forward_target(returns(spark, d), 5).withColumn("year", F.year("date"))


def wide_rows(spark, d):
    p = ft.geometry(ft.gap_intraday_range(model_rows(spark, d)), signed=True)
    return ft.volatility(p, 20, 10)


FAMILIES = [("trend", FEATURES), ("shape", ["body_to_range", "upper_wick", "lower_wick"]), ("range", ["range_pct", "gap"])]
BRANCHES = [("risk", ["volatility_20"]), ("place", ["close_position"])]


def _product(a: int, b: int) -> str:
    part = lambda k: "1.0" if k == 0 else "target_5" if k == 1 else f"coalesce({FEATURES[k - 2]}, 0)" if k < 2 + len(FEATURES) else f"CAST({FEATURES[k - 2 - len(FEATURES)]} IS NULL AS DOUBLE)"
    return f"SELECT segment, CAST({a} AS INTEGER) AS a, CAST({b} AS INTEGER) AS b, {r(f'sum({part(a)} * {part(b)})', 'value')} FROM s GROUP BY segment"


_SIZE = 2 * len(FEATURES) + 2


@REG.add(
    "gram_sums",
    f"""WITH {MODEL}, f AS (SELECT min(session) AS c FROM m GROUP BY year), cuts AS (SELECT c FROM f UNION SELECT c - {PURGE} FROM f),
    s AS (SELECT m.*, CAST((SELECT count(*) FROM cuts WHERE c <= session) AS INTEGER) AS segment FROM m WHERE target_5 IS NOT NULL) """
    + " UNION ALL ".join(_product(a, b) for a in range(_SIZE) for b in range(a, _SIZE)),
)
def gram_sums(spark, d):
    p = model_rows(spark, d)
    return rounded(linear.gram(p, FEATURES, "target_5", linear.Folds.of(p, PURGE).cuts))


@REG.add("feature_ablation")
def feature_ablation(spark, d):
    """Walk-forward diagnostics of cumulative families and of branches beside the first two."""
    return rounded(linear.ablation(wide_rows(spark, d), linear.families(FAMILIES, BRANCHES, 2), "target_5", PURGE, 2, (1.0, 100.0)))


@REG.add("model_selection")
def model_selection(spark, d):
    """Scores of the last two years by the candidate that the two years before chose."""
    p = wide_rows(spark, d)
    years = [x["year"] for x in p.select("year").distinct().orderBy("year").collect()]
    return rounded(linear.select_and_refit(p, linear.families(FAMILIES, BRANCHES, 2), "target_5", PURGE, years[-4:-2], years[-2:]).test_scores)


WEIGHTS = {"return_1": -1.0, "return_20": 1.0, "return_5": 0.5}
_SCORE = lambda: "(" + " + ".join(["0.0", *(f"{f} * ({c})" for f, c in sorted(WEIGHTS.items()))]) + ")"
_RANKED = lambda x, name: f"rank() OVER (PARTITION BY year, session, feature ORDER BY {x}) + (count(*) OVER (PARTITION BY year, session, feature, {x}) - 1) / 2.0 AS {name}"
IMPORTANCE = f"""{MODEL}, x AS (SELECT year, session, id, target_5, return_1, return_5, return_20, {_SCORE()} AS score, row_number() OVER (PARTITION BY year, session ORDER BY id) AS place FROM m
    WHERE target_5 IS NOT NULL AND return_1 IS NOT NULL AND return_5 IS NOT NULL AND return_20 IS NOT NULL),
long AS ({" UNION ALL ".join(f"SELECT *, '{f}' AS feature, {f} AS v, CAST({c} AS DOUBLE) AS weight FROM x" for f, c in sorted(WEIGHTS.items()))}),
dealt AS (SELECT year, session, feature, v AS value, row_number() OVER (PARTITION BY year, session, feature ORDER BY md5(concat_ws('|', '0', feature, year, session, id)), id) AS place FROM long),
moved AS (SELECT long.*, round(score, 9) AS s, round(score + (value - v) * weight, 9) AS t FROM long JOIN dealt USING (year, session, feature, place)),
ranked AS (SELECT year, session, feature, {_RANKED("s", "rs")}, {_RANKED("t", "rt")}, {_RANKED("v", "rv")}, {_RANKED("target_5", "ry")} FROM moved),
daily AS (SELECT year, session, feature, corr(rs, ry) AS base, corr(rt, ry) AS moved, corr(rv, ry) AS own FROM ranked GROUP BY 1, 2, 3),
found AS (SELECT year, feature, avg(base - moved) FILTER (isfinite(base) AND isfinite(moved)) AS importance, avg(own) FILTER (isfinite(own)) AS signed, count(*) FILTER (isfinite(base) AND isfinite(moved)) AS n_sessions FROM daily GROUP BY 1, 2),
importance AS (SELECT *, CAST(row_number() OVER (PARTITION BY year ORDER BY round(importance, 9) DESC NULLS LAST, feature) AS INTEGER) AS importance_rank FROM found)"""


def _importance(spark, d):
    return linear.permutation_importance(model_rows(spark, d), WEIGHTS, "target_5")


@REG.add("permutation_importance", f"WITH {IMPORTANCE} SELECT year, feature, {r('importance', 'importance')}, {r('signed', 'signed')}, n_sessions, importance_rank FROM importance")
def permutation_importance(spark, d):
    return rounded(_importance(spark, d))


@REG.add(
    "importance_stability",
    f"""WITH {IMPORTANCE} SELECT feature, count(DISTINCT year) AS folds, {r('median(importance_rank)', 'median_rank')}, {r('quantile_cont(importance_rank, 0.25)', 'q25_rank')}, {r('quantile_cont(importance_rank, 0.75)', 'q75_rank')},
    {r('avg(CASE WHEN importance_rank <= 5 THEN 1.0 ELSE 0.0 END)', 'top5_fraction')}, {r('avg(CASE WHEN importance_rank <= 10 THEN 1.0 ELSE 0.0 END)', 'top10_fraction')}, {r('median(importance)', 'median_importance')}, {r('avg(CASE WHEN signed > 0 THEN 1.0 ELSE 0.0 END)', 'positive_fraction')} FROM importance GROUP BY feature""",
)
def importance_stability(spark, d):
    return rounded(linear.importance_stability(_importance(spark, d)))


REPS, BLOCK, SEED = 200, 20, 8675309
SERIES = f"""{RETURNS}, {REGION_OF}, logs AS (SELECT id, session, ln(1 + return_1) AS g FROM returns WHERE return_1 > -1),
series AS (SELECT session, sector AS series, greatest(least(avg(g), 0.05), -0.05) AS r FROM logs JOIN own USING (id) GROUP BY 1, 2 UNION ALL SELECT session, 'market', greatest(least(avg(g), 0.05), -0.05) FROM logs GROUP BY 1),
places AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS place FROM series GROUP BY session HAVING count(*) = (SELECT count(DISTINCT series) FROM series)), n AS (SELECT count(*) AS n FROM places),
held AS (SELECT place, series, r FROM series JOIN places USING (session))"""


def _draw(stream: str, values: str) -> str:
    return f"""draw AS (SELECT rep, b, CAST('0x' || substr(md5('{SEED}|{stream}|' || rep || '|' || b), 1, 8) AS BIGINT) % (n - least({BLOCK}, n) + 1) AS start FROM (SELECT *, unnest(range(0, CAST(ceil(n / {BLOCK}) AS BIGINT))) AS b FROM range({REPS}) t(rep), n)),
    idx AS (SELECT rep, b * {BLOCK} + s AS pos, start + s AS place FROM draw, range({BLOCK}) u(s), n WHERE b * {BLOCK} + s < n), drawn AS (SELECT rep, pos, series, r FROM idx JOIN {values} v ON v.place = idx.place)"""


def _series(spark, d):
    """Weekly mean log returns of regions and of all, cut at 5 %, as those of the test tables would compound beyond all measure."""
    cut = F.greatest(F.least(F.avg("g"), F.lit(0.05)), F.lit(-0.05)).alias("r")
    logs = returns(spark, d).where("return_1 > -1").select("id", "session", F.log1p("return_1").alias("g"))
    own = logs.join(regions(spark, d), "id").groupBy("session", F.col("sector").alias("series")).agg(cut)
    return own.unionByName(logs.groupBy("session", F.lit("market").alias("series")).agg(cut))


@REG.add(
    "joint_bootstrap",
    f"""WITH {SERIES}, {_draw('own', 'held')}, lv AS (SELECT *, sum(ln(1 + r)) OVER (PARTITION BY rep, series ORDER BY pos) AS level FROM drawn), tops AS (SELECT *, greatest(max(level) OVER (PARTITION BY rep, series ORDER BY pos), 0) AS top FROM lv),
    g AS (SELECT rep, series, count(*) AS k, avg(r) AS mean, stddev_samp(r) AS dev, sum(ln(1 + r)) AS total, min(exp(level - top) - 1) AS max_drawdown FROM tops GROUP BY 1, 2),
    m AS (SELECT rep, series, exp(total * 52 / k) - 1 AS cagr, CASE WHEN dev > 0 THEN mean / dev * sqrt(52) END AS sharpe, max_drawdown FROM g),
    x AS (SELECT a.*, a.cagr - b.cagr AS excess_cagr FROM m a JOIN m b USING (rep) WHERE a.series <> 'market' AND b.series = 'market'),
    long AS ({" UNION ALL ".join(f"SELECT series, '{c}' AS metric, {c} AS v FROM x" for c in ("cagr", "sharpe", "max_drawdown", "excess_cagr"))})
    SELECT series, metric, {r('quantile_cont(v, 0.025)', 'p2_5')}, {r('quantile_cont(v, 0.5)', 'median')}, {r('quantile_cont(v, 0.975)', 'p97_5')} FROM long GROUP BY 1, 2""",
)
def joint_bootstrap(spark, d):
    return rounded(resampling.joint_bootstrap(_series(spark, d), "session", "series", "r", "market", REPS, BLOCK, SEED, 52.0))


@REG.add(
    "familywise_test",
    f"""WITH {SERIES}, active AS (SELECT a.place, a.series, a.r - b.r AS a FROM held a JOIN held b USING (place) WHERE a.series <> 'market' AND b.series = 'market'),
    means AS (SELECT series, avg(a) AS m FROM active GROUP BY 1), centred AS (SELECT place, series, a - m AS r FROM active JOIN means USING (series)), {_draw('null', 'centred')},
    most AS (SELECT rep, max(m) AS most FROM (SELECT rep, series, avg(r) * 52 AS m FROM drawn GROUP BY 1, 2) GROUP BY 1), o AS (SELECT max(m * 52) AS observed FROM means)
    SELECT {r('observed', 'observed_max')}, {r(f'(1 + (SELECT count(*) FROM most WHERE round(most, 12) >= round(observed, 12))) / {REPS + 1.0}', 'p_value')}, CAST({REPS} AS BIGINT) AS reps FROM o""",
)
def familywise_test(spark, d):
    return rounded(resampling.familywise_test(_series(spark, d), "session", "series", "r", "market", REPS, BLOCK, SEED, 52.0))


RANKED = ["return_1_rank", "return_5_rank", "return_20_rank", "turnover_rank"]


def ranked_rows(spark, d):
    p = model_rows(spark, d).where("target_5 is not null")
    p = p.withColumns({f"{c}_rank": percentile_rank(c, "session") for c in ("return_1", "return_5", "return_20", "turnover")})
    return p.withColumn("grade", F.ntile(5).over(Window.partitionBy("session").orderBy("target_5", "id")) - 1)


@REG.add("pairwise_ranker")
def pairwise_ranker(spark, d):
    """Coefficients by weighting of pairs, fitted on all sessions."""
    p = ranked_rows(spark, d)
    found = [(w, f, c) for w in ("gap", "top") for f, c in rankers.fit_ranker(p, RANKED, "target_5", "session", w).items()]
    return rounded(spark.createDataFrame(found, "weighting string, feature string, coefficient double"))


@REG.add("listwise_ranker")
def listwise_ranker(spark, d):
    p = ranked_rows(spark, d)
    model = rankers.fit_ranker(p, RANKED, "grade", "session", "ndcg", rounds=6)
    return rounded(rankers.score(p, model).select("id", "session", "grade", "score"))


@REG.add("regime_gate")
def regime_gate(spark, d):
    """Sessions of each year by the chance that the next one's market return is above the mean of the last five."""
    w = Window.orderBy("session")  # one row a session
    m = market(spark, d).withColumn("year", F.year("date"))
    m = m.withColumns({"last_1": F.col("market_return"), "last_5": F.avg("market_return").over(w.rowsBetween(-4, 0)), "dev_20": F.stddev_samp("market_return").over(w.rowsBetween(-19, 0)), })
    m = m.withColumn("label", (F.lead("market_return", 1).over(w) > F.col("last_5")).cast("double"))
    return rounded(gates.gate_by_year(m, ["last_1", "last_5", "dev_20"], "label", 1, 2, least=60))


@REG.add("checked_join", f"WITH {RETURNS}, {REGION_OF} SELECT id, session, sector, {r('return_1', 'return_1')} FROM returns LEFT JOIN own USING (id)")
def checked_join(spark, d):
    """The panel with each security's region, which must be one."""
    return rounded(checked.checked_join(returns(spark, d).select("id", "session", "return_1"), regions(spark, d), ["id"], coverage=0.98).rows.select("id", "session", "sector", "return_1"))


POOLED = ["open", "close", "volume", "turnover", "return_1", "return_5", "return_20", "target_5"]


def _pooled(a: str, b: str) -> str:
    rank = lambda x: f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0"
    return f"SELECT '{a}' AS first, '{b}' AS second, count(*) AS n, CASE WHEN count(*) >= 100 THEN corr(x, y) END AS c FROM (SELECT {rank(a)} AS x, {rank(b)} AS y FROM m WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"


@REG.add(
    "pooled_rank_correlation",
    f"WITH {MODEL}, p AS ({' UNION ALL '.join(_pooled(a, b) for i, a in enumerate(POOLED) for b in POOLED[i + 1 :])}) SELECT first, second, n, {r('CASE WHEN isfinite(c) THEN c END', 'rank_correlation')} FROM p WHERE abs(c) >= 0.05",
)
def pooled_rank_correlation(spark, d):
    return rounded(pooled_rank_correlations(model_rows(spark, d), POOLED, 100, 0.05))


def _side_sql(side: str, w: str) -> str:
    mean = lambda v: f"sum({w} * {v}) / sum(CASE WHEN {v} IS NOT NULL THEN {w} END)"
    return f"""count({w}) AS {side}_holdings_count, {r(f'greatest(0, 1 - coalesce(sum({w}), 0))', f'{side}_cash_fraction')}, {r(f'least(1, coalesce(sum({w}), 0))', f'{side}_exposure')},
    {r(mean('score_pct'), f'{side}_weighted_score_pct')}, {r(mean('rank'), f'{side}_weighted_rank')}"""


def _slot_sql(label: str, place: str, w: str) -> str:
    one = lambda c, k: f"max({c}) FILTER ({place} = {k + 1})"
    return ", ".join(f"{r(f'coalesce({one(w, k)}, 0)', f'{label}{k}_weight')}, " + ", ".join(r(one(c, k), f"{label}{k}_{c}") for c in ("score_pct", "rank", "return_1")) for k in range(3))


@REG.add(
    "action_features",
    f"""WITH {RETURNS}, day AS (SELECT session, id, return_1, (rank() OVER (PARTITION BY session ORDER BY return_20) + (count(*) OVER (PARTITION BY session, return_20) - 1) / 2.0) / count(*) OVER (PARTITION BY session) AS score_pct, row_number() OVER (PARTITION BY session ORDER BY return_20 DESC, id) AS rank FROM returns WHERE return_20 IS NOT NULL),
    held AS (SELECT session, id, k AS sk, CAST(0.06 * (6 - k) AS DOUBLE) AS sw FROM (SELECT session, id, row_number() OVER (PARTITION BY session ORDER BY return_5 DESC, id) AS k FROM returns WHERE return_5 IS NOT NULL) WHERE k <= 5),
    target AS (SELECT session, id, rank AS tk, CAST(0.01 + 0.06 * (6 - rank) AS DOUBLE) AS tw FROM day WHERE rank <= 5),
    x AS (SELECT session, id, sk, sw, tk, tw, score_pct, CAST(rank AS DOUBLE) AS rank, return_1 FROM held FULL JOIN target USING (session, id) LEFT JOIN day USING (session, id)),
    g AS (SELECT session, {_side_sql('state', 'sw')}, {_side_sql('target', 'tw')}, 0.5 * sum(abs(coalesce(tw, 0) - coalesce(sw, 0))) AS moved, {_slot_sql('source', 'sk', 'sw')}, {_slot_sql('target', 'tk', 'tw')} FROM x GROUP BY session)
    SELECT * EXCLUDE (moved), {r('target_weighted_score_pct - state_weighted_score_pct', 'delta_score_pct', 5)}, {r('target_weighted_rank - state_weighted_rank', 'delta_rank', 5)}, {r('moved + 0.5 * abs(target_cash_fraction - state_cash_fraction)', 'turnover_fraction')} FROM g""",
)
def action_features(spark, d):
    """The step from the leaders of five sessions to those of twenty, by session."""
    p = returns(spark, d)
    place = lambda c: F.row_number().over(Window.partitionBy("session").orderBy(F.desc(c), "id"))
    day = p.where("return_20 is not null").select("session", "id", "return_1", percentile_rank("return_20", "session").alias("score_pct"), place("return_20").alias("rank"))
    held = p.where("return_5 is not null").withColumn("k", place("return_5")).where("k <= 5").select("session", "id", (0.06 * (6 - F.col("k"))).alias("weight"))
    target = day.where("rank <= 5").select("session", "id", (0.01 + 0.06 * (6 - F.col("rank"))).alias("weight"))
    out = slots.action_features(held, target, day, ["session"], 3, ("return_1",))
    return rounded(out).withColumns({c: F.round(c, 5) + F.lit(0.0) for c in ("delta_score_pct", "delta_rank")})


def _daily_sql(source: str) -> str:
    """CTEs of ``performance.daily`` over (key, date, value, invested)."""
    return f"""d0 AS (SELECT *, CASE WHEN lag(value) OVER (PARTITION BY key ORDER BY date) > 0 THEN value / lag(value) OVER (PARTITION BY key ORDER BY date) - 1 END AS ret, max(value) OVER (PARTITION BY key ORDER BY date) AS peak FROM {source}),
    d1 AS (SELECT *, value < peak * (1 - 1e-12) AS u, sum(CASE WHEN value < peak * (1 - 1e-12) THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY date) AS g FROM d0),
    daily AS (SELECT *, value / peak - 1 AS drawdown, CASE WHEN u THEN row_number() OVER (PARTITION BY key, g ORDER BY date) - 1 ELSE 0 END AS under, CASE WHEN u THEN date_diff('day', first(date) OVER (PARTITION BY key, g ORDER BY date), date) ELSE 0 END AS under_days FROM d1)"""


INITIAL, RISK_FREE = 1000.0, 0.065
_RF = f"(pow({1 + RISK_FREE}, 1.0 / 52) - 1)"
_COLUMNS = {
    "net_profit": f"l - {INITIAL}", "total_return": f"l / {INITIAL} - 1", "cagr": "cagr", "annualized_arithmetic_return": "coalesce(m * 52, 0)", "annualized_volatility": "CASE WHEN k >= 2 AND s > 0 THEN s * sqrt(52) ELSE 0 END",
    "sharpe": f"CASE WHEN k >= 2 AND s > 0 THEN (m - {_RF}) / s * sqrt(52) ELSE 0 END", "downside_deviation": "coalesce(dn * sqrt(52), 0)", "sortino": f"CASE WHEN dn > 0 THEN (m - {_RF}) * sqrt(52) / dn END", "max_drawdown": "mdd",
    "high_water_mark": "hw", "calmar": "CASE WHEN mdd < 0 THEN cagr / abs(mdd) END", "recovery_factor": f"CASE WHEN fall > 0 THEN (l - {INITIAL}) / fall END", "var_95": "v", "cvar_95": "list_avg([x FOR x IN rets IF x <= v])",
    "skewness": "CASE WHEN k >= 3 THEN sk END", "excess_kurtosis": "CASE WHEN k >= 4 THEN ku END", "best_day_return": "best", "worst_day_return": "worst", "positive_day_fraction": "pos", "average_exposure": "ex", "max_exposure": "mx",
    "win_rate": "win_rate", "average_win": "average_win", "average_loss": "average_loss", "expectancy_per_trade": "expectancy", "average_trade_return": "average_trade_return", "payoff_ratio": "average_win / abs(average_loss)", "profit_factor": "won / abs(lost)",
    "total_fees": "coalesce(fees, 0)", "turnover": "coalesce(turned, 0)", "fees_pct_initial_capital": f"coalesce(fees, 0) / {INITIAL}", "turnover_multiple": f"coalesce(turned, 0) / {INITIAL}", "annualized_turnover_multiple": f"coalesce(turned, 0) / {INITIAL} / years",
}


def _places(column: str) -> int:
    """Sums of money and what is divided by small ones are compared to fewer places."""
    return 2 if column in ("turnover", "total_fees", "expectancy_per_trade", "average_win", "average_loss", "turnover_multiple", "annualized_turnover_multiple", "net_profit") else 4


@REG.add(
    "performance_report",
    f"""WITH {SUPPLIER_PANEL}, src AS (SELECT id AS key, date, close AS value, least(open, close) AS invested FROM panel), {_daily_sql("src")},
    a AS (SELECT key, arg_max(value, date) AS l, greatest(date_diff('day', min(date), max(date)) / 365.25, 1 / 365.25) AS years, count(ret) AS k, avg(ret) AS m, stddev_samp(ret) AS s, sqrt(avg(pow(least(ret - {_RF}, 0), 2)) FILTER (ret IS NOT NULL)) AS dn, quantile_cont(ret, 0.05) AS v, list(ret) FILTER (ret IS NOT NULL) AS rets,
        skewness(ret) AS sk, kurtosis(ret) AS ku, max(ret) AS best, min(ret) AS worst, avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret <= 0 THEN 0.0 END) AS pos, min(drawdown) AS mdd, max(under) AS us, max(under_days) AS ud, max(value) AS hw, max(peak - value) AS fall, avg(invested / value) AS ex, max(invested / value) AS mx FROM daily GROUP BY key),
    b AS (SELECT *, pow(l / {INITIAL}, 1 / years) - 1 AS cagr FROM a),
    t AS (SELECT l_suppkey AS key, count(*) AS trades, avg(CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(p) FILTER (p > 0) AS average_win, avg(p) FILTER (p < 0) AS average_loss, avg(p) AS expectancy, coalesce(sum(p) FILTER (p > 0), 0) AS won, sum(p) FILTER (p < 0) AS lost, avg(0.05 - l_discount) AS average_trade_return, sum(l_extendedprice * l_tax) AS fees, sum(l_extendedprice + l_extendedprice * (1 - l_discount)) AS turned
        FROM (SELECT *, l_extendedprice * (0.05 - l_discount) AS p FROM lineitem) GROUP BY l_suppkey)
    SELECT key AS id, CAST({INITIAL} AS DOUBLE) AS starting_capital, round(l, 6) + 0.0 AS ending_equity, CAST(us AS BIGINT) AS max_drawdown_duration_sessions, CAST(ud AS BIGINT) AS max_drawdown_duration_days, coalesce(trades, 0) AS trades, {", ".join(r(f"CAST({x} AS DOUBLE)", c, _places(c)) for c, x in _COLUMNS.items())} FROM b LEFT JOIN t USING (key)""",
)
def performance_report(spark, d):
    """Each supplier's price as a curve, its line items as trades."""
    p = supplier_panel(spark, d).withColumn("invested", F.least("open", "close"))
    li = table(spark, d, "lineitem")
    edge = F.lit(0.05) - F.col("l_discount")
    trades = li.select(F.col("l_suppkey").alias("id"), (F.col("l_extendedprice") * edge).alias("net_pnl"), edge.alias("net_return"), (F.col("l_extendedprice") * F.col("l_tax")).alias("total_fees"), F.col("l_extendedprice").alias("entry_trade_value"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("exit_trade_value"))
    found = performance.performance(performance.daily(p, "id", "session", "date", "close", "invested"), trades, "id", INITIAL, 52.0, RISK_FREE)
    return found.withColumns({c: F.round(c, _places(c)) + F.lit(0.0) for c in _COLUMNS} | {"ending_equity": F.round("ending_equity", 6) + F.lit(0.0)})


@REG.add(
    "curve_pairs",
    f"""WITH {SERIES}, src AS (SELECT series AS key, session AS date, exp(sum(ln(1 + r)) OVER (PARTITION BY series ORDER BY session)) AS value, 0 AS invested FROM series), {_daily_sql("src").replace("date_diff('day', first(date) OVER (PARTITION BY key, g ORDER BY date), date)", "0")},
    p AS (SELECT a.key AS strategy_a, b.key AS strategy_b, a.ret AS x, b.ret AS y, a.drawdown AS da, b.drawdown AS db FROM daily a JOIN daily b ON a.date = b.date AND a.key < b.key WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL)
    SELECT strategy_a, strategy_b, count(*) AS aligned_days, {r("CASE WHEN count(*) >= 3 AND isfinite(corr(x, y)) THEN corr(x, y) END", "daily_return_corr")}, {", ".join(r(f"avg(CASE WHEN round(da, 9) <= -{k} / 100.0 {op} round(db, 9) <= -{k} / 100.0 THEN 1.0 ELSE 0.0 END)", f"{w}_under_{k}pct_fraction") for k in (10, 20) for op, w in (("AND", "both"), ("OR", "either")))} FROM p GROUP BY 1, 2""",
)
def curve_pairs(spark, d):
    """Regions and market as curves of their weekly returns."""
    w = Window.partitionBy("series").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    start = F.lit("1990-01-01").cast("date")
    c = _series(spark, d).select("series", "session", F.date_add(start, F.col("session").cast("int")).alias("date"), F.exp(F.sum(F.log1p("r")).over(w)).alias("value"))
    rows = performance.daily(c, "series", "session", "date", "value").withColumn("drawdown", F.round("drawdown", 9))
    return rounded(performance.pair_diagnostics(rows))
