"""Market and sector context of the supplier panel, and its streaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltern.operators import context, diagnostics
from saltern.operators import features as ft
from saltern.operators.aggregates import BANDS, pareto
from saltern.plans.feature_queries import W, rows
from saltern.plans.panel import RETURNS, SUPPLIER_PANEL, USER_PANEL, returns, rounded, sql_return, supplier_panel, user_panel, with_return
from saltern.plans.portfolio_queries import MOMENTUM, momentum_rows
from saltern.plans.registry import Registry, r
from saltern.plans.relational_queries import REGION_OF, SECTORS, regions

REG = Registry()
LOOKBACKS = (1, 3, 5, 10, 20, 60)
HORIZONS = (1, 5, 20)


@REG.add("session_lookbacks", f"WITH {SUPPLIER_PANEL} SELECT id, session, {', '.join(r(sql_return(k), f'return_{k}') for k in LOOKBACKS)} FROM panel {W}")
def session_lookbacks(spark, d):
    p = supplier_panel(spark, d)
    for k in LOOKBACKS:
        p = with_return(p, k)
    return rounded(p.select("id", "session", *[f"return_{k}" for k in LOOKBACKS]))


_SIGNED = {"close_streak": "close / nullif(pc, 0) - 1", "intraday_streak": "CASE WHEN open > 0 THEN close / open - 1 END", "high_streak": "high - ph", "low_streak": "low - pl", "gap_streak": "open / nullif(pc, 0) - 1"}
_TRUE = {"up_close_run": "close / nullif(pc, 0) - 1 > 0", "down_close_run": "close / nullif(pc, 0) - 1 < 0", "bullish_run": "open > 0 AND close / open - 1 > 0", "bearish_run": "open > 0 AND close / open - 1 < 0", "higher_high_run": "high > ph", "lower_low_run": "low < pl"}


def _streak_sql() -> str:
    """Each streak by its own islands: numbered groups, then positions in them."""
    before = f"b AS (SELECT *, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM panel {W})"
    sign = ", ".join(f"CASE WHEN ({x}) IS NULL OR abs({x}) <= 1e-15 THEN 0 ELSE sign({x}) END AS {n}" for n, x in _SIGNED.items())
    truth = ", ".join(f"CASE WHEN coalesce({c}, false) THEN 1 ELSE 0 END AS {n}" for n, c in _TRUE.items())
    new = ", ".join(f"CASE WHEN {n} = lag({n}) OVER w THEN 0 ELSE 1 END AS n_{n}" for n in _SIGNED)
    group = ", ".join([f"sum(n_{n}) OVER w AS g_{n}" for n in _SIGNED] + [f"sum(1 - {n}) OVER w AS g_{n}" for n in _TRUE])
    out = ", ".join([f"CAST({n} * row_number() OVER (PARTITION BY id, g_{n} ORDER BY session) AS BIGINT) AS {n}" for n in _SIGNED] + [f"CAST(sum({n}) OVER (PARTITION BY id, g_{n} ORDER BY session) AS BIGINT) AS {n}" for n in _TRUE])
    return f"WITH {SUPPLIER_PANEL}, {before}, s AS (SELECT id, session, {sign}, {truth} FROM b), t AS (SELECT *, {new} FROM s {W}), u AS (SELECT *, {group} FROM t {W}) SELECT id, session, {out} FROM u"


@REG.add("price_streaks", _streak_sql())
def price_streaks(spark, d):
    return ft.price_streaks(supplier_panel(spark, d)).select("id", "session", *_SIGNED, *_TRUE)


_AVERAGES = ", ".join(f"avg(return_{h}) AS market_return_{h}" for h in HORIZONS)
INDEXED = f"{RETURNS}, mk AS (SELECT session, {_AVERAGES} FROM returns GROUP BY session), j AS (SELECT returns.*, mk.* EXCLUDE (session) FROM returns JOIN mk USING (session))"


def indexed(spark, d) -> DataFrame:
    """Returns over the horizons beside those of the market: their plain mean by session, a row for each calendar date."""
    p = returns(spark, d)
    index = p.groupBy("session").agg(*[F.avg(f"return_{h}").alias(f"market_return_{h}") for h in HORIZONS])
    return p.join(F.broadcast(index), "session")


_LEADS, _FOLLOWS = (0, 1, 2, 3, 5), (1, 2, 3, 5)


def _related(x: str, y: str, name: str) -> str:
    n = f"count({x} * {y}) OVER k >= 60"
    variance = f"var_samp({y}) OVER k"
    return f"{r(f'CASE WHEN {n} THEN corr({x}, {y}) OVER k END', f'corr_{name}')}, {r(f'CASE WHEN {n} AND {variance} > 1e-15 THEN covar_samp({x}, {y}) OVER k / {variance} END', f'beta_{name}')}"


@REG.add(
    "lead_lag_relations",
    f"""WITH {INDEXED}, l AS (SELECT id, session, return_1 AS x0, market_return_1 AS m0, {', '.join(f'lag(market_return_1, {k}) OVER w AS m{k}, lag(return_1, {k}) OVER w AS x{k}' for k in _FOLLOWS)} FROM j {W})
    SELECT id, session, {', '.join([_related('x0', f'm{k}', f'market_leads_{k}') for k in _LEADS] + [_related(f'x{k}', 'm0', f'stock_leads_{k}') for k in _FOLLOWS])} FROM l WINDOW k AS {rows(120)}""",
)
def lead_lag_relations(spark, d):
    """Both directions over 120 rows: the market some rows ago with the return, and past returns with the market."""
    q = context.lead_lag_relations(indexed(spark, d).select("id", "session", "return_1", "market_return_1"), "return_1", "market_return_1", _LEADS, _FOLLOWS, 120, 60)
    return rounded(q.select("id", "session", *[f"{s}_market_leads_{k}" for k in _LEADS for s in ("corr", "beta")], *[f"{s}_stock_leads_{k}" for k in _FOLLOWS for s in ("corr", "beta")]))


@REG.add(
    "market_response",
    f"""WITH {INDEXED}, b AS (SELECT *, CASE WHEN market_return_1 IS NOT NULL THEN return_1 END AS x, CASE WHEN return_1 IS NOT NULL THEN market_return_1 END AS y FROM j),
    c AS (SELECT *, CASE WHEN count(x) OVER k >= 30 AND var_pop(y) OVER k > 1e-12 THEN covar_pop(x, y) OVER k / var_pop(y) OVER k END AS now FROM b WINDOW k AS {rows(60)}),
    e AS (SELECT *, lag(now) OVER w AS beta FROM c {W})
    SELECT id, session, {r('beta', 'market_beta')}, {', '.join(r(f'return_{h} - beta * market_return_{h}', f'response_gap_{h}') for h in (1, 20))} FROM e""",
)
def market_response(spark, d):
    """What a return has beyond its share of the market's by the beta known a row earlier, over one and twenty sessions."""
    spans = {str(h): (f"return_{h}", f"market_return_{h}") for h in (1, 20)}
    q = context.market_response(indexed(spark, d).select("id", "session", *[f"{k}_{h}" for h in (1, 20) for k in ("return", "market_return")]), "return_1", "market_return_1", spans, 60, 30)
    return rounded(q.select("id", "session", "market_beta", "response_gap_1", "response_gap_20"))


SHORT, LONG, LAGS = (60, 30), (120, 60), (1, 2)


def _sector_sql() -> str:
    strength = lambda h: f"CASE WHEN b{h} IS NOT NULL THEN (rank() OVER (PARTITION BY session ORDER BY b{h} NULLS LAST) + (count(b{h}) OVER (PARTITION BY session, b{h}) - 1) / 2.0) / count(b{h}) OVER (PARTITION BY session) END AS s{h}"
    baskets = f"b0 AS (SELECT session, sector, {', '.join(f'avg(return_{h}) AS b{h}' for h in HORIZONS)} FROM returns JOIN own USING (id) GROUP BY 1, 2), b AS (SELECT *, {', '.join(strength(h) for h in HORIZONS)} FROM b0)"
    names = ", ".join(f"'{s}'" for s in SECTORS)
    wide = f"n AS (SELECT unnest([{names}]) AS sector), m AS (SELECT j.*, n.sector, b.* EXCLUDE (session, sector) FROM j CROSS JOIN n LEFT JOIN b ON b.session = j.session AND b.sector = n.sector)"
    own = "WINDOW w AS (PARTITION BY id, sector ORDER BY session)"
    frame = lambda n: f"(PARTITION BY id, sector ORDER BY session ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    lagged = f"l AS (SELECT *, return_1 AS x, {', '.join(f'lag(b1, {k}) OVER w AS y{k}' for k in LAGS)} FROM m {own})"
    corr = lambda y, k, least, n: f"CASE WHEN count(x * {y}) OVER {k} >= {least} THEN corr(x, {y}) OVER {k} END AS {n}"
    beta = lambda k, least, n: f"CASE WHEN count(x * b1) OVER {k} >= {least} AND var_samp(b1) OVER {k} > 1e-15 THEN covar_samp(x, b1) OVER {k} / var_samp(b1) OVER {k} END AS {n}"
    made = ", ".join([corr("b1", "f", SHORT[1], "c_short"), corr("b1", "g", LONG[1], "c_long"), beta("f", SHORT[1], "b_short"), beta("g", LONG[1], "b_long"), *[corr(f"y{k}", "f", SHORT[1], f"c_lead_{k}") for k in LAGS]])
    known = ", ".join(f"lag({c}) OVER w AS {c}" for c in ("c_short", "c_long", "b_short", "b_long", *[f"c_lead_{k}" for k in LAGS]))
    first = f"q AS (SELECT *, row_number() OVER o AS place, lead(c_long) OVER o AS next FROM p WHERE c_long IS NOT NULL WINDOW o AS (PARTITION BY id, session ORDER BY round(c_long, 9) DESC, sector)), best AS (SELECT *, c_long - next AS margin FROM q WHERE place = 1 AND c_long > 0)"
    out = ["best.sector", r("c_short", "corr_short"), r("c_long", "corr_long"), r("b_short", "beta_short"), r("b_long", "beta_long"), r("margin", "margin"), "coalesce(c_long >= 0.2, false) AS confident", "coalesce(margin >= 0.05, false) AS distinct_sector"]
    out += [r(f"c_lead_{k}", f"lead_corr_{k}") for k in LAGS] + [r(f"return_1 - b_{s} * b1", f"gap_{s}") for s in ("short", "long")]
    for h in HORIZONS:
        out += [r(f"b{h}", f"sector_return_{h}"), r(f"best.return_{h} - b{h}", f"over_sector_{h}"), r(f"s{h}", f"strength_{h}"), r(f"b{h} - best.market_return_{h}", f"sector_over_market_{h}")]
    return f"""WITH {INDEXED}, {REGION_OF}, {baskets}, {wide}, {lagged}, c AS (SELECT *, {made} FROM l WINDOW f AS {frame(SHORT[0])}, g AS {frame(LONG[0])}),
    p AS (SELECT * EXCLUDE (c_short, c_long, b_short, b_long, {', '.join(f'c_lead_{k}' for k in LAGS)}), {known} FROM c {own}), {first}
    SELECT j.id, j.session, {', '.join(out).replace('return_1 - b_', 'best.return_1 - b_')} FROM j LEFT JOIN best ON best.id = j.id AND best.session = j.session"""


@REG.add("sector_context", _sector_sql())
def sector_context(spark, d):
    """The sector each supplier moved with over 120 rows up to the one before, and how its returns compare with it."""
    p = indexed(spark, d)
    means = [F.avg(f"return_{h}").alias(f"return_{h}") for h in HORIZONS]
    baskets = returns(spark, d).join(regions(spark, d), "id").groupBy("session", "sector").agg(*means)
    q = context.sector_context(p, baskets, SECTORS, HORIZONS, SHORT, LONG, LAGS)
    return rounded(q.withColumnRenamed("distinct", "distinct_sector"))


SPREADS = f"""{MOMENTUM}, z AS (SELECT session, target, sr, tr, count(*) OVER (PARTITION BY session) AS n FROM x),
spreads AS (SELECT session, count(*) AS n, corr(sr, tr) AS c, avg(target) FILTER (sr / n >= 0.9 - 1e-12) AS top, avg(target) FILTER (sr / n <= 0.1 + 1e-12) AS bottom, avg(target) AS universe FROM z WHERE n >= 10 GROUP BY session),
ic AS (SELECT *, CASE WHEN isfinite(c) THEN round(c, 9) END AS ic FROM spreads)"""


def spreads(spark, d) -> DataFrame:
    return diagnostics.decile_spread(momentum_rows(spark, d), "score", "target", 10)


@REG.add("decile_spread", f"WITH {SPREADS} SELECT session, n, {r('ic', 'ic')}, {r('top', 'top')}, {r('bottom', 'bottom')}, {r('universe', 'universe')}, {r('top - universe', 'top_excess')}, {r('top - bottom', 'top_minus_bottom')} FROM ic")
def decile_spread(spark, d):
    return rounded(spreads(spark, d))


@REG.add(
    "spread_summary",
    f"""WITH {SPREADS} SELECT count(*) AS n_sessions, {r('avg(ic)', 'mean_ic')}, {r('median(ic)', 'median_ic')}, {r('stddev_samp(ic)', 'ic_deviation')}, {r('CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic) END', 'icir')},
    {r('avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic <= 0 THEN 0.0 END)', 'positive_share')}, {r('avg(top - universe)', 'mean_top_excess')}, {r('avg(top - bottom)', 'mean_top_minus_bottom')} FROM ic""",
)
def spread_summary(spark, d):
    return rounded(diagnostics.spread_summary(spreads(spark, d)))


@REG.add(
    "review_priorities",
    f"""WITH {USER_PANEL}, t AS (SELECT id, sum(turnover) AS total FROM panel GROUP BY id), k AS (SELECT user_id AS id, count(DISTINCT event_type) > 4 AS unclear FROM events GROUP BY 1),
    s AS (SELECT id, sum(total) OVER (ORDER BY total DESC, id ROWS UNBOUNDED PRECEDING) / sum(total) OVER () - total / sum(total) OVER () AS earlier FROM t),
    b AS (SELECT id, CASE WHEN earlier < 0.8 THEN 1 WHEN earlier < 0.95 THEN 2 ELSE 3 END AS band, coalesce(unclear, false) AS ambiguous FROM s LEFT JOIN k USING (id))
    SELECT id, CASE band WHEN 1 THEN 'A_top_80pct' WHEN 2 THEN 'B_next_15pct' ELSE 'C_tail_5pct' END AS band, ambiguous,
    CASE WHEN band = 1 AND ambiguous THEN 'P0_economic_and_identity_risk' WHEN ambiguous THEN 'P1_identity_risk' WHEN band = 1 THEN 'P1_economic_relevance' WHEN band = 2 THEN 'P2' ELSE 'P3' END AS priority FROM b""",
)
def review_priorities(spark, d):
    """Users by their band of the whole turnover, those with more than four kinds of events being ambiguous."""
    bands = pareto(user_panel(spark, d).groupBy("id").agg(F.sum("turnover").alias("total")), "id", "total").select("id", "band")
    kinds = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("id")).agg((F.count_distinct("event_type") > 4).alias("unclear"))
    q = bands.join(kinds, "id", "left").withColumn("ambiguous", F.coalesce("unclear", F.lit(False)))
    return q.select("id", "band", "ambiguous", diagnostics.review_priority(F.col("band"), F.col("ambiguous"), BANDS).alias("priority"))
