"""Temporal joins, identity over time, corporate actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltern.operators import features as ft
from saltern.operators import temporal as tp
from saltern.plans.panel import SUPPLIER_PANEL, USER_PANEL, rounded, supplier_panel, table, user_panel
from saltern.plans.registry import Registry, r

REG = Registry()

# Events of some suppliers: one in sixty sessions, with multipliers in turn.
ACTIONS = "actions AS (SELECT id, date AS ex_date, session, CASE (session // 60) % 3 WHEN 0 THEN 2.0 WHEN 1 THEN 0.5 ELSE 5.0 END AS multiplier FROM panel WHERE id % 7 = 0 AND session % 60 = id % 60)"


def actions(p):
    turn = F.floor(F.col("session") / 60) % 3
    return p.where("id % 7 = 0 and session % 60 = id % 60").select("id", F.col("date").alias("ex_date"), "session", F.when(turn == 0, 2.0).when(turn == 1, 0.5).otherwise(5.0).alias("multiplier"))


@REG.add(
    "asof_join",
    """WITH q AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL), v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view')
    SELECT v.event_id, v.user_id, round(q.value, 6) + 0.0 AS last_value, q.ts AS last_ts FROM v ASOF LEFT JOIN q ON v.user_id = q.user_id AND v.ts >= q.ts""",
)
def asof_join(spark, d):
    ev = table(spark, d, "events")
    right = ev.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    out = tp.asof_join(ev.where("event_type = 'view'").select("event_id", "user_id", "ts"), right, "user_id", "ts", ["value"], "last_")
    return rounded(out.select("event_id", "user_id", "last_value", F.col("last_at").alias("last_ts")))


@REG.add(
    "asof_leak_check",
    """WITH q AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase' GROUP BY ALL), v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'),
    j AS (SELECT v.ts AS a, q.ts AS b FROM v ASOF LEFT JOIN q ON v.user_id = q.user_id AND v.ts >= q.ts) SELECT count(*) AS n, count(b) AS n_matched, count(*) FILTER (b > a) AS n_leaks FROM j""",
)
def asof_leak_check(spark, d):
    ev = table(spark, d, "events")
    right = ev.where("event_type = 'purchase'").select("user_id", "ts").distinct().withColumn("one", F.lit(1))
    out = tp.asof_join(ev.where("event_type = 'view'").select("event_id", "user_id", "ts"), right, "user_id", "ts", ["one"])
    return out.agg(F.count("*").alias("n"), F.count("at").alias("n_matched"), F.count(F.when(F.col("at") > F.col("ts"), 1)).alias("n_leaks"))


HALF_YEARS = "half AS (SELECT CAST(range AS INTEGER) AS k, CAST(DATE '1995-02-01' + to_months(6 * CAST(range AS INTEGER)) AS DATE) AS effective_from, CASE WHEN range < 11 THEN CAST(DATE '1995-02-01' + to_months(6 * (CAST(range AS INTEGER) + 1)) AS DATE) END AS effective_until FROM range(12))"


@REG.add(
    "interval_join",
    f"""WITH {HALF_YEARS}, o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)
    SELECT o_orderkey, day, k AS period FROM o LEFT JOIN half ON day >= effective_from AND (effective_until IS NULL OR day < effective_until)""",
)
def interval_join(spark, d):
    start = F.lit("1995-02-01").cast("date")
    p = spark.range(12).select(F.col("id").cast("int").alias("period"), F.add_months(start, F.col("id").cast("int") * 6).alias("effective_from"), F.when(F.col("id") < 11, F.add_months(start, (F.col("id").cast("int") + 1) * 6)).alias("effective_until"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return tp.interval_join(o, p, "day", "effective_from", "effective_until").select("o_orderkey", "day", "period")


@REG.add(
    "bracket_join",
    """WITH ev AS (SELECT o_orderkey AS event, o_custkey % 50 AS symbol, CAST(o_orderdate AS DATE) AS date FROM orders),
    rw AS (SELECT DISTINCT l_suppkey % 50 AS symbol, CAST(l_shipdate AS DATE) AS date, l_suppkey AS id FROM lineitem),
    byday AS (SELECT event, date_diff('day', ev.date, rw.date) AS off, count(DISTINCT id) AS n, min(id) AS id FROM ev JOIN rw ON ev.symbol = rw.symbol AND abs(date_diff('day', ev.date, rw.date)) <= 7 GROUP BY 1, 2),
    e AS (SELECT event, n, id FROM byday WHERE off = 0), l AS (SELECT event, max(off) AS off, arg_max(n, off) AS n, arg_max(id, off) AS id FROM byday WHERE off < 0 GROUP BY event), t AS (SELECT event, min(off) AS off, arg_min(n, off) AS n, arg_min(id, off) AS id FROM byday WHERE off > 0 GROUP BY event),
    s AS (SELECT ev.event, CASE WHEN e.n = 1 THEN 'mapped' WHEN e.n > 1 THEN 'ambiguous_exact' WHEN l.n > 1 AND (t.off IS NULL OR -l.off <= t.off OR t.n = 1) THEN 'ambiguous_left' WHEN t.n > 1 THEN 'ambiguous_right' WHEN l.off IS NULL OR t.off IS NULL THEN 'unmapped' WHEN l.id = t.id THEN 'mapped_bracket' ELSE 'conflicting_bracket' END AS status, e.id AS ei, l.id AS li FROM ev LEFT JOIN e USING (event) LEFT JOIN l USING (event) LEFT JOIN t USING (event))
    SELECT event, status, CASE status WHEN 'mapped' THEN ei WHEN 'mapped_bracket' THEN li END AS id FROM s""",
)
def bracket_join(spark, d):
    ev = table(spark, d, "orders").select(F.col("o_orderkey").alias("event"), (F.col("o_custkey") % 50).alias("symbol"), F.col("o_orderdate").cast("date").alias("date"))
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("id")).distinct()
    return tp.bracket_join(ev, rows, "symbol")


@REG.add(
    "unsafe_window_join",
    f"""WITH {SUPPLIER_PANEL}, {ACTIONS} SELECT p.id, p.session, EXISTS (SELECT 1 FROM actions a WHERE a.id = p.id AND p.session BETWEEN a.session - 5 AND a.session + 2) AS in_window FROM panel p""",
)
def unsafe_window_join(spark, d):
    p = supplier_panel(spark, d)
    return tp.event_windows(p.select("id", "session"), actions(p), "id", 5, 2).select("id", "session", "in_window")


@REG.add(
    "session_lookup",
    f"""WITH {SUPPLIER_PANEL}, o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) SELECT day, (SELECT min(session) FROM days WHERE date >= day) AS session FROM o""",
)
def session_lookup(spark, d):
    days = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    sessions = supplier_panel(spark, d).select("date", "session").distinct()
    return tp.session_lookup(days, sessions, "day").select("day", "session")


@REG.add(
    "adjustment_factor",
    f"""WITH {SUPPLIER_PANEL}, {ACTIONS}, f AS (SELECT p.id, p.session, close, coalesce((SELECT exp(sum(ln(multiplier))) FROM actions a WHERE a.id = p.id AND a.ex_date > p.date), 1.0) AS factor FROM panel p)
    SELECT id, session, {r("factor", "factor", 9)}, {r("close / factor", "adjusted_close", 9)} FROM f""",
)
def adjustment_factor(spark, d):
    p = supplier_panel(spark, d)
    out = tp.adjustment_factor(p.select("id", "session", "date", "close"), actions(p).select("id", "ex_date", "multiplier"))
    return rounded(out.select("id", "session", "factor", (F.col("close") / F.col("factor")).alias("adjusted_close")), 9)


@REG.add(
    "mechanical_events_collapse",
    f"""WITH {SUPPLIER_PANEL}, {ACTIONS}, m AS (SELECT id, ex_date, multiplier FROM actions UNION ALL SELECT id, ex_date, multiplier FROM actions UNION ALL SELECT id, ex_date, 3.0 FROM actions WHERE session % 2 = 0)
    SELECT id, ex_date, round(exp(sum(ln(multiplier))), 6) + 0.0 AS multiplier, count(*) AS n_events FROM (SELECT DISTINCT * FROM m) GROUP BY id, ex_date""",
)
def mechanical_events_collapse(spark, d):
    a = actions(supplier_panel(spark, d))
    one = a.select("id", "ex_date", "multiplier")
    extra = a.where("session % 2 = 0").select("id", "ex_date", F.lit(3.0).alias("multiplier"))
    return rounded(tp.collapse_events(one.unionByName(one).unionByName(extra)))


EPISODES = f"""{USER_PANEL}, e0 AS (SELECT id, date, session, volume, CASE WHEN date_diff('day', lag(date) OVER (PARTITION BY id ORDER BY date), date) > 1 THEN 1 ELSE 0 END AS nw FROM panel),
episodes AS (SELECT id, date, session, volume, CAST(sum(nw) OVER (PARTITION BY id ORDER BY date) AS BIGINT) AS episode FROM e0)"""


def user_episodes(spark, d):
    return tp.episodes(user_panel(spark, d), "id", "date", 1)


@REG.add("episodes_gap", f"WITH {EPISODES} SELECT id, date, episode FROM episodes")
def episodes_gap(spark, d):
    return user_episodes(spark, d).select("id", "date", "episode")


@REG.add("episode_summary", f"WITH {EPISODES} SELECT id, episode, min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows, CAST(sum(volume) AS BIGINT) AS n_events FROM episodes GROUP BY id, episode")
def episode_summary(spark, d):
    return user_episodes(spark, d).groupBy("id", "episode").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_rows"), F.sum("volume").alias("n_events"))


@REG.add(
    "identity_fill",
    f"""WITH {EPISODES}, a AS (SELECT *, CASE WHEN volume % 4 = 1 THEN 'ISIN' || CAST((id + session // 9) % 3 AS VARCHAR) END AS anchor FROM episodes),
    b AS (SELECT *, last_value(anchor IGNORE NULLS) OVER (PARTITION BY id, episode ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l, first_value(anchor IGNORE NULLS) OVER (PARTITION BY id, episode ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q,
        count(DISTINCT anchor) OVER (PARTITION BY id, episode) AS n FROM a),
    c AS (SELECT *, CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN coalesce(l, q) WHEN l IS NULL THEN q WHEN q IS NULL THEN l WHEN l = q THEN l END AS filled FROM b)
    SELECT id, date, episode, filled, CASE WHEN anchor IS NOT NULL THEN 'own' WHEN filled IS NULL THEN 'unresolved' WHEN l IS NULL THEN 'backfill' WHEN q IS NULL THEN 'forward_fill' ELSE 'between' END AS method FROM c""",
)
def identity_fill(spark, d):
    anchor = F.when(F.col("volume") % 4 == 1, F.concat(F.lit("ISIN"), ((F.col("id") + F.floor(F.col("session") / 9)) % 3).cast("string")))
    out = tp.identity_fill(user_episodes(spark, d).withColumn("anchor", anchor), ["id", "episode"], "date", "anchor")
    return out.select("id", "date", "episode", "filled", "method")


_METHOD = """CASE WHEN anchor IS NOT NULL THEN 'exact_isin' WHEN n = 0 THEN 'unresolved_no_anchor' WHEN l IS NULL THEN CASE WHEN n = 1 THEN 'backward_single_isin_episode' ELSE 'backward_first_anchor_multi_isin_episode' END
    WHEN q IS NULL THEN CASE WHEN n = 1 THEN 'forward_single_isin_episode' ELSE 'forward_last_anchor_multi_isin_episode' END WHEN l = q THEN CASE WHEN n = 1 THEN 'bridge_single_isin_episode' ELSE 'bridge_matching_anchors_multi_isin_episode' END ELSE 'unresolved_between_isin_change' END"""
_OWN = "(PARTITION BY id, episode ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_AFTER = "(PARTITION BY id, episode ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@REG.add(
    "identity_resolution",
    f"""WITH {EPISODES}, a AS (SELECT *, CASE WHEN volume % 4 = 1 THEN 'ISIN' || CAST((id + session // 9) % 3 AS VARCHAR) END AS anchor FROM episodes), p AS (SELECT *, CASE WHEN anchor IS NOT NULL THEN date END AS anchored FROM a),
    b AS (SELECT *, last_value(anchor IGNORE NULLS) OVER {_OWN} AS l, first_value(anchor IGNORE NULLS) OVER {_AFTER} AS q, last_value(anchored IGNORE NULLS) OVER {_OWN} AS anchor_before, first_value(anchored IGNORE NULLS) OVER {_AFTER} AS anchor_after,
        count(DISTINCT anchor) OVER (PARTITION BY id, episode) AS n, min(date) OVER (PARTITION BY id, episode) AS episode_start, max(date) OVER (PARTITION BY id, episode) AS episode_end FROM p),
    c AS (SELECT *, {_METHOD} AS method FROM b), s AS (SELECT *, CAST(CASE method {" ".join(f"WHEN '{k}' THEN {v}" for k, v in tp.CONFIDENCE.items())} END AS DOUBLE) AS confidence FROM c)
    SELECT id, date, episode, CASE WHEN confidence > 0 THEN coalesce(anchor, l, q) END AS resolved, method, confidence, anchor_before, anchor_after, episode_start, episode_end FROM s""",
)
def identity_resolution(spark, d):
    anchor = F.when(F.col("volume") % 4 == 1, F.concat(F.lit("ISIN"), ((F.col("id") + F.floor(F.col("session") / 9)) % 3).cast("string")))
    out = tp.identity_resolution(user_episodes(spark, d).withColumn("anchor", anchor), ["id", "episode"], "date", "anchor")
    return out.select("id", "date", "episode", "resolved", "method", "confidence", "anchor_before", "anchor_after", "episode_start", "episode_end")


@REG.add(
    "unambiguous_map",
    "SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) = 1",
)
def unambiguous_map(spark, d):
    """Parts whose large deliveries all come from one supplier."""
    return tp.unambiguous(table(spark, d, "lineitem").where("l_quantity > 45"), "l_partkey", "l_suppkey")


@REG.add(
    "pareto_bands",
    f"""WITH {USER_PANEL}, t AS (SELECT id, sum(turnover) AS total FROM panel GROUP BY id), s AS (SELECT id, sum(total) OVER (ORDER BY total DESC, id ROWS UNBOUNDED PRECEDING) / sum(total) OVER () AS share, total / sum(total) OVER () AS own FROM t)
    SELECT id, {r("share", "share")}, CASE WHEN share - own < 0.8 THEN 'A_top_80pct' WHEN share - own < 0.95 THEN 'B_next_15pct' ELSE 'C_tail_5pct' END AS band FROM s""",
)
def pareto_bands(spark, d):
    from saltern.operators.aggregates import pareto

    return rounded(pareto(user_panel(spark, d).groupBy("id").agg(F.sum("turnover").alias("total")), "id", "total"))


@REG.add(
    "ohlc_resample_week",
    """WITH x AS (SELECT user_id AS id, CAST(CAST(ts AS DATE) + CAST((12 - isodow(ts)) % 7 AS INTEGER) AS DATE) AS label, ts, event_id, value FROM events)
    SELECT id, label, round(first(value ORDER BY ts, event_id), 6) + 0.0 AS open, round(max(value), 6) + 0.0 AS high, round(min(value), 6) + 0.0 AS low, round(last(value ORDER BY ts, event_id), 6) + 0.0 AS close, count(*) AS n FROM x GROUP BY id, label""",
)
def ohlc_resample_week(spark, d):
    from saltern.operators.aggregates import bars

    ev = table(spark, d, "events").withColumn("label", F.next_day(F.date_sub(F.col("ts").cast("date"), 1), "Fri"))
    return rounded(bars(ev, ["user_id", "label"], "value", ["ts", "event_id"]).withColumnRenamed("user_id", "id"))


@REG.add(
    "ohlc_resample_month",
    """SELECT o_custkey AS id, CAST(last_day(CAST(o_orderdate AS DATE)) AS DATE) AS label, round(first(o_totalprice ORDER BY o_orderdate, o_orderkey), 6) + 0.0 AS open, round(max(o_totalprice), 6) + 0.0 AS high, round(min(o_totalprice), 6) + 0.0 AS low,
    round(last(o_totalprice ORDER BY o_orderdate, o_orderkey), 6) + 0.0 AS close, count(*) AS n FROM orders GROUP BY ALL""",
)
def ohlc_resample_month(spark, d):
    from saltern.operators.aggregates import bars

    o = table(spark, d, "orders").withColumn("label", F.last_day(F.col("o_orderdate").cast("date")))
    return rounded(bars(o, ["o_custkey", "label"], "o_totalprice", ["o_orderdate", "o_orderkey"]).withColumnRenamed("o_custkey", "id"))


@REG.add("candles_lookback", f"WITH {SUPPLIER_PANEL} SELECT id, session, {r('close', 'close', 9)}, {r('close / first_value(close) OVER (PARTITION BY id ORDER BY session) - 1', 'change', 9)} FROM panel WHERE session > (SELECT max(session) FROM panel) - 30")
def candles_lookback(spark, d):
    p = supplier_panel(spark, d)
    top = p.agg((F.max("session") - 30).alias("_from"))  # one row
    recent = p.join(F.broadcast(top), F.col("session") > F.col("_from"))
    return rounded(recent.select("id", "session", "close", (F.col("close") / F.first("close").over(ft.own_rows()) - 1).alias("change")), 9)


