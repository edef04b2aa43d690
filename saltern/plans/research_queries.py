"""Research summaries: robustness, policies, matured outcomes, classifications, samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from saltern.functions.frames import correlation, settled
from saltern.operators import features as ft
from saltern.operators.aggregates import exact_quantiles
from saltern.plans.panel import MARKET, RETURNS, SUPPLIER_PANEL, market, returns, rounded, supplier_panel, table
from saltern.plans.portfolio_queries import MOMENTUM, momentum_rows
from saltern.plans.registry import Registry, r
from saltern.plans.relational_queries import REGION_OF, regions

REG = Registry()

YEARS = f"{SUPPLIER_PANEL}, ends AS (SELECT id, CAST(year(date) AS INTEGER) AS year, arg_min(close, session) AS f, arg_max(close, session) AS l FROM panel GROUP BY 1, 2), years AS (SELECT id, year, round(l / f - 1, 9) AS v FROM ends)"


def years(spark, d):
    e = supplier_panel(spark, d).groupBy("id", F.year("date").alias("year")).agg(F.min_by("close", "session").alias("f"), F.max_by("close", "session").alias("l"))
    return e.select("id", "year", F.round(F.col("l") / F.col("f") - 1, 9).alias("v"))


@REG.add(
    "axis_summary",
    f"WITH {YEARS}, {REGION_OF} SELECT sector, year, count(*) AS n, {r('median(v)', 'median')}, {r('quantile_cont(v, 0.25)', 'q25')}, {r('min(v)', 'worst')}, {r('avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END)', 'positive_share')} FROM years JOIN own USING (id) GROUP BY sector, year",
)
def axis_summary(spark, d):
    g = years(spark, d).join(regions(spark, d), "id").groupBy("sector", "year")
    return rounded(g.agg(F.count("*").alias("n"), F.median("v").alias("median"), F.percentile("v", F.lit(0.25)).alias("q25"), F.min("v").alias("worst"), F.avg((F.col("v") > 0).cast("double")).alias("positive_share")))


@REG.add(
    "policy_scores",
    f"""WITH {YEARS}, e AS (SELECT DISTINCT year AS eval FROM years), s AS (SELECT eval, id, count(*) AS n, quantile_cont(v, 0.25) AS q25, median(v) AS md FROM e JOIN years ON year < eval GROUP BY 1, 2)
    SELECT eval AS year, id, n, {r("q25", "q25")}, {r("md", "median")} FROM (SELECT *, row_number() OVER (PARTITION BY eval ORDER BY round(q25, 9) DESC, round(md, 9) DESC, id) AS place FROM s) WHERE place = 1""",
)
def policy_scores(spark, d):
    """The best choice of each year by strictly earlier years: each past row meets the few years after it."""
    y = years(spark, d)
    evals = y.select(F.col("year").alias("eval")).distinct()  # one row for each year
    s = y.join(F.broadcast(evals), F.col("year") < F.col("eval")).groupBy("eval", "id").agg(F.count("*").alias("n"), F.percentile("v", F.lit(0.25)).alias("q25"), F.median("v").alias("median"))
    w = Window.partitionBy("eval").orderBy(F.round("q25", 9).desc(), F.round("median", 9).desc(), "id")
    return rounded(s.withColumn("place", F.row_number().over(w)).where("place = 1").select(F.col("eval").alias("year"), "id", "n", "q25", "median"))


@REG.add(
    "gross_net_pairs",
    """WITH g AS (SELECT l_suppkey AS id, 'gross' AS kind, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey, 'net', sum(l_extendedprice * (1 - l_discount)) FROM lineitem GROUP BY 1)
    SELECT id, round(max(v) FILTER (kind = 'gross'), 3) + 0.0 AS gross, round(max(v) FILTER (kind = 'net'), 3) + 0.0 AS net, round(1 - max(v) FILTER (kind = 'net') / max(v) FILTER (kind = 'gross'), 6) + 0.0 AS drag FROM g GROUP BY id""",
)
def gross_net_pairs(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.sum("l_extendedprice").alias("gross"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    return rounded(g.select("id", F.round("gross", 3).alias("gross"), F.round("net", 3).alias("net"), (1 - F.col("net") / F.col("gross")).alias("drag")))


@REG.add("relative_targets", f"WITH {MOMENTUM} SELECT id, session, {r('target - avg(target) OVER (PARTITION BY session)', 'over_mean')}, {r('target - median(target) OVER (PARTITION BY session)', 'over_median')} FROM x")
def relative_targets(spark, d):
    w = Window.partitionBy("session")
    return rounded(momentum_rows(spark, d).select("id", "session", (F.col("target") - F.avg("target").over(w)).alias("over_mean"), (F.col("target") - F.percentile("target", F.lit(0.5)).over(w)).alias("over_median")))


@REG.add(
    "sequential_policy",
    """WITH e AS (SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value / 100 - 0.5 AS v FROM events),
    s AS (SELECT episode, coalesce(min(t) FILTER (v >= 0.3), max(t)) AS stop, max(v) AS best, arg_min(v, t) AS first FROM e GROUP BY episode)
    SELECT s.episode, stop, round(v, 6) + 0.0 AS taken, round(CASE WHEN best - first > 1e-9 THEN (v - first) / (best - first) END, 6) + 0.0 AS captured FROM s JOIN e ON e.episode = s.episode AND e.t = s.stop""",
)
def sequential_policy(spark, d):
    """Stop at the first state that is good enough, else at the last; the share of the possible gain that this takes."""
    from saltern.plans.portfolio_queries import episode_values

    e = episode_values(spark, d)
    good = F.col("v") >= 0.3
    s = e.groupBy("episode").agg(F.min(F.when(good, F.col("t"))).alias("hit"), F.max("t").alias("last"), F.min_by("v", F.when(good, F.col("t"))).alias("hit_v"), F.max_by("v", "t").alias("last_v"), F.max("v").alias("best"), F.min_by("v", "t").alias("first"))
    taken, gain = F.coalesce("hit_v", "last_v"), F.col("best") - F.col("first")
    return rounded(s.select("episode", F.coalesce("hit", "last").alias("stop"), taken.alias("taken"), F.when(gain > 1e-9, (taken - F.col("first")) / gain).alias("captured")))


@REG.add(
    "matured_outcomes",
    f"""WITH {MARKET}, m AS (SELECT a.session, b.market_return AS v FROM market a LEFT JOIN market b ON b.session = a.session - 5)
    SELECT session, {r("v", "matured")}, {r("CASE WHEN count(v) OVER k >= 10 THEN avg(v) OVER k END", "matured_mean_20")} FROM m WINDOW k AS (ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
)
def matured_outcomes(spark, d):
    m = market(spark, d).select("session", "market_return")
    known = m.select((F.col("session") + 5).alias("session"), F.col("market_return").alias("v"))
    j = m.select("session").join(known, "session", "left").withColumn("id", F.lit(0))  # a dimension: one row for each session
    return rounded(j.select("session", F.col("v").alias("matured"), ft.rolling(F.avg, "v", 20, 10, "id", "session").alias("matured_mean_20")))


@REG.add(
    "run_lengths",
    """WITH a AS (SELECT user_id, event_id, ts, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT user_id, event_type, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM a), c AS (SELECT user_id, g, count(*) AS len FROM b GROUP BY 1, 2)
    SELECT user_id, count(*) - 1 AS switches, round(median(len), 6) + 0.0 AS median_run, max(len) AS longest_run FROM c GROUP BY user_id""",
)
def run_lengths(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.col("event_type") == F.lag("event_type").over(w), 0).otherwise(1)
    b = table(spark, d, "events").withColumn("n", new).withColumn("g", F.sum("n").over(w))
    c = b.groupBy("user_id", "g").agg(F.count("*").alias("len"))
    return rounded(c.groupBy("user_id").agg((F.count("*") - 1).alias("switches"), F.median("len").alias("median_run"), F.max("len").alias("longest_run")))


@REG.add("quartile_sample", "SELECT o_custkey AS state, o_orderkey AS action, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS quartile FROM orders")
def quartile_sample(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("state"), F.col("o_orderkey").alias("action"), F.ntile(4).over(w).alias("quartile"))


@REG.add(
    "row_quality",
    """SELECT count(*) AS n_rows, count(*) FILTER (nullif(value, 50) IS NULL) AS n_null_value, count(*) FILTER (value < 0) AS n_negative, count(DISTINCT user_id) AS n_users, count(*) - count(DISTINCT event_id) AS n_repeated FROM events""",
)
def row_quality(spark, d):
    ev = table(spark, d, "events")
    return ev.agg(F.count("*").alias("n_rows"), F.count_if(F.nullif("value", F.lit(50.0)).isNull()).alias("n_null_value"), F.count_if(F.col("value") < 0).alias("n_negative"), F.count_distinct("user_id").alias("n_users"), (F.count("*") - F.count_distinct("event_id")).alias("n_repeated"))


@REG.add(
    "class_cascade",
    """SELECT p_partkey, CASE WHEN p_retailprice > 1800 THEN 'premium' WHEN p_size >= 40 THEN 'large' WHEN p_size < 10 THEN 'small' ELSE 'plain' END AS class, p_retailprice > 1800 OR p_size >= 40 OR p_size < 10 AS resolved FROM part""",
)
def class_cascade(spark, d):
    """Rules in order, of which the last that matches counts, with whether any did."""
    rules = [("small", F.col("p_size") < 10), ("large", F.col("p_size") >= 40), ("premium", F.col("p_retailprice") > 1800)]
    kind = F.coalesce(*[F.when(cond, name) for name, cond in reversed(rules)], F.lit("plain"))
    return table(spark, d, "part").select("p_partkey", kind.alias("class"), (kind != "plain").alias("resolved"))


@REG.add(
    "ever_member",
    f"""WITH {SUPPLIER_PANEL}, m AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY session ORDER BY turnover DESC, id) AS n FROM panel) WHERE n <= 1) SELECT id, session FROM panel WHERE id IN (SELECT id FROM m)""",
)
def ever_member(spark, d):
    p = supplier_panel(spark, d)
    best = Window.partitionBy("session").orderBy(F.desc("turnover"), "id")
    ever = p.withColumn("n", F.row_number().over(best)).where("n <= 1").select("id").distinct()
    return p.join(ever, "id", "left_semi").select("id", "session")


@REG.add(
    "size_bucket",
    """WITH t AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier) SELECT s_suppkey, n AS place, CASE WHEN n <= 10 THEN 'large' WHEN n <= 25 THEN 'mid' ELSE 'small' END AS bucket FROM t""",
)
def size_bucket(spark, d):
    """Places over the whole table by ranges of the balance: each range starts from the count of those above it."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    edges = s.approxQuantile("s_acctbal", [k / 32 for k in range(1, 32)], 0.01)
    ranged = s.withColumn("at", sum((F.when(F.col("s_acctbal") < e, 1).otherwise(0) for e in sorted(set(edges))), F.lit(0)))
    sizes = ranged.groupBy("at").agg(F.count("*").alias("n"))  # one row for each range
    above = sizes.select("at", (F.sum("n").over(Window.orderBy("at")) - F.col("n")).alias("above"))
    own = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    s = ranged.join(F.broadcast(above), "at").withColumn("place", (F.col("above") + own).cast("long"))
    return s.select("s_suppkey", "place", F.when(F.col("place") <= 10, "large").when(F.col("place") <= 25, "mid").otherwise("small").alias("bucket"))


@REG.add(
    "period_rules",
    """WITH x AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y, CASE WHEN month(o_orderdate) <= 6 THEN 6 ELSE 12 END AS m FROM orders)
    SELECT last_day(make_date(y, m, 1)) AS measured, CASE m WHEN 6 THEN make_date(y, 8, 1) ELSE make_date(y + 1, 2, 1) END AS effective FROM x""",
)
def period_rules(spark, d):
    """Half-years measured in June take effect in August, those of December in the next February."""
    x = table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), F.when(F.month("o_orderdate") <= 6, 6).otherwise(12).alias("m")).distinct()
    first = F.make_date("y", "m", F.lit(1))
    return x.select(F.last_day(first).alias("measured"), F.add_months(first, 2).alias("effective"))


@REG.add("rebased_index", f"WITH {SUPPLIER_PANEL} SELECT id, session, {r('50000 * close / first_value(close) OVER (PARTITION BY id ORDER BY session)', 'rebased', 4)} FROM panel")
def rebased_index(spark, d):
    return rounded(supplier_panel(spark, d).select("id", "session", (50000 * F.col("close") / F.first("close").over(ft.own_rows())).alias("rebased")), 4)


@REG.add(
    "model_rank_correlation",
    f"""WITH {MOMENTUM}, y AS (SELECT session, sr, rank() OVER (PARTITION BY session ORDER BY turnover) + (count(*) OVER (PARTITION BY session, turnover) - 1) / 2.0 AS ur FROM x), g AS (SELECT session, round(corr(sr, ur), 9) AS c FROM y GROUP BY session HAVING count(*) >= 10)
    SELECT count(*) AS n_sessions, {r("avg(c)", "mean")}, {r("quantile_cont(c, 0.25)", "q25")}, {r("quantile_cont(c, 0.75)", "q75")} FROM g WHERE isfinite(c)""",
)
def model_rank_correlation(spark, d):
    from saltern.functions.frames import mean_rank

    y = momentum_rows(spark, d).select("session", "sr", mean_rank("turnover", "session").alias("ur"))
    g = y.groupBy("session").agg(F.count("*").alias("n"), F.round(correlation("sr", "ur"), 9).alias("c")).where("n >= 10 and c is not null")
    return rounded(g.agg(F.count("*").alias("n_sessions"), F.avg("c").alias("mean"), F.percentile("c", F.lit(0.25)).alias("q25"), F.percentile("c", F.lit(0.75)).alias("q75")))


@REG.add(
    "daily_dispersion",
    f"""WITH {RETURNS} SELECT session, count(return_1) AS n, {r("stddev_samp(return_1)", "dispersion")}, {r("quantile_cont(return_1, 0.9) - quantile_cont(return_1, 0.1)", "spread")}, {r("avg(CASE WHEN return_1 > 0 THEN 1.0 WHEN return_1 <= 0 THEN 0.0 END)", "breadth")} FROM returns GROUP BY session""",
)
def daily_dispersion(spark, d):
    q = lambda p: F.percentile("return_1", F.lit(p))
    up = F.when(F.col("return_1").isNotNull(), (F.col("return_1") > 0).cast("double"))
    return rounded(returns(spark, d).groupBy("session").agg(F.count("return_1").alias("n"), F.stddev_samp("return_1").alias("dispersion"), (q(0.9) - q(0.1)).alias("spread"), F.avg(up).alias("breadth")))


@REG.add("transition_shift", "SELECT event_id, lead(event_type) OVER w AS next_type, round(lead(value) OVER w, 6) + 0.0 AS next_value, lead(event_id) OVER w IS NOT NULL AS has_next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def transition_shift(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return rounded(table(spark, d, "events").select("event_id", F.lead("event_type").over(w).alias("next_type"), F.lead("value").over(w).alias("next_value"), F.lead("event_id").over(w).isNotNull().alias("has_next")))


@REG.add("hash_sample", "SELECT o_orderkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 50")
def hash_sample(spark, d):
    """A random sample that is the same in every run: the least hashes."""
    return table(spark, d, "orders").select("o_orderkey").orderBy(F.md5(F.col("o_orderkey").cast("string")), "o_orderkey").limit(50)


@REG.add(
    "numeric_profile",
    f"""WITH {RETURNS} SELECT count(return_1) AS n, count(DISTINCT round(return_1, 6)) AS n_distinct, {r("quantile_cont(return_1, 0.01)", "q01")}, {r("median(return_1)", "median")}, {r("quantile_cont(return_1, 0.99)", "q99")}, stddev_samp(return_1) < 1e-12 AS near_constant FROM returns""",
)
def numeric_profile(spark, d):
    x = settled(returns(spark, d).select("return_1"))
    q = [F.lit(v).cast("double").alias(n) for n, v in zip(("q01", "median", "q99"), exact_quantiles(x, "return_1", [0.01, 0.5, 0.99]), strict=True)]
    found = x.agg(F.count("return_1").alias("n"), F.count_distinct(F.round("return_1", 6)).alias("n_distinct"), (F.stddev_samp("return_1") < 1e-12).alias("near_constant"))
    return rounded(found.select("n", "n_distinct", *q, "near_constant"))


@REG.add("value_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
def value_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


@REG.add(
    "costs_by_year",
    """WITH b AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice) * 0.001, 3) AS entry FROM orders GROUP BY 1), s AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, round(sum(l_extendedprice) * 0.001, 3) AS leave FROM lineitem GROUP BY 1)
    SELECT coalesce(b.year, s.year) AS year, coalesce(entry, 0) + 0.0 AS entry_cost, coalesce(leave, 0) + 0.0 AS exit_cost FROM b FULL JOIN s ON b.year = s.year""",
)
def costs_by_year(spark, d):
    b = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice") * 0.001, 3).alias("entry_cost"))
    s = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.round(F.sum("l_extendedprice") * 0.001, 3).alias("exit_cost"))
    return b.join(s, "year", "full_outer").fillna(0.0)
