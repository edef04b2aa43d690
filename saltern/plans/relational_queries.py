"""Scans, joins, set operations, reshaping and scalars over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from saltern.functions import actions as ac
from saltern.functions.frames import pair_correlation, pair_moments
from saltern.operators.aggregates import kurtosis, profile, rank_correlations, skewness
from saltern.plans.panel import RETURNS, SUPPLIER_PANEL, returns, rounded, supplier_panel, table
from saltern.plans.registry import Registry, r

REG = Registry()


@REG.add("scan_project_filter", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) + 0.0 AS net FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-07-01' AND l_returnflag = 'R'")
def scan_project_filter(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate >= timestamp'1997-01-01' and l_shipdate < timestamp'1997-07-01' and l_returnflag = 'R'")
    return rounded(li.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net")))


@REG.add(
    "data_quality_report",
    f"""WITH {SUPPLIER_PANEL} SELECT count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(DISTINCT date) AS n_dates, min(date) AS first_date, max(date) AS last_date, count(*) - count(DISTINCT (id, date)) AS n_repeated, count(*) FILTER (close <= 0) AS n_bad_close, count(*) FILTER (high < low) AS n_crossed FROM panel""",
)
def data_quality_report(spark, d):
    p = supplier_panel(spark, d)
    dup = p.groupBy("id", "date").agg(F.count("*").alias("n"), F.count(F.when(F.col("close") <= 0, 1)).alias("bad"), F.count(F.when(F.col("high") < F.col("low"), 1)).alias("crossed"))
    ids, dates = p.agg(F.count_distinct("id").alias("n_ids")), p.agg(F.count_distinct("date").alias("n_dates"))  # one row each
    totals = dup.agg(F.sum("n").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum(F.col("n") - 1).alias("n_repeated"), F.sum("bad").alias("n_bad_close"), F.sum("crossed").alias("n_crossed"))
    return totals.crossJoin(F.broadcast(ids)).crossJoin(F.broadcast(dates)).select("n_rows", "n_ids", "n_dates", "first_date", "last_date", "n_repeated", "n_bad_close", "n_crossed")


@REG.add("universe_by_year", f"WITH {SUPPLIER_PANEL} SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n_rows, count(DISTINCT id) AS n_ids, round(median(turnover), 6) + 0.0 AS median_turnover FROM panel GROUP BY 1")
def universe_by_year(spark, d):
    p = supplier_panel(spark, d).withColumn("year", F.year("date"))
    return rounded(p.groupBy("year").agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.median("turnover").alias("median_turnover")))


@REG.add("semi_join", "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity >= 45)")
def semi_join(spark, d):
    li = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45")
    o = table(spark, d, "orders")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left_semi").select("o_orderkey", "o_custkey")


@REG.add("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@REG.add(
    "full_outer",
    """WITH a AS (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS nation, coalesce(n_customers, 0) AS n_customers, coalesce(n_suppliers, 0) AS n_suppliers FROM a FULL JOIN b ON a.k = b.k""",
)
def full_outer(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n_customers"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n_suppliers"))
    return a.join(b, "nation", "full_outer").fillna(0, ["n_customers", "n_suppliers"])


@REG.add(
    "null_safe_join",
    """WITH a AS (SELECT n_nationkey, n_name, nullif(n_regionkey, 0) AS k FROM nation), b AS (SELECT nullif(r_regionkey, 0) AS k, r_name FROM region) SELECT n_name, r_name FROM a LEFT JOIN b ON a.k IS NOT DISTINCT FROM b.k""",
)
def null_safe_join(spark, d):
    a = table(spark, d, "nation").select("n_name", F.nullif("n_regionkey", F.lit(0)).alias("k"))
    b = table(spark, d, "region").select(F.nullif("r_regionkey", F.lit(0)).alias("k2"), "r_name")
    return a.join(b, F.col("k").eqNullSafe(F.col("k2")), "left").select("n_name", "r_name")


@REG.add("cross_membership", "SELECT r_name, n_name, r_regionkey = n_regionkey AS is_member FROM region CROSS JOIN nation")
def cross_membership(spark, d):
    # both sides are dimensions of fixed size: explicit non-members are the feature
    rg, n = table(spark, d, "region"), table(spark, d, "nation")
    return rg.crossJoin(F.broadcast(n)).select("r_name", "n_name", (F.col("r_regionkey") == F.col("n_regionkey")).alias("is_member"))


@REG.add(
    "union_dedupe",
    """WITH u AS (SELECT o_custkey AS id, o_orderkey AS k, o_totalprice AS v, 1 AS src FROM orders UNION ALL SELECT l_suppkey, l_orderkey, sum(l_extendedprice), 2 FROM lineitem GROUP BY 1, 2)
    SELECT id, k, round(v, 6) + 0.0 AS v FROM (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY src DESC, v) AS n FROM u) WHERE n = 1""",
)
def union_dedupe(spark, d):
    """Customers' orders and suppliers' shares of orders under one key; where both have it, the later source counts."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.lit(1).alias("src"))
    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id"), F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("v"))
    u = o.unionByName(li.withColumn("src", F.lit(2)))
    w = Window.partitionBy("id", "k").orderBy(F.desc("src"), "v")
    return rounded(u.withColumn("n", F.row_number().over(w)).where("n = 1").select("id", "k", "v"))


@REG.add(
    "intersect_except",
    """WITH a AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49), b AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 49)
    SELECT id, 'both' AS side FROM (SELECT id FROM a INTERSECT SELECT id FROM b) UNION ALL SELECT id, 'first' FROM (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL SELECT id, 'second' FROM (SELECT id FROM b EXCEPT SELECT id FROM a)""",
)
def intersect_except(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity > 49")
    a, b = (li.where(F.col("l_returnflag") == f).select(F.col("l_suppkey").alias("id")).distinct() for f in ("R", "A"))
    side = lambda df, s: df.withColumn("side", F.lit(s))
    return side(a.intersect(b), "both").unionByName(side(a.exceptAll(b), "first")).unionByName(side(b.exceptAll(a), "second"))


REGION_OF = "own AS (SELECT s_suppkey AS id, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def regions(spark, d):
    s, n, g = table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "region")
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(g), n.n_regionkey == g.r_regionkey).select(F.col("s_suppkey").alias("id"), F.col("r_name").alias("sector"))


#: The sectors, which are columns of the wide matrix.
SECTORS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
BASKETS = f"{RETURNS}, {REGION_OF}, baskets AS (SELECT session, sector, avg(return_1) AS basket FROM returns JOIN own USING (id) WHERE return_1 IS NOT NULL GROUP BY 1, 2)"


def baskets(spark, d):
    return returns(spark, d).where("return_1 is not null").join(regions(spark, d), "id").groupBy("session", "sector").agg(F.avg("return_1").alias("basket"))


@REG.add("sector_baskets", f"WITH {BASKETS} SELECT session, sector, {r('basket', 'basket')} FROM baskets")
def sector_baskets(spark, d):
    return rounded(baskets(spark, d))


@REG.add("sector_pivot", f"WITH {BASKETS} SELECT session, " + ", ".join(r(f"max(basket) FILTER (sector = '{s}')", s.lower().replace(" ", "_")) for s in SECTORS) + " FROM baskets GROUP BY session")
def sector_pivot(spark, d):
    wide = baskets(spark, d).groupBy("session").pivot("sector", SECTORS).agg(F.max("basket"))
    return rounded(wide.select("session", *[F.col(f"`{s}`").alias(s.lower().replace(" ", "_")) for s in SECTORS]))


@REG.add("sector_unpivot", f"WITH {BASKETS} SELECT session, lower(replace(sector, ' ', '_')) AS sector, {r('basket', 'basket')} FROM baskets")
def sector_unpivot(spark, d):
    names = [s.lower().replace(" ", "_") for s in SECTORS]
    return sector_pivot(spark, d).unpivot("session", names, "sector", "basket").where("basket is not null")


@REG.add("sector_onehot", f"WITH {REGION_OF} SELECT id, " + ", ".join(f"CAST(sector = '{s}' AS INTEGER) AS is_{s.lower().replace(' ', '_')}" for s in SECTORS) + " FROM own")
def sector_onehot(spark, d):
    return regions(spark, d).select("id", *[(F.col("sector") == s).cast("int").alias(f"is_{s.lower().replace(' ', '_')}") for s in SECTORS])


@REG.add(
    "sector_affinity",
    f"""WITH {BASKETS}, m AS (SELECT r.id, r.session, b.sector, r.return_1 AS x, b.basket AS y FROM returns r JOIN baskets b USING (session)),
    c AS (SELECT id, session, sector, CASE WHEN count(x * y) OVER k >= 30 THEN corr(x, y) OVER k END AS cr FROM m WINDOW k AS (PARTITION BY id, sector ORDER BY session ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
    l AS (SELECT id, session, sector, round(lag(cr) OVER (PARTITION BY id, sector ORDER BY session), 6) + 0.0 AS cr FROM c),
    q AS (SELECT *, row_number() OVER (PARTITION BY id, session ORDER BY cr DESC, sector) AS n, lead(cr) OVER (PARTITION BY id, session ORDER BY cr DESC, sector) AS second FROM l WHERE cr IS NOT NULL)
    SELECT id, session, sector, cr AS correlation, round(cr - second, 6) + 0.0 AS margin FROM q WHERE n = 1 AND cr > 0""",
)
def sector_affinity(spark, d):
    # a basket for each calendar date and sector, five at most, bounds the broadcast; rows stay with their id up to the choice
    p, b = returns(spark, d).select("id", "session", "return_1"), F.broadcast(baskets(spark, d))
    # the window ends at the row before, so what it is of is shifted by a row
    before = lambda c: F.lag(c).over(Window.partitionBy("id", "sector").orderBy("session"))
    m = p.join(b, "session").select("id", "session", "sector", before("return_1").alias("x"), before("basket").alias("y"))
    c = pair_moments(m, "x", "y", 60, ["id", "sector"], "session", "k_")
    known = c.withColumn("correlation", F.round(F.when(F.col("k_n") >= 30, pair_correlation("k_")), 6) + F.lit(0.0)).where("correlation is not null")
    best = Window.partitionBy("id", "session").orderBy(F.desc("correlation"), "sector")
    q = known.select("id", "session", "sector", "correlation").withColumns({"n": F.row_number().over(best), "second": F.lead("correlation").over(best)})
    return rounded(q.where("n = 1 and correlation > 0").select("id", "session", "sector", "correlation", (F.col("correlation") - F.col("second")).alias("margin")))


#: Action texts built from part rows: a fixed layout.
PURPOSE_SQL = "CASE p_size % 5 WHEN 0 THEN 'Bonus issue ' || (p_size % 7 + 1) || ':' || (p_size % 3 + 1) WHEN 1 THEN 'Face value split from Rs ' || (p_size % 9 + 2) || ' to Re ' || (p_size % 2 + 1) WHEN 2 THEN 'Interim dividend Rs ' || p_size || ' and special Rs 1.5' WHEN 3 THEN 'Rights 1:4' ELSE p_name END"


def purposes(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", PURPOSE_SQL + " as purpose")


@REG.add("action_classify", f"SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'bonus' WHEN 1 THEN 'split_or_consolidation' WHEN 2 THEN 'dividend' WHEN 3 THEN 'rights' ELSE CASE WHEN regexp_matches(lower(p_name), 'bonus') THEN 'bonus' WHEN regexp_matches(lower(p_name), 'split|sub-?division|consolidation') THEN 'split_or_consolidation' WHEN lower(p_name) LIKE '%right%' THEN 'rights' ELSE 'other' END END AS kind FROM part")
def action_classify(spark, d):
    return purposes(spark, d).select("p_partkey", ac.action_kind("purpose").alias("kind"))


#: Purposes of every kind, with the kind that each must get.
PURPOSES = (
    ("BONUS 1:1", "bonus"),
    ("Sub-Division of shares", "split_or_consolidation"),
    ("Consolidation of shares", "split_or_consolidation"),
    ("Right issue 2:7", "rights"),
    ("Demerger of a unit", "demerger"),
    ("Scheme of Arrangement", "merger_or_scheme"),
    ("Merger", "merger_or_scheme"),
    ("Final Dividend Rs 3", "dividend"),
    ("Buy Back", "buyback"),
    ("Interest Payment", "interest"),
    ("Extraordinary General Meeting", "general_meeting"),
    (" AGM ", "general_meeting"),
    ("agm notice", "other"),
)


@REG.add("action_kinds", f"SELECT p_partkey, CASE p_partkey % {len(PURPOSES)} {' '.join(f"WHEN {k} THEN '{kind}'" for k, (_, kind) in enumerate(PURPOSES))} END AS kind FROM part")
def action_kinds(spark, d):
    texts = F.array(*[F.lit(t) for t, _ in PURPOSES])
    p = table(spark, d, "part").select("p_partkey", F.get(texts, (F.col("p_partkey") % len(PURPOSES)).cast("int")).alias("purpose"))
    return p.select("p_partkey", ac.action_kind("purpose").alias("kind"))


@REG.add("ratio_parse", f"SELECT p_partkey, {r('CASE p_size % 5 WHEN 0 THEN (p_size % 7 + 1 + p_size % 3 + 1) / (p_size % 3 + 1) WHEN 1 THEN (p_size % 9 + 2) / (p_size % 2 + 1) END', 'multiplier')} FROM part")
def ratio_parse(spark, d):
    return rounded(purposes(spark, d).select("p_partkey", ac.share_multiplier("purpose").alias("multiplier")))


@REG.add("dividend_sum", "SELECT p_partkey, CAST(CASE WHEN p_size % 5 = 2 THEN p_size + 1.5 ELSE 0 END AS DOUBLE) AS dividend FROM part")
def dividend_sum(spark, d):
    """Amounts count in texts of dividends alone: a face value is none."""
    amount = F.when(ac.action_kind("purpose") == "dividend", ac.dividend_total("purpose")).otherwise(0.0)
    return rounded(purposes(spark, d).select("p_partkey", amount.alias("dividend")))


@REG.add("stable_lineage_id", "SELECT o_orderkey, 'NSELINEAGE:' || substr(sha1(o_custkey || '|' || o_orderstatus || '|' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR)), 1, 16) AS lineage FROM orders")
def stable_lineage_id(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return o.select("o_orderkey", ac.lineage_id("o_custkey", "o_orderstatus", "day").alias("lineage"))


@REG.add("multi_format_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def multi_format_date(spark, d):
    o = table(spark, d, "orders")
    text = o.select("o_orderkey", *[F.date_format("o_orderdate", f).alias(f"t{k}") for k, f in enumerate(ac.DATE_LAYOUTS)])
    n = len(ac.DATE_LAYOUTS)
    mixed = text.select("o_orderkey", F.coalesce(*[F.when(F.col("o_orderkey") % n == k, F.col(f"t{k}")) for k in range(n)]).alias("x"))
    return mixed.select("o_orderkey", ac.any_date("x").alias("day"))


@REG.add("security_keys", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'NSE:' || s_name || ':EQ' ELSE 'ISIN:IN' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') END AS security_key, CASE WHEN s_suppkey % 3 <> 0 THEN 'IN' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') END AS isin FROM supplier")
def security_keys(spark, d):
    raw = F.when(F.col("s_suppkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" in"), F.lpad(F.col("s_suppkey").cast("string"), 10, "0")))
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", F.lit("EQ ").alias("series"), F.upper(raw).alias("raw"))
    return s.select("s_suppkey", ac.security_key("raw", "s_name", "series").alias("security_key"), ac.valid_isin(F.col("raw")).alias("isin"))


@REG.add("symbol_search", "SELECT DISTINCT p_name FROM part WHERE contains(upper(p_name), 'RE') ORDER BY p_name LIMIT 20")
def symbol_search(spark, d):
    return table(spark, d, "part").where(F.upper("p_name").contains("RE")).select("p_name").distinct().orderBy("p_name").limit(20)


@REG.add("json_properties", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def json_properties(spark, d):
    ev = table(spark, d, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return ev.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@REG.add(
    "moments",
    f"WITH {RETURNS} SELECT id, count(return_1) AS n, {r('CASE WHEN count(return_1) >= 3 THEN skewness(return_1) END', 'skew')}, {r('CASE WHEN count(return_1) >= 4 THEN kurtosis(return_1) END', 'kurt')} FROM returns GROUP BY id",
)
def moments(spark, d):
    return rounded(returns(spark, d).groupBy("id").agg(F.count("return_1").alias("n"), skewness("return_1").alias("skew"), kurtosis("return_1").alias("kurt")))


_PROFILE = ["return_1", "return_5", "volume", "turnover"]


@REG.add("feature_profile", f"WITH {RETURNS} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n_rows, count({c}) AS n_values, {r(f'count({c}) / count(*)', 'coverage')}, {r(f'avg({c})', 'mean')}, {r(f'stddev_samp({c})', 'deviation')}, {r(f'min({c})', 'least')}, {r(f'max({c})', 'most')} FROM returns" for c in _PROFILE))
def feature_profile(spark, d):
    return rounded(profile(returns(spark, d), _PROFILE))


@REG.add("feature_coverage", f"WITH {RETURNS} SELECT CAST(year(date) AS INTEGER) AS year, {r('count(return_1) / count(*)', 'return_1')}, {r('count(return_20) / count(*)', 'return_20')} FROM returns GROUP BY 1")
def feature_coverage(spark, d):
    p = returns(spark, d).groupBy(F.year("date").alias("year"))
    return rounded(p.agg((F.count("return_1") / F.count("*")).alias("return_1"), (F.count("return_20") / F.count("*")).alias("return_20")))


_RANK = lambda c: f"rank() OVER (PARTITION BY session ORDER BY {c}) + (count(*) OVER (PARTITION BY session, {c}) - 1) / 2.0"


@REG.add(
    "spearman_pairs",
    f"""WITH {RETURNS}, x AS (SELECT session, {_RANK("return_1")} AS a, {_RANK("return_5")} AS b, {_RANK("turnover")} AS c FROM returns WHERE return_1 IS NOT NULL AND return_5 IS NOT NULL),
    g AS (SELECT session, count(*) AS n, corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM x GROUP BY session HAVING count(*) > 1),
    u AS (SELECT 'return_1' AS first, 'return_5' AS second, ab AS v FROM g UNION ALL SELECT 'return_1', 'turnover', ac FROM g UNION ALL SELECT 'return_5', 'turnover', bc FROM g)
    SELECT first, second, {r("avg(CASE WHEN isfinite(v) THEN v END)", "rank_correlation")}, count(CASE WHEN isfinite(v) THEN v END) AS n_groups FROM u GROUP BY 1, 2""",
)
def spearman_pairs(spark, d):
    return rounded(rank_correlations(returns(spark, d), ["return_1", "return_5", "turnover"], "session"))


@REG.add(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 6) + 0.0 AS sum_qty, round(sum(l_extendedprice), 6) + 0.0 AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 4) + 0.0 AS sum_disc, round(avg(l_discount), 6) + 0.0 AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY 1, 2""",
)
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate <= timestamp'2001-09-02'")
    out = li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum("l_extendedprice").alias("sum_base"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sum_disc"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("n"))
    return rounded(out.withColumn("sum_disc", F.round("sum_disc", 4)))
