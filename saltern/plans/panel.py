"""Panels derived from the test tables, as DataFrames and as the same DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saltern.functions.frames import exact_lag, rows_of


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def with_sessions(panel: DataFrame, days: DataFrame) -> DataFrame:
    """Number the distinct dates of ``days`` from 0.

    ``days`` is read from the scan, so rows aren't aggregated twice. There is one row for each calendar date, some 73,000
    in two centuries, whatever the table's size: that bounds the broadcast.
    """
    dates = days.distinct().withColumn("session", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))
    return panel.join(F.broadcast(dates), "date")


def supplier_panel(spark: SparkSession, d: str) -> DataFrame:
    """id (supplier), date (week), session, open, high, low, close, volume, turnover."""
    li = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("id"),
        F.date_trunc("week", "l_shipdate").cast("date").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        "l_quantity",
        "l_extendedprice",
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("place"),
    )
    panel = li.groupBy("id", "date").agg(
        F.min_by("px", "place").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "place").alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.sum("l_extendedprice").alias("turnover"),
    )
    return with_sessions(panel, li.select("date"))


SUPPLIER_PANEL = """
li AS (SELECT l_suppkey AS id, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_extendedprice / l_quantity AS px, * FROM lineitem),
bars AS (SELECT id, date,
    first(px ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open, max(px) AS high, min(px) AS low,
    last(px ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close,
    sum(l_quantity) AS volume, sum(l_extendedprice) AS turnover FROM li GROUP BY id, date),
days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS session FROM (SELECT DISTINCT date FROM bars)),
panel AS (SELECT bars.*, session FROM bars JOIN days USING (date))
"""


def user_panel(spark: SparkSession, d: str) -> DataFrame:
    """id (user), date (day), session, close (last value), volume (events), turnover (sum of values)."""
    ev = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("ts").cast("date").alias("date"), "ts", "value")
    panel = ev.groupBy("id", "date").agg(F.max_by("value", "ts").alias("close"), F.count("*").alias("volume"), F.sum("value").alias("turnover"))
    return with_sessions(panel, ev.select("date"))


USER_PANEL = """
bars AS (SELECT user_id AS id, CAST(ts AS DATE) AS date, last(value ORDER BY ts) AS close, count(*) AS volume, sum(value) AS turnover FROM events GROUP BY 1, 2),
days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS session FROM (SELECT DISTINCT date FROM bars)),
panel AS (SELECT bars.*, session FROM bars JOIN days USING (date))
"""


def with_return(panel: DataFrame, k: int = 1, name: str | None = None) -> DataFrame:
    """Exact-session return over k sessions."""
    w = rows_of("id", "session")
    before = exact_lag("close", k, "session", w)
    return panel.withColumn(name or f"return_{k}", F.when(before > 0, F.col("close") / before - 1))


def sql_return(k: int) -> str:
    return f"CASE WHEN lag(session, {k}) OVER w = session - {k} AND lag(close, {k}) OVER w > 0 THEN close / lag(close, {k}) OVER w - 1 END"


RETURNS = SUPPLIER_PANEL + f""",
returns AS (SELECT *, {sql_return(1)} AS return_1, {sql_return(5)} AS return_5, {sql_return(20)} AS return_20 FROM panel WINDOW w AS (PARTITION BY id ORDER BY session))
"""


def returns(spark: SparkSession, d: str) -> DataFrame:
    p = supplier_panel(spark, d)
    for k in (1, 5, 20):
        p = with_return(p, k)
    return p


def market(spark: SparkSession, d: str) -> DataFrame:
    """date, session, market_return: the turnover-weighted mean return of the sessions that have one."""
    r = returns(spark, d).where("return_1 is not null")
    return r.groupBy("date", "session").agg((F.sum(F.col("return_1") * F.col("turnover")) / F.sum("turnover")).alias("market_return"))


MARKET = RETURNS + """,
market AS (SELECT date, session, sum(return_1 * turnover) / sum(turnover) AS market_return FROM returns WHERE return_1 IS NOT NULL GROUP BY date, session)
"""


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that another order of summation gives the same values (and no negative zero)."""
    return df.select(*[(F.round(F.col(f.name), places) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])
