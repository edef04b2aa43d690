"""Connected components of an edge table, by alternating star steps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltern.llm.common import join_heavy, stage


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours join the smallest of its neighbours and itself."""
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours join the smallest of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    rest = down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
    return rest.union(low.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b): component is the smallest node reachable.

    A round costs a few shuffles of the edges, whose number never grows; rounds grow with the logarithm of the longest
    chain. Loops and repeated edges are allowed; an empty table has no components.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        now = stage(_small_star(_large_star(now)), "edges")
        sums = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if sums == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = sums
    raise RuntimeError(f"no fixed point in {max_rounds} rounds")


def least_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component_id): the smallest ``first`` among the rows of ``nodes`` (node, first) that ``edges`` (a, b) connect."""
    named = nodes.join(components(edges), "node", "left").select("node", "first", F.coalesce("component", "node").alias("root"))
    named = stage(named, "named")
    least = stage(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members")), "least")
    total = least.agg(F.sum("members")).first()[0] or 0
    return join_heavy(named, least, ["root"], "members", total).select("node", "component_id")
