"""Joins that hold their inputs to what they promise, within the join's own pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class JoinError(ValueError):
    """A join's input broke its promise."""


@dataclass
class CheckedJoin:
    """The joined rows, and what is known of them after an action has gone over all of them."""

    rows: DataFrame
    observed: Observation
    least: float

    def verify(self) -> float:
        """The share of rows that found a partner; raises JoinError below ``least``. Call it after a whole action, as it
        waits for one. Without rows the share is 1."""
        seen = self.observed.get
        share = seen["matched"] / seen["n"] if seen["n"] else 1.0
        if share < self.least:
            raise JoinError(f"only {share:.2%} of {seen['n']} rows found a partner, but {self.least:.2%} must")
        return share


def unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``df``, whose action fails on two rows of one key; a key with a null in it is no key and its rows go.

    The check is an aggregation on the key, which a join on it needs as its shuffle anyway.
    """
    whole = df.dropna(subset=keys)
    rest = [c for c in df.columns if c not in keys]
    one = whole.groupBy(*keys).agg(F.count("*").alias("_n"), F.any_value(F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(1).alias("_one")])).alias("_row"))
    said = F.concat(F.lit(f"{what}: several rows for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    held = F.when(F.col("_n") > 1, F.raise_error(said).cast(one.schema["_row"].dataType)).otherwise(F.col("_row"))
    return one.select(*keys, held.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], validate: str = "many_to_one", coverage: float = 1.0) -> CheckedJoin:
    """Left join that keeps every left row, fails on a key that isn't unique where ``validate`` says so (``one_to_one``,
    ``many_to_one``), and counts how many rows found a partner; ``verify`` holds that share to ``coverage``.

    A left row with a null in its key is kept and counts as unmatched, also under ``one_to_one``.
    """
    if validate not in ("one_to_one", "many_to_one"):
        raise ValueError(f"unknown validation {validate!r}")
    clash = sorted((set(left.columns) & set(right.columns)) - set(keys))
    if clash:
        raise ValueError(f"columns on both sides: {', '.join(clash)}")
    if validate == "one_to_one":
        void = " or ".join(f"`{k}` is null" for k in keys)
        left = unique(left, keys, "left side").unionByName(left.where(void).select(*left.columns).select(*keys, *[c for c in left.columns if c not in keys]))
    joined = left.join(unique(right, keys, "right side").withColumn("_found", F.lit(True)), keys, "left")
    seen = Observation()
    rows = joined.observe(seen, F.count(F.lit(1)).alias("n"), F.count("_found").alias("matched")).drop("_found")
    return CheckedJoin(rows, seen, coverage)
