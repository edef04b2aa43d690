"""What distinguishes one portfolio action from another: summaries of both portfolios, their difference, and their largest slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _summary(weight: Column, side: str) -> dict[str, Column]:
    """Aggregates over the rows of a portfolio, whose weight is null elsewhere."""
    total = F.coalesce(F.sum(weight), F.lit(0.0))
    mean = lambda v: F.when(F.sum(F.when(v.isNotNull(), weight)) > 0, F.sum(weight * v) / F.sum(F.when(v.isNotNull(), weight)))
    return {
        f"{side}_holdings_count": F.count(weight),
        f"{side}_cash_fraction": F.greatest(F.lit(0.0), 1.0 - total),
        f"{side}_exposure": F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)),
        f"{side}_weighted_score_pct": mean(F.col("score_pct")),
        f"{side}_weighted_rank": mean(F.col("rank")),
    }


def action_features(held: DataFrame, target: DataFrame, day: DataFrame, key: list[str], slots: int = 5, features: tuple[str, ...] = (), name: str = "id") -> DataFrame:
    """A row for each ``key`` that has a held or a target portfolio.

    ``held`` and ``target`` have the key, ``name`` and ``weight``; ``day`` has the key, ``name``, ``score_pct``, ``rank`` and the
    ``features``. Columns: count, cash, exposure, weighted score and rank of state and target, the differences of the latter
    two, ``turnover_fraction`` (half the sum of the changes of weights and of cash), and for each of the ``slots`` largest
    weights (ties by name) of the source and the target its weight, score, rank and features. An empty slot weighs zero and
    has nulls; a name that ``day`` doesn't know counts with its weight alone. Rows without a key or a name go; a
    portfolio with repeated names is an error of the caller's (its rows count each).
    """
    on = [*key, name]
    side = lambda df, w: df.dropna(subset=on).select(*on, F.col("weight").cast("double").alias(w))
    rows = side(held, "_state").join(side(target, "_target"), on, "full")
    known = ["score_pct", "rank", *features]
    rows = rows.join(day.select(*on, *[F.col(c).cast("double").alias(c) for c in known]), on, "left")

    def largest(w: str) -> Column:
        # a portfolio's rows: bounded by its holdings
        slot = F.struct((-F.col(w)).alias("order"), F.col(name).alias("name"), F.col(w).alias("weight"), *known)
        return F.slice(F.array_sort(F.collect_list(F.when(F.col(w).isNotNull(), slot))), 1, slots)

    state, goal = F.col("_state"), F.col("_target")
    moved = 0.5 * F.sum(F.abs(F.coalesce(goal, F.lit(0.0)) - F.coalesce(state, F.lit(0.0))))
    sums = _summary(state, "state") | _summary(goal, "target") | {"_moved": moved, "_source": largest("_state"), "_goal": largest("_target")}
    out = rows.groupBy(*key).agg(*[c.alias(n) for n, c in sums.items()])
    slot_columns = []
    for label, array in (("source", "_source"), ("target", "_goal")):
        for k in range(slots):
            at = F.get(F.col(array), k)
            slot_columns.append(F.coalesce(at["weight"], F.lit(0.0)).alias(f"{label}{k}_weight"))
            slot_columns += [at[c].alias(f"{label}{k}_{c}") for c in known]
    return out.select(
        *key,
        *[n for n in sums if not n.startswith("_")],
        (F.col("target_weighted_score_pct") - F.col("state_weighted_score_pct")).alias("delta_score_pct"),
        (F.col("target_weighted_rank") - F.col("state_weighted_rank")).alias("delta_rank"),
        (F.col("_moved") + 0.5 * F.abs(F.col("target_cash_fraction") - F.col("state_cash_fraction"))).alias("turnover_fraction"),
        *slot_columns,
    )
