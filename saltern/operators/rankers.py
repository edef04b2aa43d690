"""Linear rankers over groups: pairs are made inside each group by a distributed gradient loop, never written out.

The loss of a group is the weighted logistic loss of its ordered pairs. A task holds one group at a time and adds up gradient and
curvature; the sums of all tasks, a few numbers for each feature pair, give a Newton step. Groups are sessions or states,
so their size is bounded by the names of a session.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weight of a pair by the better and the worse of its two ranks.
TOP_FOCUS = {"best is first": 5.0, "first five against the rest": 4.0, "both in the first five": 2.5, "first ten against the rest": 2.0, "both in the first ten": 1.2, "neither": 0.35}
#: Least weight of a pair, and what its share of the group's range adds.
GAP_BASE, GAP_SHARE = 0.2, 0.8
BLOCK = 256
SUMS = "at int, value double"


def top_focus(rank: np.ndarray) -> np.ndarray:
    """The factor of each pair of rows of these ranks (1 is best)."""
    best, worst = np.minimum(rank[:, None], rank[None]), np.maximum(rank[:, None], rank[None])
    f = TOP_FOCUS
    return np.select(
        [best == 1, (best <= 5) & (worst > 5), best <= 5, (best <= 10) & (worst > 10), best <= 10],
        [f["best is first"], f["first five against the rest"], f["both in the first five"], f["first ten against the rest"], f["both in the first ten"]],
        f["neither"],
    )


def pair_weights(q: np.ndarray, score: np.ndarray, weighting: str) -> np.ndarray:
    """The weight of each pair: ``gap`` by the difference of the targets, ``top`` more so near the best, ``ndcg`` by what a
    swap of the two would change in the normalised discounted gain of the present order. Targets are grades for ``ndcg``."""
    if weighting == "ndcg":
        place = np.empty(len(q))
        place[np.argsort(-score, kind="stable")] = np.arange(len(q))
        gain, discount = 2.0**q - 1, 1 / np.log2(place + 2)
        ideal = float((np.sort(gain)[::-1] / np.log2(np.arange(len(q)) + 2)).sum())
        return np.abs(gain[:, None] - gain[None]) * np.abs(discount[:, None] - discount[None]) / (ideal or 1.0)
    gap = np.abs(q[:, None] - q[None]) / max(1e-12, float(q.max() - q.min()))
    weight = GAP_BASE + GAP_SHARE * np.minimum(1.0, gap)
    if weighting == "top":
        rank = np.empty(len(q))
        rank[np.argsort(-q, kind="stable")] = np.arange(1, len(q) + 1)
        return weight * top_focus(rank)
    if weighting != "gap":
        raise ValueError(f"unknown weighting {weighting!r}")
    return weight


def group_sums(x: np.ndarray, q: np.ndarray, beta: np.ndarray, weighting: str) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Loss, weight, gradient and curvature of a group's pairs with different targets."""
    score = x @ beta
    weight = pair_weights(q, score, weighting)
    better = q[:, None] > q[None]
    margin = score[:, None] - score[None]
    wrong = 1 / (1 + np.exp(np.clip(margin, -500, 500)))  # the chance that the worse one is placed above
    first = np.where(better, weight * wrong, 0.0)
    second = first * (1 - wrong)
    gradient = -x.T @ (first.sum(1) - first.sum(0))
    cross = x.T @ second @ x
    curvature = (x * (second.sum(1) + second.sum(0))[:, None]).T @ x - cross - cross.T
    loss = float(np.where(better, weight * np.logaddexp(0, -margin), 0.0).sum())
    return loss, float(weight[better].sum()), gradient, curvature


def sums(rows: DataFrame, beta: np.ndarray, weighting: str) -> tuple[float, float, np.ndarray, np.ndarray]:
    """``group_sums`` of all groups of ``rows`` (group, x, q), which lie together and sorted by group."""
    p = len(beta)
    a, b = np.triu_indices(p)

    def added(batches):
        total = np.zeros(2 + p + len(a))
        x, q, own = [], [], None

        def close():
            loss, weight, gradient, curvature = group_sums(np.concatenate(x), np.concatenate(q), beta, weighting)
            total[:] += np.concatenate([[loss, weight], gradient, curvature[a, b]])

        for batch in batches:
            group = np.array(batch["group"].to_pylist(), object)
            values = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            target = batch["q"].to_numpy(zero_copy_only=False)
            edge = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if x and group[lo] != own:
                    close()
                    x, q = [], []
                own = group[lo]
                x.append(values[lo:hi])
                q.append(target[lo:hi])
        if x:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "value"])

    found = {r["at"]: r["value"] for r in rows.mapInArrow(added, SUMS).groupBy("at").agg(F.sum("value").alias("value")).collect()}
    total = np.array([found.get(k, 0.0) for k in range(2 + p + len(a))])
    curvature = np.zeros((p, p))
    curvature[a, b] = curvature[b, a] = total[2 + p :]
    return float(total[0]), float(total[1]), total[2 : 2 + p], curvature


def grouped(panel: DataFrame, features: list[str], target: str, group: str) -> DataFrame:
    """(group, x, q), each group's rows in one partition and beside each other; rows without a target or a feature go."""
    whole = panel.dropna(subset=[*features, target, group])
    rows = whole.select(F.col(group).alias("group"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.col(target).cast("double").alias("q"))
    return rows.repartition("group").sortWithinPartitions("group")


def fit_ranker(panel: DataFrame, features: list[str], target: str, group: str, weighting: str = "gap", penalty: float = 1e-4, rounds: int = 12, tolerance: float = 1e-7) -> dict[str, float]:
    """Coefficients that minimise the mean loss of a pair plus ``penalty`` times half their squares.

    Each round is one pass over rows that are cached for the loop; lost parts are computed again. With ``ndcg``, weights
    follow the present order, so the loss is another one each round and the best order seen by its loss isn't tracked: rounds
    end when coefficients stay, or after ``rounds``. Without a pair all coefficients are zero.
    """
    rows = grouped(panel, features, target, group).persist()
    try:
        beta, before = np.zeros(len(features)), None
        step = np.zeros(len(features))
        for _ in range(rounds):
            loss, weight, gradient, curvature = sums(rows, beta, weighting)
            if weight <= 0:
                break
            objective = loss / weight + penalty / 2 * float(beta @ beta)
            if weighting != "ndcg" and before is not None and objective > before + 1e-12:
                step = step / 2  # too far
                beta = beta - step
                continue
            before = objective
            step = -np.linalg.solve(curvature / weight + penalty * np.eye(len(beta)), gradient / weight + penalty * beta)
            step *= min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
            beta = beta + step
            if float(np.abs(step).max()) < tolerance:
                break
        return dict(zip(features, beta.tolist(), strict=True))
    finally:
        rows.unpersist()


def score(panel: DataFrame, coefficients: dict[str, float], name: str = "score") -> DataFrame:
    return panel.withColumn(name, sum((F.col(f).cast("double") * c for f, c in coefficients.items()), F.lit(0.0)))
