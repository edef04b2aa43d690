"""Ridge regressions from additive sums: one scan serves every feature set, fold and penalty.

The sums of products of all features, the target and indicators of missing values, taken by segment of time, add up to
the sums of any training span. A missing value counts as zero beside its indicator, so a fold may fill it with whatever it
knows (the mean of its own training rows) after the sums are taken.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltern.functions.frames import correlation, mean_rank, settled

GRAM = "segment int, a int, b int, value double"


def segment_of(session: str, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` lie at or before the session."""
    return sum((F.when(F.col(session) >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")


def gram(panel: DataFrame, features: list[str], target: str, cuts: list[int], session: str = "session") -> DataFrame:
    """segment, a, b, value: sums of products over the rows with a target, a <= b.

    Column 0 is 1, column 1 the target, then come the features (zero where missing) and the indicators of missing ones.
    A task sends one row for each segment and pair of columns, whatever its rows. Values that are not finite are missing.
    """
    finite = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).alias(c)
    rows = panel.select(segment_of(session, cuts).alias("segment"), finite(target), *map(finite, features)).where(F.col(target).isNotNull())
    p = len(features)

    def summed(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]])
            gone = np.isnan(x[:, 1:])
            wide = np.column_stack([np.ones(len(x)), x[:, 0], np.where(gone, 0.0, x[:, 1:]), gone])
            segment = batch.column(0).to_numpy()
            for s in np.unique(segment).tolist():
                part = wide[segment == s]
                held[s] = held.get(s, 0.0) + part.T @ part
        a, b = np.triu_indices(2 * p + 2)
        for s, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), s, np.int32)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(m[a, b])], names=["segment", "a", "b", "value"])

    return rows.mapInArrow(summed, GRAM).groupBy("segment", "a", "b").agg(F.sum("value").alias("value"))


class Sums:
    """The sums of a ``gram``, a matrix for each segment: bounded by segments and features, whatever the rows."""

    def __init__(self, rows: DataFrame, features: list[str]):
        self.features, size = list(features), 2 * len(features) + 2
        self.by: dict[int, np.ndarray] = {}
        for r in rows.collect():
            m = self.by.setdefault(r.segment, np.zeros((size, size)))
            m[r.a, r.b] = m[r.b, r.a] = r.value

    def fit(self, segments: Iterable[int], features: list[str], alpha: float) -> dict | None:
        """Intercept, coefficients by feature, and the fill of missing values; None without rows.

        Ridge over standardised features (sample deviation), with ``alpha`` times the squares of their coefficients beside
        the sum of squared residuals. A constant feature has coefficient zero.
        """
        parts = [self.by[s] for s in segments if s in self.by]
        if not parts or (g := sum(parts))[0, 0] < 1:
            return None
        at = [self.features.index(f) for f in features]
        z, gone = [2 + k for k in at], [2 + len(self.features) + k for k in at]
        n = g[0, 0]
        there = n - g[0, gone]
        fill = np.divide(g[0, z], there, out=np.zeros(len(z)), where=there > 0)
        # x = z + gone * fill
        sx = g[0, z] + g[0, gone] * fill
        cross = g[np.ix_(z, gone)] * fill
        xx = g[np.ix_(z, z)] + cross + cross.T + g[np.ix_(gone, gone)] * np.outer(fill, fill)
        xy = g[z, 1] + g[gone, 1] * fill
        mean, level = sx / n, g[0, 1] / n
        cov = xx - np.outer(sx, sx) / n
        spread = np.sqrt(np.maximum(np.diag(cov), 0) / max(1, n - 1))
        live = spread > 1e-12 * np.maximum(1e-300, np.abs(mean))
        beta = np.zeros(len(z))
        if live.any():
            s = spread[live]
            left = cov[np.ix_(live, live)] / np.outer(s, s) + alpha * np.eye(int(live.sum()))
            beta[live] = np.linalg.solve(left, (xy - sx * level)[live] / s) / s
        return {"intercept": float(level - mean @ beta), "coefficients": dict(zip(features, beta.tolist(), strict=True)), "fill": dict(zip(features, fill.tolist(), strict=True)), "n": int(n)}


@dataclass
class Folds:
    """Yearly folds: the first session of each year, and the segments that a year's training rows make up."""

    first: dict[int, int]
    purge: int

    @property
    def cuts(self) -> list[int]:
        return sorted({c for s in self.first.values() for c in (s, s - self.purge)})

    def train(self, year: int) -> list[int]:
        """Segments that end before the last ``purge`` sessions ahead of the year."""
        return list(range(self.cuts.index(self.first[year] - self.purge) + 1))

    @classmethod
    def of(cls, panel: DataFrame, purge: int) -> Folds:
        bounds = panel.groupBy("year").agg(F.min("session").alias("first")).orderBy("year").collect()  # one row a year
        return cls({r.year: r.first for r in bounds}, purge)


def _finite(c: str) -> Column:
    return F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))


def _predicted(x, coefficients, fill, intercept) -> Column:
    filled = F.zip_with(x, fill, lambda v, f: F.coalesce(v, f))
    return F.aggregate(F.zip_with(filled, coefficients, lambda v, c: v * c), intercept, lambda a, v: a + v)


def scores(panel: DataFrame, models: list[tuple[str, int, dict]], keep: list[str]) -> DataFrame:
    """``keep``, model, score: each row of a model's year scored by it. Models are (name, year, fit), a handful for each year."""
    spark = panel.sparkSession
    features = sorted({f for _, _, m in models for f in m["coefficients"]})
    table = [(name, year, m["intercept"], [m["coefficients"].get(f, 0.0) for f in features], [m["fill"].get(f, 0.0) for f in features]) for name, year, m in models]
    table = spark.createDataFrame(table, "model string, year int, intercept double, coefficients array<double>, fill array<double>")
    x = F.array(*map(_finite, features)) if features else F.array().cast("array<double>")
    rows = panel.select(*keep, *([] if "year" in keep else ["year"]), x.alias("_x")).join(F.broadcast(table), "year")
    return rows.select(*keep, "model", _predicted("_x", "coefficients", "fill", F.col("intercept")).alias("score"))


def scored_side_by_side(panel: DataFrame, models: list[tuple[str, int, dict]], keep: list[str]) -> tuple[DataFrame, list[str]]:
    """``keep`` and a column s0, s1, ... for each model's score, null in years without a fit; and the models' names."""
    names = sorted({name for name, _, _ in models})
    features = sorted({f for _, _, m in models for f in m["coefficients"]})
    by_year: dict[int, dict] = {}
    for name, year, m in models:
        by_year.setdefault(year, {})[name] = (m["intercept"], [m["coefficients"].get(f, 0.0) for f in features], [m["fill"].get(f, 0.0) for f in features])
    table = panel.sparkSession.createDataFrame([(y, *(of.get(n) for n in names)) for y, of in by_year.items()], ", ".join(["year int", *(f"m{k} struct<intercept double, coefficients array<double>, fill array<double>>" for k in range(len(names)))]))
    x = F.array(*map(_finite, features)) if features else F.array().cast("array<double>")
    rows = panel.select(*keep, *([] if "year" in keep else ["year"]), x.alias("_x")).join(F.broadcast(table), "year")
    return rows.select(*keep, *[_predicted("_x", f"m{k}.coefficients", f"m{k}.fill", F.col(f"m{k}.intercept")).alias(f"s{k}") for k in range(len(names))]), names


def diagnostics(scored: DataFrame, target: str, session: str = "session", least: int = 2) -> DataFrame:
    """model, n_sessions, mean_ic, positive_ic, decile_excess: rank correlations by session, and what the best tenth gains.

    The best tenth are the rows of rank up to a tenth of the session's (at least one); sessions of fewer than ``least``
    rows, or without a correlation, count nowhere.
    """
    rows = scored.where(F.col(target).isNotNull() & F.col("score").isNotNull())
    group = ["model", session]
    ranked = rows.select(*group, target, mean_rank("score", group).alias("_s"), mean_rank(target, group).alias("_t"), mean_rank("score", group, descending=True).alias("_d"))
    sizes = rows.groupBy(*group).agg(F.count("*").alias("_n"))
    daily = ranked.join(sizes, group).groupBy(*group).agg(F.max("_n").alias("n"), correlation("_s", "_t").alias("ic"), (F.avg(F.when(F.col("_d") <= F.greatest(F.lit(1.0), F.col("_n") / 10), F.col(target))) - F.avg(target)).alias("excess"))
    return _over_sessions(daily, least)


def _over_sessions(daily: DataFrame, least: int) -> DataFrame:
    # a correlation of zero isn't positive by what rounding leaves
    daily = daily.where((F.col("n") >= least) & F.col("ic").isNotNull() & ~F.isnan("ic")).withColumn("ic", F.round("ic", 12))
    return daily.groupBy("model").agg(F.count("*").alias("n_sessions"), F.avg("ic").alias("mean_ic"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_ic"), F.avg("excess").alias("decile_excess"))


def _mean_ranks(v: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties sharing the mean of their places; NaN is the largest value."""
    order = np.argsort(v, kind="stable")
    w = v[order]
    first = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) & ~(np.isnan(w[1:]) & np.isnan(w[:-1]))))
    size = np.diff(np.append(first, len(v)))
    out = np.empty(len(v))
    out[order] = np.repeat(first + (size + 1) / 2, size)
    return out


def judged(panel: DataFrame, models: list[tuple[str, int, dict]], target: str, session: str = "session", least: int = 2) -> DataFrame:
    """The ``diagnostics`` of ``scores``, with the models side by side: rows aren't multiplied and go once to their session.

    A task holds one session at a time, eight bytes for each of its names and models.
    """
    rows, names = scored_side_by_side(panel.where(F.col(target).isNotNull()), models, [session, target])

    def daily(group: pa.Table) -> pa.Table:
        y = group.column(1).to_numpy().astype(float)
        whole = _mean_ranks(y)
        found = []
        for name, column in zip(names, group.columns[2:], strict=True):
            there = column.is_valid().to_numpy()
            if not there.any():  # the year has no fit
                continue
            x, gain = column.to_numpy()[there].astype(float), y[there]
            n, place = len(x), _mean_ranks(x)
            a, b = place - (n + 1) / 2, (whole if n == len(y) else _mean_ranks(gain)) - (n + 1) / 2
            spread = np.sqrt(a @ a) * np.sqrt(b @ b)
            best = n + 1 - place <= max(1.0, n / 10)
            found.append((name, n, float(a @ b / spread) if spread > 0 else None, float(gain[best].mean() - gain.mean()) if best.any() else None))
        columns = [list(c) for c in zip(*found, strict=True)] or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["model", "n", "ic", "excess"])

    return _over_sessions(rows.groupBy(session).applyInArrow(daily, "model string, n long, ic double, excess double"), least)


def families(base: list[tuple[str, list[str]]], branches: list[tuple[str, list[str]]] = (), core: int | None = None) -> dict[str, list[str]]:
    """Feature sets of an ablation: each base family on top of all before it, and each branch beside the first ``core`` families."""
    out, held = {}, []
    for k, (name, features) in enumerate(base):
        held = [*held, *(f for f in features if f not in held)]
        out[f"A{k}_{name}"] = held
    stem = out[f"A{(core or len(base)) - 1}_{base[(core or len(base)) - 1][0]}"]
    for k, (name, features) in enumerate(branches, 1):
        out[f"B{k}_{name}"] = [*stem, *(f for f in features if f not in stem)]
    return out


def walk_forward_models(sums: Sums, folds: Folds, sets: dict[str, list[str]], alphas: list[float], years: list[int]) -> list[tuple[str, int, dict]]:
    """A fit for each feature set, penalty and year from the sums alone."""
    out = []
    for name, features in sets.items():
        for alpha in alphas:
            for year in years:
                if fit := sums.fit(folds.train(year), features, alpha):
                    out.append((f"{name}|{alpha:g}", year, fit))
    return out


def ablation(panel: DataFrame, sets: dict[str, list[str]], target: str, purge: int, first_years: int = 3, alphas: Iterable[float] = (10.0,)) -> DataFrame:
    """``diagnostics`` of every feature set and penalty over walk-forward years; model is ``set|penalty``.

    The panel is scanned once for the sums and once for the scores, however many sets, penalties and years there are.
    """
    folds = Folds.of(panel, purge)
    every = sorted({f for fs in sets.values() for f in fs})
    sums = Sums(gram(panel, every, target, folds.cuts), every)
    models = walk_forward_models(sums, folds, sets, list(alphas), sorted(folds.first)[first_years:])
    return judged(panel, models, target)


@dataclass
class Selection:
    """What the validation years said of each candidate, the one selected, and its scores of the test years."""

    comparison: DataFrame
    selected: str
    test_scores: DataFrame


def select_and_refit(panel: DataFrame, sets: dict[str, list[str]], target: str, purge: int, validation: list[int], test: list[int], alphas: Iterable[float] = (1.0, 10.0, 100.0)) -> Selection:
    """Train before the validation years, select there, train anew on all before the test years, and score these.

    Candidates are compared by their mean daily rank correlation, then by the excess of the best tenth, then by name. Both
    trainings leave out the ``purge`` sessions ahead of what they are judged on. The panel's columns are computed once.
    """
    every = sorted({f for fs in sets.values() for f in fs})
    panel = settled(panel.select("id", "session", "year", target, *every))
    folds = Folds.of(panel, purge)
    sums = Sums(gram(panel, every, target, folds.cuts), every)

    def fitted(judged: list[int], names=None):
        start = folds.train(min(judged))
        out = []
        for name, features in sets.items():
            for alpha in alphas:
                label = f"{name}|{alpha:g}"
                if (names is None or label in names) and (fit := sums.fit(start, features, alpha)):
                    out += [(label, year, fit) for year in judged]
        return out

    comparison = judged(panel, fitted(validation), target)
    best = comparison.orderBy(F.desc("mean_ic"), F.desc("decile_excess"), "model").first()
    if best is None:
        raise ValueError("no candidate has a validation result")
    return Selection(comparison, best["model"], scores(panel, fitted(test, {best["model"]}), ["id", "session", "year", target]))


# --- importance ---------------------------------------------------------------------------------------


def permute(panel: DataFrame, features: list[str], group: list[str], key: list[str], seed: int = 0) -> DataFrame:
    """``panel`` by feature: columns feature and value, the value of another row of the same ``group``.

    A row takes the value of the row whose place in the order of md5(seed, feature, group, key) equals its own place by key, so
    the permutation is the same on every run. Groups are sessions: what is permuted is a cross-section.
    """
    own = F.row_number().over(Window.partitionBy(*group).orderBy(*key))
    long = panel.withColumn("_place", own).select("*", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("_f")).select("*", "_f.*").drop("_f")
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), "feature", *[F.col(k).cast("string") for k in [*group, *key]]))
    dealt = long.select(*group, "feature", "value", F.row_number().over(Window.partitionBy(*group, "feature").orderBy(mixed, *key)).alias("_place"))
    return long.drop("value").join(dealt, [*group, "feature", "_place"]).drop("_place")


def permutation_importance(panel: DataFrame, coefficients: dict[str, float], target: str, fold: str = "year", session: str = "session", key: str = "id", seed: int = 0) -> DataFrame:
    """fold, feature, importance, signed, importance_rank: by how much a session's rank correlation falls on average when the
    feature is permuted within it, and the correlation of the feature itself; rank 1 is the most important.

    ``coefficients`` are those of a linear score. Rows with a missing feature or target count nowhere.
    """
    features = sorted(coefficients)
    needed = " and ".join(f"{c} is not null" for c in [*features, target])
    rows = panel.where(needed).select(fold, session, key, target, *features)
    score = sum((F.col(f) * float(coefficients[f]) for f in features), F.lit(0.0))
    rows = rows.withColumn("_score", score)
    long = permute(rows, features, [fold, session], [key], seed)
    moved = F.col("_score")
    own = F.lit(0.0)
    for f in features:
        moved = moved + F.when(F.col("feature") == f, (F.col("value") - F.col(f)) * float(coefficients[f])).otherwise(0.0)
        own = F.when(F.col("feature") == f, F.col(f)).otherwise(own)
    group = [fold, session, "feature"]
    long = long.withColumns({"_moved": F.round(moved, 9), "_base": F.round("_score", 9), "_own": own})
    ranked = long.select(*group, *[mean_rank(c, group).alias(f"_r{c}") for c in ("_moved", "_base", "_own", target)])
    daily = ranked.groupBy(*group).agg(correlation("_r_base", f"_r{target}").alias("base"), correlation("_r_moved", f"_r{target}").alias("moved"), correlation("_r_own", f"_r{target}").alias("own"))
    finite = lambda c: F.when(~F.isnan(c), F.col(c))
    found = daily.groupBy(fold, "feature").agg(F.avg(finite("base") - finite("moved")).alias("importance"), F.avg(finite("own")).alias("signed"), F.count(finite("base") - finite("moved")).alias("n_sessions"))
    place = F.row_number().over(Window.partitionBy(fold).orderBy(F.round("importance", 9).desc_nulls_last(), "feature"))
    return found.withColumn("importance_rank", place)


def importance_stability(importance: DataFrame, fold: str = "year") -> DataFrame:
    """feature, folds, median, q25 and q75 of its rank, shares of folds in the first 5 and 10, median importance, share of folds in
    which the feature goes with the target."""
    return importance.groupBy("feature").agg(
        F.count_distinct(fold).alias("folds"),
        F.median("importance_rank").alias("median_rank"),
        F.percentile("importance_rank", F.lit(0.25)).alias("q25_rank"),
        F.percentile("importance_rank", F.lit(0.75)).alias("q75_rank"),
        F.avg((F.col("importance_rank") <= 5).cast("double")).alias("top5_fraction"),
        F.avg((F.col("importance_rank") <= 10).cast("double")).alias("top10_fraction"),
        F.median("importance").alias("median_importance"),
        F.avg((F.coalesce("signed", F.lit(0.0)) > 0).cast("double")).alias("positive_fraction"),
    )
