"""Models from additive sums, rankers, gates, importance and resampling against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from saltern.operators import gates, linear, models, rankers, resampling
from saltern.operators.aggregates import pooled_rank_correlations

FEATURES = ["f1", "f2", "f3"]


def panel(spark, gaps=False, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for session in range(200):
        for name in range(8):
            x = rng.normal(size=3) * [1, 5, 0.1] + [0, 100, 3]
            y = 0.4 * x[0] - 0.02 * x[1] + rng.normal() * 0.3
            x = [None if gaps and rng.random() < 0.2 else float(v) for v in x]
            rows.append((name, session, 2000 + session // 40, *x, None if rng.random() < 0.05 else float(y)))
    return spark.createDataFrame(rows, "id long, session long, year int, f1 double, f2 double, f3 double, y double")


def brute_ridge(train, features, alpha):
    x = train[features].to_numpy(float)
    fill = np.nanmean(x, axis=0)
    x = np.where(np.isnan(x), fill, x)
    y = train["y"].to_numpy()
    mean, dev = x.mean(0), x.std(0, ddof=1)
    z = (x - mean) / dev
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(len(features)), z.T @ (y - y.mean())) / dev
    return y.mean() - mean @ beta, beta, fill


def test_sums_give_the_scores_of_a_walk_forward(spark):
    p = panel(spark)
    folds = linear.Folds.of(p, 7)
    sums = linear.Sums(linear.gram(p, FEATURES, "y", folds.cuts), FEATURES)
    fitted = linear.walk_forward_models(sums, folds, {"all": FEATURES}, [10.0], [2003, 2004])
    got = {(r.id, r.session): r.score for r in linear.scores(p, fitted, ["id", "session"]).collect()}
    want = models.walk_forward(p, FEATURES, "y", 7).collect()
    # Spark's solver scales its penalty by another deviation: by n instead of n - 1
    assert len(got) == len(want) == 640 and all(abs(got[r.id, r.session] - r.score) < 1e-4 for r in want)


def test_missing_values_are_filled_by_the_training_mean(spark):
    p = panel(spark, gaps=True)
    folds = linear.Folds.of(p, 7)
    sums = linear.Sums(linear.gram(p, FEATURES, "y", folds.cuts), FEATURES)
    t = p.toPandas()
    for features in (FEATURES, ["f2"], ["f3", "f1"]):
        for year, alpha in ((2001, 1.0), (2004, 50.0)):
            fit = sums.fit(folds.train(year), features, alpha)
            train = t[(t.session < (year - 2000) * 40 - 7) & t.y.notna()]
            intercept, beta, fill = brute_ridge(train, features, alpha)
            assert fit["n"] == len(train) and abs(fit["intercept"] - intercept) < 1e-8
            assert np.allclose(list(fit["coefficients"].values()), beta) and np.allclose(list(fit["fill"].values()), fill)
    assert sums.fit([], FEATURES, 1.0) is None


def test_sums_take_one_scan_and_skip_bad_values(spark, tmp_path):
    p = panel(spark, gaps=True)
    p.write.parquet(str(tmp_path / "p"))
    q = spark.read.parquet(str(tmp_path / "p"))
    plan = linear.gram(q, FEATURES, "y", [33, 40])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "id" not in plan.split("ReadSchema")[1].split(">")[0]
    odd = spark.createDataFrame([(0, float("inf"), 1.0), (0, float("nan"), 2.0), (1, 3.0, None), (1, 5.0, 1.0)], "session long, f1 double, y double")
    got = {(r.segment, r.a, r.b): r.value for r in linear.gram(odd, ["f1"], "y", [1]).collect()}
    assert got[0, 0, 0] == 2 and got[0, 0, 2] == 0 and got[0, 0, 3] == 2 and got[1, 0, 2] == 5
    assert linear.gram(odd.where("false"), ["f1"], "y", [1]).count() == 0


def test_ablation_and_selection(spark):
    p = panel(spark, gaps=True)
    sets = linear.families([("noise", ["f3"]), ("signal", ["f1"])], [("more", ["f2"])], 1)
    assert sets == {"A0_noise": ["f3"], "A1_signal": ["f3", "f1"], "B1_more": ["f3", "f2"]}
    got = {r.model: r for r in linear.ablation(p, sets, "y", 7, 2, (1.0,)).collect()}
    assert got["A1_signal|1"].mean_ic > got["A0_noise|1"].mean_ic + 0.2 and got["A1_signal|1"].n_sessions == 120
    found = linear.select_and_refit(p, sets, "y", 7, [2002], [2003, 2004], (1.0, 1e6))
    assert found.selected.startswith("A1_signal")
    t = p.toPandas()
    intercept, beta, fill = brute_ridge(t[(t.session < 113) & t.y.notna()], ["f3", "f1"], float(found.selected.split("|")[1]))
    rows = found.test_scores.toPandas().merge(t, on=["id", "session"])
    x = rows[["f3", "f1"]].to_numpy(float)
    assert len(rows) == 640 and np.allclose(rows.score, intercept + np.where(np.isnan(x), fill, x) @ beta)
    with pytest.raises(ValueError):
        linear.select_and_refit(p, sets, "y", 7, [2000], [2001])


def test_diagnostics_equal_brute_force(spark):
    p = panel(spark).withColumn("model", F.lit("m")).withColumn("score", F.round("f1", 1))
    got = linear.diagnostics(p, "y").first()
    t = p.toPandas().dropna(subset=["y"])
    ics = [g.score.rank().corr(g.y.rank()) for _, g in t.groupby("session")]
    excess = [g.y[g.score.rank(ascending=False) <= max(1, len(g) / 10)].mean() - g.y.mean() for _, g in t.groupby("session")]
    assert abs(got.mean_ic - np.mean(ics)) < 1e-9 and got.n_sessions == 200 and abs(got.positive_ic - np.mean(np.array(ics) > 0)) < 1e-9
    assert abs(got.decile_excess - np.nanmean(excess)) < 1e-9


def test_models_are_judged_side_by_side(spark):
    p = panel(spark, gaps=True)
    fit = lambda *b: {"intercept": 0.1, "coefficients": dict(zip(FEATURES, b)), "fill": dict.fromkeys(FEATURES, 0.5)}  # noqa: E731, B905
    # a model of ties alone, and one that has no fit in a year
    models = [(m, y, fit(*b)) for m, b in (("a", (1.0, 0.0, -2.0)), ("b", (0.0, 0.5, 1.0)), ("flat", (0.0, 0.0, 0.0))) for y in (2001, 2002) if (m, y) != ("b", 2002)]
    want = linear.diagnostics(linear.scores(p, models, ["id", "session", "year", "y"]), "y")
    found = linear.judged(p, models, "y")
    w, g = ({r.model: r for r in x.collect()} for x in (want, found))
    assert sorted(w) == sorted(g) == ["a", "b"] and g["a"].n_sessions == 2 * g["b"].n_sessions
    assert all(np.allclose(w[m][1:], g[m][1:]) for m in w)
    # rows aren't multiplied by model, nor ordered by each score
    plan = linear.ablation(p, {"A": ["f1"], "B": ["f2"]}, "y", 7, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Window" not in plan and "Generate" not in plan
    assert linear._mean_ranks(np.array([2.0, np.nan, 0.0, 2.0, -0.0, np.nan])).tolist() == [3.5, 5.5, 1.5, 3.5, 1.5, 5.5]


def test_a_permutation_keeps_each_groups_values(spark):
    p = panel(spark).where("y is not null")
    got = linear.permute(p, ["f1", "f2"], ["year", "session"], ["id"]).collect()
    before, after = Counter(), Counter()
    for r in p.collect():
        for f in ("f1", "f2"):
            before[r.session, f, r[f]] += 1
    for r in got:
        after[r.session, r.feature, r.value] += 1
    assert before == after and sum(r.value != r[r.feature] for r in got) > 0.7 * len(got)


def test_importance_finds_what_matters(spark):
    p = panel(spark)
    found = linear.permutation_importance(p, {"f1": 0.4, "f2": -0.02, "f3": 0.0}, "y")
    for r in found.collect():
        assert (r.importance_rank == 1) == (r.feature == "f1") and (r.feature != "f3" or abs(r.importance) < 1e-12)
    s = {r.feature: r for r in linear.importance_stability(found).collect()}
    assert s["f1"].median_rank == 1 and s["f1"].folds == 5 and s["f1"].positive_fraction == 1 and s["f2"].positive_fraction == 0 and s["f2"].top5_fraction == 1


# --- rankers ------------------------------------------------------------------------------------------


def brute_pairs(x, q, beta, weighting):
    score = x @ beta
    n = len(q)
    loss, weight, grad = 0.0, 0.0, np.zeros(len(beta))
    order = np.argsort(-score, kind="stable").tolist()
    ranks = {k: i + 1 for i, k in enumerate(np.argsort(-q, kind="stable").tolist())}
    ideal = sum((2.0**g - 1) / math.log2(i + 2) for i, g in enumerate(sorted(q, reverse=True)))
    for i in range(n):
        for j in range(n):
            if q[i] <= q[j]:
                continue
            w = 0.2 + 0.8 * min(1, (q[i] - q[j]) / (q.max() - q.min()))
            if weighting == "top":
                a, b = sorted((ranks[i], ranks[j]))
                w *= 5 if a == 1 else 4 if a <= 5 < b else 2.5 if a <= 5 else 2 if a <= 10 < b else 1.2 if a <= 10 else 0.35
            if weighting == "ndcg":
                w = abs(2.0 ** q[i] - 2.0 ** q[j]) * abs(1 / math.log2(order.index(i) + 2) - 1 / math.log2(order.index(j) + 2)) / ideal
            d = score[i] - score[j]
            loss += w * math.log1p(math.exp(-d))
            weight += w
            grad -= w / (1 + math.exp(d)) * (x[i] - x[j])
    return loss, weight, grad


def test_gradients_equal_those_of_all_pairs(spark):
    rng = np.random.default_rng(0)
    rows = [(g, *map(float, rng.normal(size=3)), float(rng.integers(0, 5)), int(k)) for g in range(6) for k in range(14)]
    df = spark.createDataFrame(rows, "g long, f1 double, f2 double, f3 double, q double, k int")
    t = df.toPandas()
    beta = np.array([0.3, -0.2, 0.1])
    for weighting in ("gap", "ndcg"):
        loss, weight, grad, curve = rankers.sums(rankers.grouped(df, FEATURES, "q", "g"), beta, weighting)
        parts = [brute_pairs(x[FEATURES].to_numpy(), x.q.to_numpy(), beta, weighting) for _, x in t.groupby("g")]
        assert abs(loss - sum(p[0] for p in parts)) < 1e-9 and abs(weight - sum(p[1] for p in parts)) < 1e-9
        assert np.allclose(grad, sum(p[2] for p in parts)) and (np.linalg.eigvalsh(curve) > 0).all()
    x, q = t[t.g == 0][FEATURES].to_numpy(), np.arange(14.0)[::-1]
    loss, weight, grad, curve = rankers.group_sums(x, q, beta, "top")
    want = brute_pairs(x, q, beta, "top")
    assert abs(loss - want[0]) < 1e-9 and np.allclose(grad, want[2])
    step = 1e-6
    for k in range(3):  # curvature is the gradient's own slope
        up = rankers.group_sums(x, q, beta + step * np.eye(3)[k], "top")[2]
        assert np.allclose((up - grad) / step, curve[k], atol=1e-3)


def ndcg(t, score, k=3):
    out = []
    for _, g in t.groupby("g"):
        gain = 2.0 ** g.grade.to_numpy() - 1
        order = np.argsort(-g[score].to_numpy(), kind="stable")
        best = np.sort(gain)[::-1]
        w = 1 / np.log2(np.arange(k) + 2)
        out.append((gain[order][:k] * w).sum() / max(1e-12, (best[:k] * w).sum()))
    return float(np.mean(out))


def test_rankers_beat_a_pointwise_regression(spark):
    """Levels differ by group and grow with a feature that orders nothing: regression follows them, pairs don't see them."""
    rng = np.random.default_rng(4)
    rows = []
    for g in range(120):
        level = rng.normal() * 30
        for k in range(12):
            a, noise = rng.normal(), rng.normal()
            value = a + 0.3 * rng.normal()
            rows.append((g, k, float(a), float(level + noise * 8), float(value + level)))
    t = pd.DataFrame(rows, columns=["g", "k", "f1", "f2", "y"])
    t["grade"] = t.groupby("g").y.rank().sub(1).floordiv(3).astype(int)
    df = spark.createDataFrame(t)
    pairwise = rankers.fit_ranker(df, ["f1", "f2"], "y", "g", "gap")
    top = rankers.fit_ranker(df, ["f1", "f2"], "y", "g", "top")
    listwise = rankers.fit_ranker(df, ["f1", "f2"], "grade", "g", "ndcg", rounds=6)
    x = t[["f1", "f2"]].to_numpy()
    t["ridge"] = x @ np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + np.eye(2), (x - x.mean(0)).T @ (t.y - t.y.mean()))
    for name, m in (("pairwise", pairwise), ("top", top), ("listwise", listwise)):
        t[name] = x @ [m["f1"], m["f2"]]
        assert ndcg(t, name) > ndcg(t, "ridge") + 0.1, name
    assert rankers.fit_ranker(df.where("false"), ["f1", "f2"], "y", "g") == {"f1": 0.0, "f2": 0.0}
    assert rankers.fit_ranker(df.withColumn("y", F.lit(1.0)), ["f1"], "y", "g") == {"f1": 0.0}
    with pytest.raises(Exception, match="unknown weighting"):
        rankers.fit_ranker(df, ["f1"], "y", "g", "other")


# --- gates --------------------------------------------------------------------------------------------


def test_the_gate_is_a_balanced_logistic_regression(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2)) * [1, 20] + [0, 50]
    y = (x[:, 0] + rng.normal(size=300) > 0.9).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "label": y}))
    fitted = gates.fit_gate(df, ["a", "b"], "label", c=1.0)
    model = fitted.stages[-1]
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    w = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
    wide, beta = np.column_stack([np.ones(300), z]), np.zeros(3)
    ridge = np.diag([0.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-wide @ beta))
        beta -= np.linalg.solve((wide * (w * p * (1 - p))[:, None]).T @ wide + ridge, wide.T @ (w * (p - y)) + ridge @ beta)
    assert np.allclose([model.intercept, *model.coefficients], beta, atol=1e-4)
    own = [r.p for r in df.select(gates.probability(fitted, ["a", "b"]).alias("p")).collect()]
    assert np.allclose(own, 1 / (1 + np.exp(-wide @ beta)), atol=1e-4)
    gap = spark.createDataFrame([(None, 50.0), (float("nan"), 50.0)], "a double, b double").select(gates.probability(fitted, ["a", "b"]).alias("p")).collect()
    assert gap[0].p == gap[1].p and 0 < gap[0].p < 1
    for bad in (df.limit(20), df.where("label = 1")):
        with pytest.raises(ValueError):
            gates.fit_gate(bad, ["a", "b"], "label")


def test_a_gate_closes_sessions(spark):
    daily = spark.createDataFrame([(s, 2000 + s // 60, float(s % 7 - 3 + (s % 3) / 2), float(s % 7 > 3)) for s in range(240)], "session long, year int, a double, label double")
    gate = gates.gate_by_year(daily, ["a"], "label", 1, 2, least=50)
    assert sorted({r.year for r in gate.collect()}) == [2002, 2003]
    p = spark.createDataFrame([(s, n) for s in range(240) for n in range(2)], "session long, id int")
    kept = {r.session for r in gates.gated(p, gate).collect()}
    assert kept and all(s >= 120 for s in kept) and all(s % 7 >= 3 for s in kept) and {s for s in range(120, 240) if s % 7 > 4} <= kept
    assert gates.gate_by_year(daily, ["a"], "label", 1, 2, least=10**6).collect() == []


def test_a_gate_computes_its_sessions_once(spark):
    seen = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda x: seen.add(1) or x, "double").asNondeterministic()
    daily = spark.createDataFrame([(s, 2000 + s // 60, float(s % 7), float(s % 7 > 3)) for s in range(240)], "session long, year int, a double, label double")
    assert gates.gate_by_year(daily.withColumn("a", counted("a")), ["a"], "label", 1, 2, least=50).count() == 120
    assert seen.value <= 2 * 240  # many passes of two fits would see them again and again


def counted(spark, df, column):
    """``df``, and how many rows of it were computed so far."""
    seen = spark.sparkContext.accumulator(0)
    f = F.udf(lambda x: seen.add(1) or x, "double").asNondeterministic()
    return df.withColumn(column, f(column)), seen


def test_a_selection_computes_its_panel_once(spark):
    rng = random.Random(3)
    rows = [(i, s, 2000 + s // 20, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for s in range(100) for i in range(6)]
    p, seen = counted(spark, spark.createDataFrame(rows, "id long, session long, year int, a double, b double, y double"), "a")
    found = linear.select_and_refit(p, {"a": ["a"], "ab": ["a", "b"]}, "y", 2, [2002, 2003], [2004])
    assert found.test_scores.count() == 120 and seen.value <= 2 * len(rows)


def test_pooled_correlations_compute_their_columns_once(spark):
    rng = random.Random(3)
    p, seen = counted(spark, spark.createDataFrame([(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(300)], "a double, b double"), "a")
    assert pooled_rank_correlations(p, ["a", "b"]).count() == 1 and seen.value <= 600


# --- resampling ---------------------------------------------------------------------------------------


def returns_of(spark, n, edge):
    rng = random.Random(9)
    rows = []
    for s in range(n):
        base = rng.gauss(0, 0.01)
        rows += [(s, "market", base), (s, "good", base + edge + rng.gauss(0, 0.002)), (s, "plain", base + rng.gauss(0, 0.002))]
    rows += [(n, "market", 0.01), (n + 1, "good", None)]  # no other series here
    return spark.createDataFrame(rows, "session long, series string, r double")


def test_blocks_are_shared_and_whole(spark):
    places = resampling.aligned(returns_of(spark, 53, 0.0), "session", "series", "r")
    assert places.count() == 53
    rows = resampling.resampled(places, 53, 5, 10, 1, "own").collect()
    held = {r.place: r["values"] for r in places.collect()}
    where = {v["market"]: k for k, v in held.items()}
    by = {}
    for r in rows:
        by.setdefault((r.rep, r.at), {})[r.series] = r.r
    assert len(by) == 5 * 53 and all(held[where[v["market"]]] == v for v in by.values())
    for rep in range(5):
        at = [where[by[rep, k]["market"]] for k in range(53)]
        assert all(at[k + 1] == at[k] + 1 for k in range(52) if (k + 1) % 10)


def test_only_a_real_edge_is_significant(spark):
    for edge, low, high in ((0.003, 0, 0.02), (0.0, 0.02, 1.01)):
        r = resampling.familywise_test(returns_of(spark, 160, edge), "session", "series", "r", "market", 99, 10).first()
        assert low < r.p_value < high and r.reps == 99
    b = {(r.series, r.metric): r for r in resampling.joint_bootstrap(returns_of(spark, 160, 0.003), "session", "series", "r", "market", 60, 10).collect()}
    assert b["good", "excess_cagr"].p2_5 > 0 > b["plain", "max_drawdown"].p97_5 and len(b) == 8
    empty = returns_of(spark, 0, 0).where("false")
    assert resampling.joint_bootstrap(empty, "session", "series", "r", "market", 5).count() == 0


# --- pooled rank correlations -------------------------------------------------------------------------


@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_pooled_correlations_equal_pandas(spark, ranges):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6))
    x[:, 1] += x[:, 0]
    x[:, 2] = np.round(x[:, 2])  # ties
    x[:, 5] = 3.0  # constant
    t = pd.DataFrame(x, columns=[f"c{k}x" for k in range(6)])
    for k in range(5):
        t.loc[rng.random(400) < 0.15 * k, f"c{k}x"] = np.nan
    df = spark.createDataFrame(t.astype(object).where(t.notna(), None).astype(object), ", ".join(f"{c} double" for c in t.columns))
    want = pd.DataFrame({a: {b: (lambda h: h[a].rank().corr(h[b].rank()) if len(h) >= 150 else np.nan)(t[[a, b]].dropna() if a != b else t[[a]].dropna()) for b in t} for a in t}).T
    got = pooled_rank_correlations(df, list(t.columns), 150, ranges=ranges).collect()
    assert len(got) == 15
    for r in got:
        w = want.loc[r["first"], r.second]
        assert r.n == (t[r["first"]].notna() & t[r.second].notna()).sum()
        assert r.rank_correlation is None if np.isnan(w) else abs(r.rank_correlation - w) < 1e-9
    few = pooled_rank_correlations(df, list(t.columns), 150, 0.3, ranges).collect()
    assert {(r["first"], r.second) for r in few} == {("c0x", "c1x")}
