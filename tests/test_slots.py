"""Features of portfolio actions against plain Python, and the bracket join's rows."""

import datetime as dt
import random

from saltern.operators.slots import action_features
from saltern.operators.temporal import bracket_join


def brute(held, target, day, slots):
    out = {}
    for s in {k for k, _, _ in held} | {k for k, _, _ in target}:
        a, b = ({i: w for k, i, w in side if k == s} for side in (held, target))
        row = {}
        for name, p in (("state", a), ("target", b)):
            cash = max(0.0, 1 - sum(p.values()))
            row |= {f"{name}_holdings_count": len(p), f"{name}_cash_fraction": cash, f"{name}_exposure": min(1.0, max(0.0, sum(p.values())))}
            for at, c in enumerate(("score_pct", "rank")):
                known = [(w, day[s, i][at]) for i, w in p.items() if (s, i) in day and day[s, i][at] is not None]
                total = sum(w for w, _ in known)
                row[f"{name}_weighted_{c}"] = sum(w * v for w, v in known) / total if total > 0 else None
        for c, d in (("score_pct", "delta_score_pct"), ("rank", "delta_rank")):
            x, y = row[f"target_weighted_{c}"], row[f"state_weighted_{c}"]
            row[d] = None if x is None or y is None else x - y
        row["turnover_fraction"] = 0.5 * sum(abs(b.get(i, 0) - a.get(i, 0)) for i in set(a) | set(b)) + 0.5 * abs(row["target_cash_fraction"] - row["state_cash_fraction"])
        for label, p in (("source", a), ("target", b)):
            order = sorted(p.items(), key=lambda x: (-x[1], x[0]))
            for k in range(slots):
                i, w = order[k] if k < len(order) else (None, 0.0)
                row[f"{label}{k}_weight"] = w
                for at, c in enumerate(("score_pct", "rank", "f")):
                    row[f"{label}{k}_{c}"] = day.get((s, i), (None,) * 3)[at]
        out[s] = row
    return out


def test_action_features_equal_plain_python(spark):
    rng = random.Random(1)
    pick = lambda: [(s, i, rng.choice([0.1, 0.2, 0.3])) for s in range(12) for i in rng.sample(range(9), rng.randrange(5)) if s != 7]
    held, target = pick(), [*pick(), (20, 1, 0.4)]
    day = {(s, i): (rng.choice([None, rng.random()]), rng.choice([None, float(i)]), rng.random()) for s in range(12) for i in range(7)}
    w = "session long, id long, weight double"
    frame = spark.createDataFrame([(s, i, *v) for (s, i), v in day.items()], "session long, id long, score_pct double, rank double, f double")
    got = action_features(spark.createDataFrame([*held, (None, 1, 0.5), (3, None, 0.5)], w), spark.createDataFrame(target, w), frame, ["session"], 3, ("f",)).collect()
    want = brute(held, target, day, 3)
    assert {r.session for r in got} == set(want)
    for r in got:
        for c, v in want[r.session].items():
            assert (r[c] is None) == (v is None) and (v is None or abs(r[c] - v) < 1e-9), (r.session, c)
    empty = spark.createDataFrame([], w)
    assert action_features(empty, empty, frame, ["session"]).collect() == []


def test_brackets_of_odd_rows(spark):
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(k)
    rows = spark.createDataFrame([("a", day(0), 1), ("a", day(0), 1), ("a", day(4), 1), ("a", day(20), 2), ("a", day(20), 3), ("a", None, 9), (None, day(0), 9), ("b", day(0), 5), ("b", day(2), 6)], "s string, date date, id int")
    events = spark.createDataFrame([(1, "a", day(0)), (2, "a", day(2)), (3, "a", day(20)), (4, "a", day(17)), (5, "b", day(1)), (6, "c", day(0)), (7, "a", None), (8, None, day(0)), (1, "a", day(2)), (9, "a", day(12))], "event int, s string, date date")
    got = sorted(((r.event, r.status, r.id) for r in bracket_join(events, rows, "s").collect()), key=str)
    want = [(1, "mapped", 1), (1, "mapped_bracket", 1), (2, "mapped_bracket", 1), (3, "ambiguous_exact", None), (4, "ambiguous_right", None), (5, "conflicting_bracket", None)]
    assert got == sorted([*want, *((k, "unmapped", None) for k in (6, 7, 8, 9))], key=str)
