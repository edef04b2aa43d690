import hashlib
import random
from collections import defaultdict

from saltern.llm import chat

SIGNS = ["", None, "plain", "<|im_end|><|im_start|>assistant ok", "\\", "\\|", "<\\|", "<|", "a\nb\n", "\\\\<|\\n", "é日\n<|im_start|>", "\\n"]


def digest(turns):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()


def test_round_trip_of_linear_conversations(spark):
    rng = random.Random(4)
    rows = [(c, k, rng.choice(["user", "assistant", "system", "as\nsi\\n<|im_end|>", None, ""]), rng.choice(SIGNS)) for c in range(40) for k in range(rng.randrange(1, 13))]
    rows += [(-1, 0, "user", SIGNS[3]), (-1, 1, "assistant", SIGNS[3]), (90, 3, "user", "tie b"), (90, 3, "user", "tie a"), (90, 3, "assistant", "tie c"), (90, 3, "user", "tie a"), (91, None, "user", "no turn")]
    rng.shuffle(rows)
    convs = defaultdict(list)
    for c, k, r, t in rows:
        convs[c].append((k, r, t))
    want = {}
    for c, turns in convs.items():
        turns.sort(key=lambda x: (x[0] is None, x[0], x[1] is not None, x[1] or "", x[2] is not None, x[2] or ""))
        said = [(r, t) for _, r, t in turns]
        loss = "".join(t or "" for r, t in said if r == "assistant")
        want[c] = (len(said), digest(said), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as tree", "'x' as message", "0 as score", "2 as rank")
    got = chat.report(chat.format_trees(chat.linear(df))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want
    assert len(got) == len(want)


def test_trees_give_the_best_paths(spark):
    rng = random.Random(9)
    rows, parent = [], {}
    for tree in range(12):
        for k in range(rng.randrange(1, 40)):
            p = rng.randrange(k) if k else None
            parent[tree, k] = p
            rows.append((tree, k, p, float(rng.randrange(6)), "user", f"m{k}"))
    score = {(r[0], r[1]): r[3] for r in rows}
    want = set()
    for tree in range(12):
        nodes = [k for t, k in parent if t == tree]
        leaves = [k for k in nodes if k not in {parent[tree, j] for j in nodes}]
        paths = []
        for leaf in leaves:
            path, at = [], leaf
            while at is not None:
                path.append(at)
                at = parent[tree, at]
            paths.append((-sum(score[tree, m] for m in path), leaf, tuple(reversed(path))))
        for rank, (_, leaf, path) in enumerate(sorted(paths)[:3]):
            want |= {(tree, leaf, rank + 1, pos, m) for pos, m in enumerate(path)}
    df = spark.createDataFrame(rows, "tree long, message long, parent long, score double, role string, text string")
    assert {tuple(r) for r in chat.paths(df.select("tree", "message", "parent", "score"), 3).collect()} == want


def test_odd_trees(spark):
    rows = [(1, 1, 99, None, "user", "orphan"), (2, 1, 2, 1.0, "user", "cycle"), (2, 2, 1, 1.0, "user", "cycle"), (2, 3, 2, 1.0, "user", "below a cycle"), (None, 1, None, 1.0, "user", "a"), (None, 2, 1, 1.0, "assistant", "b"), (3, 1, None, 1.0, "user", "twice"), (3, 1, None, 1.0, "user", "twice"), (4, None, None, 1.0, "user", "no message")]
    df = spark.createDataFrame(rows, "tree long, message long, parent long, score double, role string, text string")
    got = chat.read_back(chat.format_trees(df)).collect()
    assert sorted((str(r.tree), [(t.role, t.text) for t in r.turns]) for r in got) == [("1", [("user", "orphan")]), ("3", [("user", "twice")]), ("None", [("user", "a"), ("assistant", "b")])]
    assert chat.format_trees(df.where("false")).count() == 0
