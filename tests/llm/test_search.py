import math
import random
import re
from collections import Counter

import numpy as np

from saltern.llm import search
from tests.llm.fixtures import ODD, frame, odd_documents

_TERM = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LOW = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [x.translate(_LOW) for x in _TERM.findall(text or "")]


def brute(rows, items, k=10):
    docs = [(d, Counter(w), len(w)) for d, w in ((d, terms(t)) for d, t in rows) if w]
    n, total = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        if item is None:
            continue
        scored = []
        for d, c, size in docs:
            m = 25 + 75 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, 1 << 63 if d is None else d, d))
        out += [str((item, r, d, -s)) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: x[:2])[:k], 1)]
    return sorted(out)


def questions(spark, rows):
    return spark.createDataFrame(rows, "item_id string, text string").selectExpr("*", "1L as item", "'x' as rank", "2 as doc_id")


def cases():
    rng = random.Random(6)
    rows = odd_documents(120) + [(d + 5000, t) for d, t in odd_documents(30) if t] + [(None, "a null id with rare zebra terms"), (77, "zebra"), (77, "zebra")]
    items = [(f"i{k}", " ".join(t.split()[k : k + 25])) for k, (_, t) in enumerate(rows) if t and len(t.split()) > 40][:25]
    items += [(f"odd{k}", t) for k, t in enumerate(ODD)] + [("zebra", "zebra, ZEBRA? zebra the"), (None, "zebra"), ("none", "qqqqqqq"), ("i1", "the zebra")]
    rng.shuffle(rows)
    return rows, items


def test_equal_brute_force(spark, monkeypatch):
    rows, items = cases()
    for shard, cluster, leaf, first, block in ((4 << 20, 64, 64, 4, 1 << 20), (20_000, 3, 4, 1, 2000)):
        for name, value in (("SHARD_BYTES", shard), ("CLUSTER", cluster), ("LEAF", leaf), ("FIRST", first), ("AHEAD", 1)):
            monkeypatch.setattr(search, name, value)
        index = search.build_index(frame(spark, rows))
        got = search.search(index, questions(spark, items), item_bytes=block).select("item_id", "rank", "doc_id", "score").collect()
        assert sorted(str(tuple(r)) for r in got) == brute(rows, items)
        one = search.search(index, questions(spark, items), 1).collect()
        assert len(one) == len({(r.item_id, r.score) for r in one}) and {r["rank"] for r in one} == {1}


def test_not_all_shards_are_visited(spark, monkeypatch):
    """Documents of few kinds: bounds of the other kinds' shards end the visits."""
    rng = random.Random(1)
    kinds = [[f"k{k}w{j}" for j in range(30)] for k in range(8)]
    rows = [(i, " ".join(rng.choice(kinds[i % 8]) for _ in range(40))) for i in range(640)]
    for name, value in (("SHARD_BYTES", 2_000), ("LEAF", 20), ("FIRST", 1)):
        monkeypatch.setattr(search, name, value)
    items = [(f"q{k}", " ".join(kinds[k][:6])) for k in range(8)]
    index = search.build_index(frame(spark, rows))
    assert index.shards.count() > 40
    got = search.search(index, questions(spark, items)).collect()
    assert sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in got) == brute(rows, items)
    # a shard mostly has documents of one kind
    pure = 0
    for r in index.shards.select("ids").collect():
        of = np.bincount(np.frombuffer(r.ids, "<i8") % 8, minlength=8)
        pure += of.max() >= 0.8 * of.sum()
    assert pure > 0.8 * index.shards.count()


def test_bisection_parts_what_shares_no_term():
    term = np.array([x for d in range(40) for x in ([0, 1, 2] if d % 2 else [3, 4, 5])])
    start = np.arange(41) * 3
    docs = np.random.default_rng(1).permutation(40)
    left, _, a, b = search.bisect(start, term, docs, 6)
    assert len(set((docs % 2)[left].tolist())) == 1 and (np.minimum(a, b) == 0).all()
    order = search.reorder(start, term, 6, 5)
    assert sorted(order.tolist()) == list(range(40)) and len(set((order[:20] % 2).tolist())) == 1


def test_empty_tables(spark):
    items = [("a", "some words")]
    for rows in ([], [(1, None), (2, " . ")]):
        assert search.search(search.build_index(frame(spark, rows)), questions(spark, items)).collect() == []
    assert search.search(search.build_index(frame(spark, [(1, "some words")])), questions(spark, [])).collect() == []
