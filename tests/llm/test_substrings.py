import hashlib
import random
from collections import defaultdict

import numpy as np

from saltern.llm import prefix_free, recompression
from tests.llm.fixtures import documents, frame, odd_documents

LAST = 1 << 62


def brute_words(rows, window):
    order = sorted(rows, key=lambda r: LAST if r[0] is None else r[0])
    seen = {}
    words = [(t or "").encode().split() for _, t in order]
    gone = [set() for _ in order]
    for r, (d, _) in enumerate(order):
        for s in range(len(words[r]) - window + 1):
            key = tuple(words[r][s : s + window])
            # the same row's earlier start, or a row of a smaller id
            small, starts = seen.setdefault(key, (d, defaultdict(list)))
            if small != d or starts[r]:
                gone[r].update(range(s, s + window))
            starts[r].append(s)
    return sorted((str(d), len(w), len(g), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in g)).hexdigest()) for (d, _), w, g in zip(order, words, gone))


def brute_bytes(rows, length):
    seen = {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    rank = lambda d: LAST if d is None else d
    for d, t in raw:
        for s in range(len(t) - length + 1):
            k = t[s : s + length]
            seen[k] = min(seen.get(k, LAST + 1), rank(d))
    out = []
    for d, t in raw:
        gone = [False] * len(t)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] < rank(d):
                gone[s : s + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((str(d), len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out)


def hard_rows():
    rng = random.Random(11)
    rows = odd_documents(50)
    base = documents(50)
    at = 3000
    for _ in range(25):  # passages shared at any offset
        t, u = rng.choice(base)[1], rng.choice(base)[1]
        a = rng.randrange(max(1, len(u) - 400))
        b = rng.randrange(len(t) + 1)
        rows.append((at, t[:b] + u[a : a + rng.randrange(30, 500)] + t[b:]))
        at += 1
    for k in range(14):  # runs and periods, cut at any place
        rows.append((at, " ".join(["aa"] * rng.randrange(1, 60) + ["bb"] * rng.randrange(1, 40) + ["cc", "dd"] * rng.randrange(1, 30) + ["aa"] * rng.randrange(30))))
        rows.append((at + 1, "x" * rng.randrange(40, 200) + "yz" * rng.randrange(20, 90) + str(k)))
        at += 2
    words = ["u", "v"]
    for _ in range(20):  # a tiny vocabulary: windows repeat by chance
        rows.append((at, " ".join(rng.choice(words) for _ in range(rng.randrange(10, 200)))))
        at += 1
    rows += [(7000, "same text again " * 30)] * 3 + [(None, base[3][1]), (None, "null id " * 40)]
    rng.shuffle(rows)
    return rows


def test_words_equal_brute_force(spark):
    rows = hard_rows()
    for window, block in ((20, None), (20, 3000), (5, 3000)):
        got = recompression.report(recompression.remove_repeats(frame(spark, rows), window, block)).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words(rows, window)


def test_bytes_equal_brute_force(spark):
    rows = hard_rows()
    for block in (None, 3000):
        got = prefix_free.report(prefix_free.remove_repeats(frame(spark, rows), block_bytes=block)).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(rows, 50)


def test_empty_tables(spark):
    for f in (recompression.remove_repeats, prefix_free.remove_repeats):
        assert f(frame(spark, [])).count() == 0
        assert [tuple(r)[0] for r in f(frame(spark, [(1, None), (2, "")])).orderBy("doc_id").collect()] == [1, 2]


def test_a_window_beside_runs_is_found(spark):
    says = lambda t: " ".join(w for x in t.split() for w in [x.split("*")[0]] * int((x.split("*") + ["1"])[1]))
    one = says("a d a*23 d a b e d a b c a a e b a b a b c d*18 c e a g")
    two = says("b c e a f h b h c a a b a a b b d b a d e a a a d a b e d a b c a a e b a b a b c a b a a b b d b a d e a h a f*15 a d")
    got = recompression.report(recompression.remove_repeats(frame(spark, [(0, one), (1, two)]))).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words([(0, one), (1, two)], 20)
    assert max((r.doc_id, r.n_removed) for r in got) == (1, 20)


def test_equal_windows_get_equal_names_next_to_runs():
    rng = random.Random(7)
    wrong = seen_windows = 0
    for _ in range(450):
        window, size = rng.choice([5, 8, 12, 20]), rng.randrange(2, 8)
        phrases = [[rng.randrange(size)] * rng.randrange(2, 24 if rng.random() < 0.3 else 7) for _ in range(3)] + [[rng.randrange(size) for _ in range(rng.randrange(1, 6))] for _ in range(4)]
        if rng.random() < 0.3:
            phrases += [p * rng.randrange(2, 6) for p in phrases[3:]]
        docs = [[x for _ in range(rng.randrange(6, 40)) for x in rng.choice(phrases)] for _ in range(24)]
        words = recompression.mix(np.array([x for d in docs for x in d], np.uint64) + np.uint64(rng.getrandbits(60)))
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        valid = np.arange(len(words)) + window <= np.cumsum([len(d) for d in docs])[doc]
        name, _ = recompression.window_symbols(words, doc, valid, window)
        first = {}
        for k in np.flatnonzero(valid):
            seen_windows += 1
            wrong += first.setdefault(words[k : k + window].tobytes(), name[k]) != name[k]
    assert seen_windows > 1_000_000 and wrong == 0
