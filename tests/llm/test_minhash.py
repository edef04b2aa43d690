import random

import numpy as np

from saltern.llm import minhash
from saltern.llm.common import small_batches
from tests.llm.fixtures import frame, odd_documents


def shingles(text, width=2):
    w = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width=2, percent=80):
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None:
                same = len(a & b)
                if 100 * same >= percent * (len(a) + len(b) - same):
                    up[top(i)] = top(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[top(k)] = min(least.get(top(k), d), d)
    return sorted(str((d, len(sets[k]), None if d is None else least[top(k)], d is None or d == least[top(k)])) for k, (d, _) in enumerate(rows))


def families(rng, n=12, size=9):
    """Texts around templates, from nearly equal to just below the limit, and chains of small changes."""
    rows, at = [], 10_000
    for _ in range(n):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40)) for _ in range(rng.choice([6, 12, 30, 60, 200]))]
        now = list(base)
        for k in range(size):
            now = list(base) if k % 3 else now  # every third goes on from the one before
            for _ in range(rng.randrange(1 + len(base) // 9)):
                now[rng.randrange(len(now))] = f"x{rng.randrange(9)}"
            rows.append((at, " ".join(now)))
            at += 1
    return rows


def test_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    rows = odd_documents(80) + families(rng)
    rng.shuffle(rows)
    rows += [(5, "Same Id other text"), (5, "same id OTHER text"), (None, "same id other text"), (None, None), (7001, "b a"), (7002, "A"), (7003, "a\t")]
    for star, tile, part in ((256, 1024, 1 << 18), (2, 4, 150)):
        monkeypatch.setattr(minhash, "STAR", star)
        monkeypatch.setattr(minhash, "PART", part)
        monkeypatch.setattr(minhash.residual, "__defaults__", (tile,))
        got = minhash.with_kept(minhash.near_duplicates(frame(spark, rows))).collect()
        assert sorted(str(tuple(r)) for r in got) == brute(rows)


def test_other_widths_and_limits(spark):
    rows = odd_documents(40) + families(random.Random(8), 6)
    got = minhash.with_kept(minhash.near_duplicates(frame(spark, rows), 5, 60)).collect()
    # at 60 percent the bands may miss a link, but what they give is right and sizes are exact
    want = {eval(x)[0]: eval(x) for x in brute(rows, 5, 60)}
    assert all(r.n_shingles == want[r.doc_id][1] and r.component_id >= want[r.doc_id][2] for r in got) and len(got) == len(rows)


def test_a_chain_around_a_centre_is_whole(spark, monkeypatch):
    """Members that are linked with one another, but not with their bucket's least."""
    rng = random.Random(2)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(60):
        w = list(base)
        for j in range(0, 12, 2):
            w[(7 * k + 5 * j) % 60] = f"n{k}-{j}"
        if k % 4 == 3:
            w = rows[-1][1].split()
            w[rng.randrange(60)] = "last"
        rows.append((k + 1, " ".join(w)))
    for part in (1 << 18, 200):
        monkeypatch.setattr(minhash, "PART", part)
        got = minhash.with_kept(minhash.near_duplicates(frame(spark, rows))).collect()
        assert sorted(str(tuple(r)) for r in got) == brute(rows)


def test_bins_agree_as_often_as_sets():
    rng = random.Random(3)
    for size, other in ((4, 1), (8, 2), (40, 10), (400, 100)):  # similarity 0.8
        share = []
        for k in range(150):
            both = [f"{k}s{j}" for j in range(size)]
            texts = [" ".join(both), " ".join([*both, *(f"{k}o{j}" for j in range(other))])]
            doc, value = minhash.shingle_hashes([t.encode() for t in texts], 1)
            bins = minhash.signatures(doc, value, 2)
            share.append((bins[0] == bins[1]).mean())
        assert abs(np.mean(share) - 0.8) < 0.04, size
    assert rng


def test_empty_table_and_settings(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    for own in ("64m", "1g", "4096", "67108864b"):
        spark.conf.set(key, own)
        with small_batches(spark):
            pass
        assert spark.conf.get(key) == own
    spark.conf.set(key, before)
