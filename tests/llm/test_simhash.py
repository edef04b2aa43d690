import random

import numpy as np
import xxhash

from saltern.llm import simhash
from tests.llm.fixtures import frame, odd_documents


def brute_fp(text, width=4):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    w = low.split()
    if not w:
        return 0
    grams = [b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))]
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def brute(rows, bits=4):
    fps = {d: brute_fp(t) for d, t in rows}
    up = {d: d for d in fps}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return sorted((d, f"{fps[d]:016x}", top(d)) for d in ids)


def test_components_equal_brute_force(spark):
    rows = odd_documents(100)
    got = simhash.with_hex(simhash.near_duplicates(frame(spark, rows))).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_links_of_dense_and_hot_buckets(spark):
    rng = random.Random(1)
    center = rng.getrandbits(64)
    fps = set()
    for _ in range(400):
        x = center
        for _ in range(rng.randrange(8)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    rows = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    df = spark.createDataFrame(rows, "fp long")
    from saltern.llm.components import components

    want = components(spark.createDataFrame([(a, b) for (a,) in rows for (b,) in rows if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4], "a long, b long"))
    for tile in (simhash.TILE, 16):
        got = components(simhash.links(df, tile=tile))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_one_of_each_keeps_the_smallest(spark):
    rows = odd_documents(60)
    kept = simhash.one_of_each(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(d for d, _, c in brute(rows) if d == c)


def test_empty_and_repeated_rows(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    got = simhash.near_duplicates(frame(spark, [(4, "a b"), (4, "a b"), (2, "a b"), (None, "zz")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(2, 2), (4, 2), (4, 2)]


def test_pivots_never_discard_a_close_pair():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 64, 200, np.uint64)
    y = np.concatenate([x, x ^ np.uint64(5), x ^ np.uint64(0x8000000000000007)])
    near = simhash.close(y, 4)
    assert (near == (np.bitwise_count(y[:, None] ^ y[None, :]) <= 4)).all()


def test_one_of_each_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c d e", "x", 5), (2, "a b c d e", "y", 6), (None, "a b c d e", None, None)], "doc_id long, text string, _out string, row long")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns and sorted((r.doc_id or 0, r._out or "") for r in got.collect()) == [(0, ""), (1, "x")]
