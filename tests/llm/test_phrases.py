import random
import re
from collections import Counter

import pyarrow as pa

from saltern.llm import phrases
from tests.llm.fixtures import ODD, documents

_LOW = {c: c + 32 for c in range(65, 91)}


def brute(rows, longest=3, least=10, share=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(_LOW)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cands = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in cands.items():
        if any(g == lang and len(v) > len(w) and 100 * b >= share * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (g, v), b in cands.items()):
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    done = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        done += [(x[0], i, *x[1:]) for i, x in enumerate(own[:top], 1)]
    return sorted(done)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    return df.selectExpr("1L as doc_id", "*", "'x' as piece", "5 as k", "1 as block", "'p' as phrase", "0 as f")


def rows_of():
    rng = random.Random(4)
    words = ["a", "b", "ab", "é", "日本", "a b", "x\x00y", "C"]
    rows = [(t, rng.choice(["en", "de", None, "und"])) for _, t in documents(80)] + [(t, None) for t in ODD]
    for _ in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", " \t", ", ", ". ", "\n", "\x0b", "\x0c", "!?"]) for _ in range(rng.randrange(60)))
        rows.append((text, rng.choice(["en", "fr", "", "t\tx\n", None])))
    return rows + [("new york city, new york city", "fr")] * 9 + [("repeat me", "")] * 40


def test_equal_brute_force(spark, monkeypatch):
    rows = rows_of()
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    for longest, least, top, block in ((3, 10, 2000, 4096), (3, 2, 25, 8), (4, 2, 7, 4096)):
        monkeypatch.setattr(phrases, "BLOCK", block)  # small: many blocks, whose firsts meet in groups
        monkeypatch.setattr(phrases, "FAN_IN", 4)
        got = phrases.collocations(frame(spark, rows), longest, least, top=top).select(names).collect()
        assert sorted(map(tuple, got)) == brute(rows, longest, least, top=top)


def test_nothing_to_count(spark):
    assert phrases.collocations(frame(spark, [])).collect() == []
    assert phrases.collocations(frame(spark, [(None, None), ("", "en"), (" . ,", "en"), ("one", "de")])).collect() == []


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    big = 10**12 + 7
    rows = [("en", "u", 1, 3 * big + 1), ("en", "v", 1, 2 * big + 9), ("en", "u v", 2, big), ("en", None, 0, 10 * big)]
    monkeypatch.setattr(phrases, "counts", lambda *_: spark.createDataFrame(rows, "lang string, phrase string, k int, f long"))
    assert [r.score for r in phrases.collocations(frame(spark, [])).collect()] == [10**6 * big * big // ((3 * big + 1) * (2 * big + 9))]


def test_a_bucket_adds_up_what_tasks_sent():
    one, _ = phrases.grams(["en", "en", "de"], ["a b a b", "b", "a"], [2, 5, 1], 2)
    got = [r for b in phrases.count_bucket([one, one, one.slice(0, 0)], 2, 1) for r in pa.Table.from_batches([b]).to_pylist()]
    assert {(r["lang"], r["phrase"]): r["f"] for r in got} == {("en", "a"): 8, ("en", "b"): 18, ("de", "a"): 2, ("en", "a b"): 8, ("en", "b a"): 4, ("en", None): 26, ("de", None): 2}


def test_lines_come_back_as_they_went():
    table, _ = phrases.grams(["t\tx\n", "", "de"], ['"a" b\x00 c', "b \\ d # e", "a"], [2, 5, 1], 3)
    whole = phrases.packed_lines(table, [0, 3, table.num_rows])
    assert pa.concat_tables([phrases.unpacked_lines(x, 3) for x in whole]).to_pylist() == table.to_pylist()
