import math
import re
import unicodedata
from collections import Counter

from saltern.llm import quality
from tests.llm.fixtures import SF, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    hit = {j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), failed


def frame(spark, rows):
    return spark.createDataFrame([(d, t, ("en", "fr", None, "xx")[d % 4] if d is not None else "de") for d, t in rows], "doc_id long, text string, lang string").selectExpr("*", "1 as n_words", "'a' as words", "2 as classes", "true as kept")


def test_base_counts_equal_brute_force(spark):
    rows = odd_documents(80) + [(5000, "a b c " * 30 + "d e f g"), (5001, "x\ny\nx\n \n \ny\n"), (5002, "a a a a a"), (5003, "p q r p q r s"), (5004, "one\ttwo\x0bthree\x85four five")]
    got = quality.report(quality.assess(frame(spark, rows))).collect()
    want = {d: brute(t) for d, t in rows}
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == want
    assert len(got) == len(rows) and all(not r.kept for r in got if r.base_failed)


def histogram(text, lang):
    found = WORD.findall(text)
    plain = "".join(w for w in found if not re.search("[0-9@]", w))
    low, up = sum(unicodedata.category(c) == "Ll" for c in plain), sum(unicodedata.category(c) == "Lu" for c in plain)
    chars = [low, up, *(len(re.findall(quality.CLASSES[k], plain)) for k in ("stop", "shout"))]
    words = Counter(w.lower() for w in found)
    common = [words[w] for w in quality.COMMON.get(lang, [])]
    return [*chars, len(plain) - sum(chars)], [*common, len(found) - sum(common)]


def js(p, q):
    total = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        total += sum(x * math.log2(x / m) / 2 for x in (a, b) if x > 0)
    return math.sqrt(max(total, 0))


def test_distances_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    bars = {d: histogram(*x) for d, x in rows.items()}
    fine = [d for d, (t, _) in rows.items() if not brute(t)[-1] and sum(bars[d][0]) >= quality.GUARD_CHARS]

    def reference(ids):
        out = {}
        for d in ids:
            out.setdefault(rows[d][1], []).append([[x / sum(h) for x in h] for h in bars[d]])
        return {k: [[sum(x) / len(v) for x in zip(*(h[i] for h in v))] for i in (0, 1)] for k, v in out.items()}

    def distances(d, refs):
        return [js([x / sum(h) for x in h], refs[rows[d][1]][i]) if sum(h) >= least else 0.0 for i, (h, least) in enumerate(zip(bars[d], (quality.GUARD_CHARS, quality.GUARD_WORDS)))]

    first = reference(fine)
    near = [d for d in fine if distances(d, first)[0] <= quality.WIDE_CHARS and distances(d, first)[1] <= quality.WIDE_WORDS]
    refs = reference(near)
    for r in quality.assess(docs).collect():
        c, w = distances(r.doc_id, refs)
        assert abs((r.char_distance or 0.0) - c) < 1e-6 and abs((r.word_distance or 0.0) - w) < 1e-6
        assert r.kept == (not r.base_failed and c <= quality.LIMIT_CHARS and w <= quality.LIMIT_WORDS)


def test_labelled_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality.assess(docs).join(labels, "doc_id").where("not base_failed").selectExpr("quality", "int(kept) as k")
    share = {r.quality: r.k for r in judged.groupBy("quality").avg("k").toDF("quality", "k").collect()}
    assert share[1] > 0.99 and share.get(0, 0) < 0.3


def test_kept_documents_and_empty_tables(spark):
    df = frame(spark, odd_documents(60))
    verdict = {r.doc_id: r.kept for r in quality.assess(df).collect()}
    out = quality.kept_documents(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == sorted(d for d, k in verdict.items() if k)
    assert quality.assess(df.where("false")).count() == 0 and quality.kept_documents(df.where("false")).count() == 0
    assert "Python" not in quality.assess(df)._jdf.queryExecution().toString()
