import hashlib
import random
import re

from saltern.llm import decontamination
from tests.llm.fixtures import documents, frame, odd_documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items, n=10):
    out = []
    for d, t in rows:
        w = words(t)
        hit, found = set(), set()
        for item, text in items:
            g = words(text)
            size = min(n, len(g))
            grams = {tuple(g[k : k + size]) for k in range(len(g) - size + 1)} if size else set()
            for k in range(len(w) - size + 1) if size else ():
                if tuple(w[k : k + size]) in grams:
                    hit.update(range(k, k + size))
                    found.add(str(item))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def case():
    rng = random.Random(5)
    rows = odd_documents(40)
    items = [(k, t[:300]) for k, (_, t) in enumerate(documents(60)[50:])] + [(100, None), (101, ""), (102, "edited"), (103, "One, TWO"), (9, "one two!")]
    for k in range(12):
        item = rng.choice(items[:10])[1].upper()
        rows.append((5000 + k, f"lead in {item[rng.randrange(40):]} and on"))
    return rows, items


def test_hits_equal_brute_force(spark):
    rows, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontamination.BLOCK_BYTES, 900):
        got = decontamination.report(decontamination.decontaminate(frame(spark, rows), bench, block_bytes=block)).collect()
        assert sorted(map(tuple, got)) == brute(rows, items)


def test_clean_documents_keeps_exactly_the_uncontaminated(spark):
    rows, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontamination.BLOCK_BYTES, 900):
        kept = decontamination.clean_documents(frame(spark, rows), bench, block_bytes=block)
        assert kept.columns == frame(spark, rows).columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, *_, bad in brute(rows, items) if not bad)


def test_byte_spans_are_the_hit_words(spark):
    rows, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = dict(rows)
    for r in decontamination.decontaminate(frame(spark, rows), bench).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert [raw[a:b].decode().lower() for a, b in zip(r.starts, r.ends)] == [words(texts[r.doc_id])[k].lower() for k in r.hits]


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(frame(spark, []), bench).count() == 0
    got = decontamination.report(decontamination.decontaminate(frame(spark, [(1, "a b")]), bench)).collect()
    assert [(r.n_hit, r.contaminated) for r in got] == [(0, False)]


def test_repeated_and_null_ids_give_a_row_each_for_any_number_of_blocks(spark):
    rows = [(1, "alpha beta gamma delta"), (1, "delta eps zeta"), (1, "delta eps zeta"), (None, "alpha beta gamma"), (None, None), (2, "nothing")]
    items = [("a", "alpha beta gamma"), ("b", "eps zeta"), ("c", "Eps, zeta!"), ("d", "beta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    key = lambda r: tuple((x is not None, x) for x in r)
    for block in (decontamination.BLOCK_BYTES, 20, 1):
        got = decontamination.report(decontamination.decontaminate(docs, bench, block_bytes=block)).collect()
        assert sorted(map(tuple, got), key=key) == sorted(brute_rows(rows, items), key=key)


def brute_rows(rows, items):
    return [x for r in rows for x in brute([r], items)]


def test_table_takes_less_than_four_times_its_text():
    rng = random.Random(1)
    items = [(str(k), " ".join(f"w{rng.randrange(10**rng.randrange(1, 9))}" for _ in range(400))) for k in range(1000)]
    (table,) = decontamination.item_windows(items, 10)
    held = sum(x.nbytes for x in (table.hashes, table.places, table.starts, table.first)) + len(table.text)
    assert held < 4 * sum(len(t) for _, t in items)
