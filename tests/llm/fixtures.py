"""Small tables that hold the odd cases: nulls, empty texts, ties, repeated rows, clashing column names."""

import random

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "\n\n  \n", "a", "one two three", "é ß 日本 tab\tx", "<|endoftext|> <|im_end|>x", "word " * 300, "a  b   c \n d", "x\x00y \x00"]


def documents(n=120):
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()[:n]]


def odd_documents(n=60):
    base = documents(n)
    rng = random.Random(3)
    rows = list(base)
    at = 1000
    for t in ODD:
        rows.append((at, t))
        at += 1
    for _, t in base[:15]:
        words = t.split(" ")
        k = rng.randrange(len(words))
        rows.append((at, " ".join([*words[:k], "edited", *words[k + 1 :]])))
        rows.append((at + 1, t))
        at += 2
    rng.shuffle(rows)
    return rows


def frame(spark, rows, clash=True):
    """The rows as a table with further columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if clash:
        df = df.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "1L as n_chars", "'k' as key", "'h' as hits", "1L as block", "0 as fp", "7 as n_words")
    return df
