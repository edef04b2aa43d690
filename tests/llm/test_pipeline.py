"""The pipeline's stages against brute force, each on what the one before it kept."""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from saltern.llm import quality
from tests.llm import test_decontamination, test_simhash
from tests.llm.fixtures import documents

SF = "/root/testdata/sf0.001"


def inputs(folder):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()[:150]
    bench = [(k, t[:200]) for k, (_, t) in enumerate(documents(150)[140:])]
    at = 10_000
    for _, item in bench[:4]:
        rows.append(dict(rows[7], doc_id=at, text=rows[7 + at % 5]["text"] + " " + item))
        at += 1
    rows.append(dict(rows[20], doc_id=at, text=rows[20]["text"] + " card 4539578763621486, mail a.b@c.example.com"))
    rows += [dict(rows[0], doc_id=at + 1, text=None), dict(rows[0], doc_id=at + 2, lang=None)]
    for r in rows:
        r["n_chars"] = len(r["text"] or "")
    pq.write_table(pa.Table.from_pylist(rows), f"{folder}/documents.parquet")
    pq.write_table(pa.table({"item_id": [b[0] for b in bench], "text": [b[1] for b in bench]}), f"{folder}/benchmark.parquet")
    return rows, bench


def test_stages_equal_brute_force(spark, tmp_path):
    _, bench = inputs(tmp_path)
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        before = rows(docs)
        out = f(spark, docs, d)
        out.write.parquet(f"{d}/{k}")
        out = spark.read.parquet(f"{d}/{k}")
        if name == "packing":
            lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            ids = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 2] for i, t in before}
            pieces = out.collect()
            assert sum(p.length for p in pieces) == sum(map(len, ids.values()))
            assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) for p in pieces)
            break
        assert out.columns == columns
        after = rows(out)
        if name == "quality_rules":
            want = {r.doc_id for r in quality.assess(docs).where("kept").collect()}
            assert {i for i, _ in after} == want and 0 < len(after) < len(before)
        elif name == "simhash_near_duplicates":
            assert {i for i, _ in after} == {i for i, _, c in test_simhash.brute(before) if i == c} and len(after) < len(before)
        elif name == "benchmark_decontamination":
            assert {i for i, _ in after} == {i for i, *_, bad in test_decontamination.brute(before, bench) if not bad} and len(after) < len(before)
        else:
            assert {i for i, _ in after} == {i for i, _ in before}
            assert not any("4539578763621486" in t or "a.b@c.example.com" in t for _, t in after)
            assert all(r.n_chars == len(r.text) for r in out.collect())
            assert sum(a != b for a, b in zip(sorted(before), sorted(after))) >= 1
        docs = out


def test_run_chains_the_stages(spark, tmp_path):
    inputs(tmp_path)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 10
