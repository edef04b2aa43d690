import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from saltern.llm import packing, token_counts
from tests.llm.fixtures import frame, odd_documents


def test_token_counts_equal_the_library(spark):
    rows = odd_documents()
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = token_counts.token_counts(frame(spark, rows), path).collect()
    want = sorted((d, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t in rows)
    assert sorted(map(tuple, got)) == want


def test_packing_holds_every_id_once_without_gaps(spark):
    rows = odd_documents()
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    ids = {d: [*lib.encode(t or "", add_special_tokens=False).ids, 2] for d, t in rows}
    out = packing.with_digest(packing.pack(frame(spark, rows), path, size=256, group_tokens=20_000)).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in out:
        docs[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.length > 0 and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert docs.keys() == ids.keys()
    for d, pieces in docs.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(ids[d])
    padding = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256
        padding += 0 if at & (at - 1) == 0 else 256 - at
    assert padding == 0


def test_packing_balances_cost():
    lengths = np.array([256] * 4 + [100, 90, 80, 60, 50, 40, 30, 20, 10, 5] * 8)
    pieces = packing.assign(lengths, 256)
    cost = defaultdict(float)
    for _, _, n, at, _ in pieces:
        cost[at] += packing.LINEAR * n + packing.QUADRATIC * n * n
    full = [c for at, c in cost.items() if at not in {p[3] for p in pieces if p[2] == 256}]
    assert sum(p[2] for p in pieces) == lengths.sum() and max(full) < 300


def test_empty_tables(spark):
    none = frame(spark, [])
    assert token_counts.token_counts(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
