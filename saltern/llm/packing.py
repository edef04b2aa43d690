"""Cost-balanced packing of tokenized documents into sequences.

Each task tokenizes its documents and packs them group by group: a group closes when it holds ``GROUP_TOKENS`` ids, so
memory is bounded and nothing is shuffled. A group's sequences are fixed by its size: full ones, then powers of two for
the rest, which need no padding. Documents longer than a sequence are cut into full pieces first; then the pieces go, in
descending length, to the sequence of lowest estimated cost (linear plus quadratic in each piece's length, the cost of
attention within documents) that has room for the whole piece. A piece that fits nowhere is cut at the room that the
cheapest open sequence has left.

Edge cases: a null or empty text is its closing id alone; repeated rows and ids are packed as rows of their own; an
empty table gives no rows; ties in length keep the input order; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltern.llm.common import text_rows
from saltern.llm.tokens import WordEncoder

GROUP_TOKENS = 1 << 20
#: Estimated cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def capacities(total: int, size: int) -> np.ndarray:
    """Sequence sizes that sum to ``total``: full ones, then descending powers of two."""
    rest = total % size
    return np.array([size] * (total // size) + [1 << k for k in range(size.bit_length(), -1, -1) if rest >> k & 1], np.int64)


def assign(lengths: np.ndarray, size: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of one group."""
    room = capacities(int(lengths.sum()), size)
    cap, cost, out = room.copy(), np.zeros(len(room)), []

    def put(doc: int, start: int, n: int, at: int) -> None:
        out.append((doc, start, n, at, int(cap[at] - room[at])))
        room[at] -= n
        cost[at] += LINEAR * n + QUADRATIC * n * n

    todo, full = [], iter(np.flatnonzero(cap == size).tolist())
    for doc in np.argsort(-lengths, kind="stable").tolist():
        n, start = int(lengths[doc]), 0
        while n - start >= size:
            put(doc, start, size, next(full))
            start += size
        if n > start:
            todo.append((n - start, doc, start))
    todo.sort(key=lambda x: -x[0])
    for n, doc, start in todo:
        while n:
            fits = np.flatnonzero(room >= n)
            if len(fits):
                put(doc, start, n, int(fits[np.argmin(cost[fits])]))
                break
            open_ = np.flatnonzero(room > 0)
            at = int(open_[np.argmin(cost[open_])])
            take = int(room[at])
            put(doc, start, take, at)
            start, n = start + take, n - take
    return out


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 2, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""

    def packed(batches):
        encoder = WordEncoder(tokenizer_path)
        made = TaskContext.get().partitionId() << 40  # sequence ids are unique across tasks
        ids, texts, held = [], [], 0

        def close():
            nonlocal made
            lengths = np.array([len(t) for t in texts], np.int64)
            pieces = assign(lengths, size)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([ids[d] for d, *_ in pieces], pa.int64()),
                    "start": pa.array([p[1] for p in pieces], pa.int64()),
                    "length": pa.array([p[2] for p in pieces], pa.int64()),
                    "ids": pa.array([texts[d][s : s + n].astype("<u4").tobytes() for d, s, n, _, _ in pieces], pa.binary()),
                    "doc_tokens": pa.array(lengths[[p[0] for p in pieces]], pa.int64()),
                    "sequence_id": pa.array([made + p[3] for p in pieces], pa.int64()),
                    "offset": pa.array([p[4] for p in pieces], pa.int64()),
                }
            )
            made += max(p[3] for p in pieces) + 1

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(np.append(np.frombuffer(encoder.encode(text), encoder.dtype), encoder.dtype.type(end_id)))
                held += len(texts[-1])
                if held >= group_tokens:
                    yield from close()
                    ids, texts, held = [], [], 0
        if texts:
            yield from close()

    return text_rows(docs).mapInArrow(packed, PIECES)


def with_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
