"""Exchange of fingerprints between blocks of documents: which strings of a block also occur elsewhere, and where first.

Documents are staged once, as compressed blocks of a few MB. Both questions are then asked of all blocks at once:

1. ``shared_names``: each block sends its distinct names (hashes of content-defined parts) to buckets; each bucket says
   which of them two blocks have. Only names found twice make candidates, so unique text is never shuffled.
2. the operator's own exchange of candidates, which compares whole content and answers for each one.

A block sends a name once however often it occurs, so frequent strings don't crowd a bucket. Answers are bits in the
order in which a block asked. Buckets hold about ``BUCKET_BYTES`` of input each, at any size of corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltern.llm.common import stage, text_rows

BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS_LOG2, MOST_BUCKETS_LOG2 = 6, 24
#: The place of a null id in the order of ids: after all others.
NULL_ID = (1 << 63) - 1

ASKED = "bucket long, block long, asked binary"
ANSWERED = "block long, bucket long, step int, bits binary"
_ANSWER = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("step", pa.int32()), ("bits", pa.binary())])


def pack_table(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def unpack_table(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


class Block:
    """The documents of a block by ascending id: ``ids`` (null last), ``present`` (id is not null), ``texts`` (bytes)."""

    def __init__(self, raw: bytes):
        t = unpack_table(raw)
        ids = t["doc_id"].combine_chunks()
        self.present = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(NULL_ID).to_numpy()
        self.texts = t["text"].to_pylist()


def stage_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(block, payload) in the shared folder, and the base-two logarithm of a fitting number of buckets."""

    def blocks(batches):
        made = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0

        def close():
            t = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.binary())})
            t = t.sort_by([("doc_id", "ascending")])  # nulls go last
            return pa.RecordBatch.from_arrays([pa.array([made]), pa.array([held]), pa.array([pack_table(t)], pa.binary())], names=["block", "size", "payload"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text.encode())
                held += len(texts[-1]) + 16
                if held >= block_bytes:
                    yield close()
                    ids, texts, held, made = [], [], 0, made + 1
        if ids:
            yield close()

    staged = stage(text_rows(docs).mapInArrow(blocks, "block long, size long, payload binary"), "blocks")
    total = staged.agg(F.sum("size")).first()[0] or 0
    log2 = min(MOST_BUCKETS_LOG2, max(LEAST_BUCKETS_LOG2, (total // BUCKET_BYTES).bit_length()))
    return staged.select("block", "payload"), log2


def bucket_slices(sorted_names: np.ndarray, log2: int):
    """(bucket, slice) of each bucket with names: a bucket is a range of leading bits."""
    of = sorted_names >> np.uint64(64 - log2)
    cut = np.flatnonzero(np.diff(of)) + 1
    edges = np.concatenate([[0], cut, [len(of)]]) if len(of) else np.zeros(1, np.int64)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(of[lo]), slice(lo, hi)


def shared_names(blocks: DataFrame, distinct_names, log2: int) -> DataFrame:
    """Answers of step 1: for each block's names, in ascending order, whether another block has them too.

    ``distinct_names(block)`` gives a block's distinct names, ascending, as well-mixed 64-bit numbers. Forty bits below
    the bucket's are compared; a false match would only make a needless candidate.
    """

    def ask(batches):
        for b in batches:
            for block, payload in zip(b["block"].to_pylist(), b["payload"], strict=True):
                names = distinct_names(Block(payload.as_py()))
                low = (names << np.uint64(log2) >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)
                rows = [(k, block, low[s, :5].tobytes()) for k, s in bucket_slices(names, log2)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "block", "asked"])

    def answer(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, 5) for x in t["asked"]]
        wide = np.zeros((sum(map(len, parts)), 8), np.uint8)
        wide[:, :5] = np.concatenate(parts)
        value = wide.view("<u8").ravel()
        order = np.argsort(value, kind="stable")
        same = value[order][1:] == value[order][:-1]
        shared = np.zeros(len(value), np.bool_)
        shared[order[1:][same]] = shared[order[:-1][same]] = True
        return answers(t, shared, [len(p) for p in parts], 1)

    asked = blocks.mapInArrow(ask, ASKED)
    return stage(asked.groupBy("bucket").applyInArrow(answer, ANSWERED), "shared")


def answers(t: pa.Table, bits: np.ndarray, sizes: list[int], step: int) -> pa.Table:
    """One row of bits for each asking block."""
    at = np.cumsum([0, *sizes])
    packed = [np.packbits(bits[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    n = len(packed)
    return pa.table([t["block"].combine_chunks(), t["bucket"].combine_chunks(), pa.array([step] * n, pa.int32()), pa.array(packed, pa.binary())], schema=_ANSWER)


def answers_of(t: pa.Table, step: int) -> dict[int, np.ndarray]:
    """bucket -> bits of one step's answers to one block (with up to seven bits more than were asked)."""
    return {b: np.unpackbits(np.frombuffer(x, np.uint8)) for b, s, x in zip(t["bucket"].to_pylist(), t["step"].to_pylist(), t["bits"].to_pylist(), strict=True) if s == step}


def spread(names: np.ndarray, bits: dict[int, np.ndarray], log2: int) -> np.ndarray:
    """The answers for sorted names, as one array."""
    out = np.zeros(len(names), np.bool_)
    for k, s in bucket_slices(names, log2):
        out[s] = bits[k][: s.stop - s.start]
    return out


def per_block(blocks: DataFrame, answered: DataFrame, f, schema: str) -> DataFrame:
    """``f(block_id, block, answers table)`` for each block."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return f(left["block"][0].as_py(), Block(left["payload"][0].as_py()), right)

    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(meet, schema)
