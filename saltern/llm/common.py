"""Helpers shared by the training-data operators: table access, shared-folder staging, byte-level words."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts state it: U+0020 and U+0009 to U+000D.
ASCII_SPACE = bytes([9, 10, 11, 12, 13, 32])
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
DEFAULT_SHARED = "file:///tmp/saltern-shared"
#: Uncompressed bytes of a row group of staged tables: writers and readers hold about one for each core.
GROUP_BYTES = 32 << 20
#: Bytes of an Arrow batch; a worker and its JVM task hold a few copies of one.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a local default only on a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (path or DEFAULT_SHARED).rstrip("/")


_UNITS = {"": 0, "b": 0, "k": 1, "kb": 1, "m": 2, "mb": 2, "g": 3, "gb": 3, "t": 4, "tb": 4, "p": 5, "pb": 5}


def byte_size(text: str) -> int:
    """A size as Spark's settings state it: ``64m``, ``8MB``, ``1024`` or ``1024b``; below zero where it is unbounded."""
    found = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", text.lower())
    if not found or found[2] not in _UNITS:
        raise ValueError(f"not a size in bytes: {text!r}")
    return int(found[1]) << (10 * _UNITS[found[2]])


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs that run inside get Arrow batches of at most ``BATCH_BYTES``; the session's own bound holds again afterwards."""
    own = spark.conf.get(BATCH_KEY)
    lower = not 0 < byte_size(own) <= BATCH_BYTES
    if lower:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    try:
        yield
    finally:
        if lower:
            spark.conf.set(BATCH_KEY, own)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends in files that survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: No more keys than this can hold more than one part in this many of all rows.
HEAVY_SHARE = 256


def join_heavy(rows: DataFrame, few: DataFrame, keys: list[str], held: str, total: int) -> DataFrame:
    """``rows`` joined with the one row that ``few`` has for each key, of whose rows ``few`` says the number (``held``).

    Keys of more than ``total`` / ``HEAVY_SHARE`` rows, of which there are fewer than ``HEAVY_SHARE``, are broadcast, so
    their rows stay where they are; all others meet by a shuffle in which no key has many.
    """
    heavy = F.col(held) * HEAVY_SHARE > total
    most = F.broadcast(few.where(heavy).drop(held))
    rest = rows.join(F.broadcast(few.where(heavy).select(keys)), keys, "left_anti")
    return rows.join(most, keys).unionByName(rest.join(few.where(~heavy).drop(held), keys))


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with a null text as the empty text; other columns, whatever their names, are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


# --- words of a byte buffer, vectorised -------------------------------------------------------------

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_S32, _S29 = np.uint64(32), np.uint64(29)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
#: Bytes that must follow the data of a padded buffer.
PAD = 16
LONG_WORD = 512


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    x ^= x >> _S32
    x *= _M2
    x ^= x >> _S29
    return x


def padded(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([*parts, bytes(PAD)]), np.uint8)


def word_spans(buf: np.ndarray, n: int, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of word bytes in the first ``n`` bytes."""
    w = np.zeros(n + 2, np.int8)
    w[1:-1] = is_word[buf[:n]]
    d = np.diff(w)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, by 8-byte loads; the same bytes hash alike in any task."""
    loads = np.ndarray((len(buf) - 7,), "<u8", np.ascontiguousarray(buf), 0, (1,))
    size = ends - starts
    h = size.astype(np.uint64) * _M1
    live, at = np.flatnonzero(size < LONG_WORD), 0
    while len(live):
        left = np.minimum(size[live] - at, 8)
        x = loads[starts[live] + at] & _MASK[left]
        h[live] = mix((h[live] ^ x) * _M3)
        at += 8
        live = live[size[live] > at]
    if len(long := np.flatnonzero(size >= LONG_WORD)):
        import xxhash

        for i in long:
            h[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]].tobytes(), 7)
    return h


SPACE_TABLE = np.ones(256, np.bool_)
SPACE_TABLE[list(ASCII_SPACE)] = False
