"""SimHash near-duplicates: fingerprints, links by pivot distance tables, components.

Fingerprints that are equal count once from the start. Every pair within ``max_bits`` agrees on at least
``BLOCKS - max_bits`` of ``BLOCKS`` bit blocks, so each fingerprint enters one bucket for each choice of that many blocks
and no such pair is missed. Inside a bucket the pivot table - Hamming distances to reference fingerprints, computed once
for each fingerprint - discards pairs whose largest coordinate difference exceeds ``max_bits`` (by the triangle inequality
none of them can be close), and the survivors are verified by their differing bits. Distances in 64 bits crowd around 32,
so pivots alone could not bound the candidates; they discard within the buckets.

Buckets are met in a stream of sorted rows. One of more than ``TILE`` fingerprints is dealt out as pairs of tiles, each
a bucket of its own, so no group is held whole. A bucket emits links that span its groups instead of all pairs.

Edge cases: a null or empty text has fingerprint zero and links like any other; texts of fewer words than a shingle are
one shingle; repeated rows give a row each with one component, and ``one_of_each`` keeps all rows of a kept id; an empty table gives no rows; null ids keep a fingerprint
and take part in no component but their own (null); other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltern.llm.common import join_heavy, small_batches, stage, text_rows
from saltern.llm.components import least_members

BLOCKS = 7
TILE = 2048
#: Reference fingerprints of the pivot table.
PIVOTS = 16
_LOWER = bytes(b + 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: str, width: int = 4) -> int:
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    votes = np.zeros(64, np.int64)
    for lo in range(0, n, 65536):
        part = words[lo : lo + 65536 + width - 1]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(g), 42) for g in (zip(*[part[k:] for k in range(width)], strict=False) if len(words) >= width else [words])], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long)."""

    def mapped(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return text_rows(docs).mapInArrow(mapped, "doc_id long, fp long")


def _pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed values from a generator of fixed seed."""
    return np.random.default_rng(8).integers(0, 1 << 64, n, np.uint64)


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each pivot."""
    return np.bitwise_count(fp[:, None] ^ _pivots()[None, :]).astype(np.int8)


def block_masks(max_bits: int) -> list[int]:
    """The bits that must agree, one mask for each choice of blocks."""
    edges = [round(64 * k / BLOCKS) for k in range(BLOCKS + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(c) for c in combinations(block, BLOCKS - max_bits)]


def close(fp: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs of a bucket are within ``max_bits``: pivot coordinates discard, the bits verify the survivors."""
    table, n = pivot_table(fp), len(fp)
    out = np.zeros((n, n), np.bool_)
    for lo in range(0, n, 512):
        rows = slice(lo, min(lo + 512, n))
        near = np.abs(table[rows, 0, None] - table[None, :, 0]) <= max_bits
        for k in range(1, 4):
            near &= np.abs(table[rows, k, None] - table[None, :, k]) <= max_bits
        i, j = np.nonzero(near)
        keep = np.abs(table[rows][i] - table[j]).max(1, initial=0) <= max_bits
        i, j = i[keep], j[keep]
        keep = np.bitwise_count(fp[rows][i] ^ fp[j]) <= max_bits
        out[i[keep] + lo, j[keep]] = True
    return out


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of a symmetric relation: one fewer than each component has members."""
    left, a, b = np.ones(len(near), np.bool_), [], []
    for root in range(len(near)):
        todo = [root] if left[root] else []
        left[root] = False
        while todo:
            v = todo.pop()
            new = np.flatnonzero(near[v] & left)
            left[new] = False
            a.append(np.full(len(new), v))
            b.append(new)
            todo.extend(new.tolist())
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]).astype(np.int64), np.concatenate([none, *b]).astype(np.int64)


def bucket_links(batches, max_bits: int, tile: int):
    """Links within buckets, which are runs of an equal key in sorted rows (fp, key); three columns go out.

    A bucket of more than ``tile`` rows goes out as it came, with its key, to be dealt out; links have a null key.
    """

    def rows(a, b, key=None):
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(n, pa.int64()) if b is None else pa.array(b, pa.int64()), pa.nulls(n, pa.int64()) if key is None else pa.array(key, pa.int64())], names=["a", "b", "key"])

    def met(fp, key):
        cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        at, size, bits = cut[:-1], np.diff(cut), fp.view(np.uint64)
        two = at[size == 2]  # most buckets with any pair have one
        table, other = pivot_table(bits[two]), pivot_table(bits[two + 1])
        keep = (np.abs(table - other).max(1, initial=0) <= max_bits) & (np.bitwise_count(bits[two] ^ bits[two + 1]) <= max_bits)
        left, right = [fp[two[keep]]], [fp[two[keep] + 1]]
        for lo, n in zip(at[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            a, b = forest(close(bits[lo : lo + n], max_bits))
            left.append(fp[lo + a])
            right.append(fp[lo + b])
        return rows(np.concatenate(left), np.concatenate(right))

    fp, key, large = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in batches:
        more_fp, more_key = batch["fp"].to_numpy(), batch["key"].to_numpy()
        if large is not None:  # the rest of a large bucket
            n = int(np.argmax(more_key != large)) if (more_key != large).any() else len(more_key)
            yield rows(more_fp[:n], None, more_key[:n])
            more_fp, more_key = more_fp[n:], more_key[n:]
            if not len(more_key):
                continue
            large = None
        fp, key = np.concatenate([fp, more_fp]), np.concatenate([key, more_key])
        if not len(key):
            continue
        start = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
        cut = np.concatenate([[0], np.flatnonzero(np.diff(key[:start])) + 1, [start]]) if start else np.zeros(1, np.int64)
        big = np.repeat(np.diff(cut) > tile, np.diff(cut))
        if big.any():
            yield rows(fp[:start][big], None, key[:start][big])
        if start and not big.all():
            yield met(fp[:start][~big], key[:start][~big])
        fp, key = fp[start:], key[start:]
        if len(key) > tile:
            large = int(key[0])
            yield rows(fp, None, key)
            fp, key = fp[:0], key[:0]
    if len(key):
        yield met(fp, key)


def links(distinct: DataFrame, max_bits: int = 4, tile: int = TILE) -> DataFrame:
    """(a, b): fingerprints within ``max_bits``, enough of them that components are those of all such pairs."""
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in block_masks(max_bits)])
    rows = distinct.select("fp", F.posexplode(masks).alias("which", "mask")).select("fp", F.xxhash64("which", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    met = rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: bucket_links(it, max_bits, tile), "a long, b long, key long")
    met = stage(met, "links")
    # large buckets: each row falls in one tile by its own hash, and each pair of tiles is a bucket of its own
    large = met.where("key is not null").select(F.col("a").alias("fp"), "key")
    tiles = large.groupBy("key").agg(F.greatest(F.lit(2), F.ceil(F.count("*") / F.lit(tile // 4))).cast("long").alias("tiles"))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("tiles"))
    dealt = large.join(tiles, "key").select("fp", "key", "tiles", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
    pairs = dealt.where("own <> other").select("fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"))
    more = pairs.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: bucket_links(it, max_bits, 1 << 30), "a long, b long, key long")
    return met.where("key is null").select("a", "b").union(more.select("a", "b"))


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable by links of at most ``max_bits`` differing bits."""
    with small_batches(docs.sparkSession):
        marked = stage(fingerprints(docs, width), "fingerprints")
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("held")), "distinct")
    member = least_members(distinct.select(F.col("fp").alias("node"), "first"), links(distinct.select("fp"), max_bits))
    member = stage(distinct.select(F.col("fp").alias("node"), "held").join(member, "node").withColumnRenamed("node", "fp"), "members")
    return join_heavy(marked, member, ["fp"], "held", marked.count()).select("doc_id", "fp", "component_id")


def with_hex(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, width: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` with one document of each group: its smallest doc_id, all columns as they are.

    Rows that repeat a kept id all stay: they are one document.
    """
    found = near_duplicates(docs, width, max_bits)
    out = found.where("doc_id <> component_id").select("doc_id").distinct()
    # the columns travel as one struct, so that no name of theirs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(out, F.col("row.doc_id") == out["doc_id"], "left_anti").select("row.*")
