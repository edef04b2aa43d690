"""Benchmark decontamination: a broadcast hash set of the benchmark's word n-grams meets every document's windows.

The benchmark is read in blocks of a checked size (``BLOCK_BYTES`` of text each); each block's windows are broadcast as
sorted hashes beside the text they lie in, and one scan of the documents meets one block, so a benchmark of any size
works. A hash hit counts only after the words themselves compare equal.

Edge cases: a null text or item has no words; an item of fewer than ``n`` words is one shorter window; items that say the
same are all reported; repeated rows and repeated or null ids give a row each; empty tables give zero hits or no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltern.llm.common import hash_words, mix, padded, stage, text_rows, word_spans

#: Benchmark text that one broadcast table is built from; the table takes less than four times as many bytes.
BLOCK_BYTES = 16 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: After lower-casing, words consist of digits, small letters and all bytes of non-ASCII characters.
_WORD = np.zeros(256, np.bool_)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True

SPANS = "doc_id long, n_words long, hits array<long>, starts array<long>, ends array<long>, items array<string>"


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of the joined texts, word starts, ends, hashes, and the first word of each text (and the end)."""
    raw = [t.encode() for t in texts]
    buf = _LOWER[padded([x + b"\n" for x in raw])]
    at = np.cumsum([0] + [len(x) + 1 for x in raw])
    starts, ends = word_spans(buf, int(at[-1]), _WORD)
    return buf, starts, ends, hash_words(buf, starts, ends), np.searchsorted(starts, at)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out *= _BASE
        out += h[k : len(h) - n + 1 + k]
    return mix(out)


class Windows:
    """The windows of ``n`` words of a block of items, as sorted hashes and places in one buffer of the items' words.

    Nothing is held for each window but its hash and place (12 bytes), and for each word its place (4): the windows'
    words are read from the buffer, which is the items' text once, words parted by one space.
    """

    def __init__(self, words: list[list[bytes]], names: list[str], n: int):
        self.n, self.names = n, names
        sizes = np.array([len(w) for w in words], np.int64)
        self.text = b" ".join(x for w in words for x in w)
        buf = padded([self.text])
        starts, ends = word_spans(buf, len(self.text), _WORD)
        h = windows(hash_words(buf, starts, ends), n)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        # windows that end in the item they start in
        left = np.repeat(self.first[1:], sizes) - np.arange(self.first[-1])
        at = np.flatnonzero(left >= n)
        order = at[np.argsort(h[at], kind="stable")]
        self.hashes, self.places = h[order], order.astype(np.int32)
        self.starts = np.append(starts, len(self.text) + 1).astype(np.int32)
        self.leading = np.zeros(1 << 20, np.bool_)
        self.leading[self.hashes >> np.uint64(44)] = True

    def possible(self, w: np.ndarray) -> np.ndarray:
        """Which window hashes occur here."""
        at = np.flatnonzero(self.leading[w >> np.uint64(44)])
        return at[self.hashes[np.minimum(np.searchsorted(self.hashes, w[at]), len(self.hashes) - 1)] == w[at]]

    def items(self, h: np.uint64, said: bytes) -> frozenset[str]:
        """The items with the window of hash ``h`` whose words, parted by spaces, are ``said``."""
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        places = self.places[lo:hi]
        a, b = self.starts[places].tolist(), (self.starts[places + self.n] - 1).tolist()
        equal = [self.text[x:y] == said for x, y in zip(a, b, strict=True)]
        own = np.searchsorted(self.first, places[equal], "right") - 1
        return frozenset(self.names[i] for i in own.tolist())


def item_windows(items: list[tuple[str, str]], n: int) -> list[Windows]:
    """The windows of a block of items: one table of ``n`` words, and one for each length of shorter items."""
    by_size: dict[int, tuple[list[list[bytes]], list[str]]] = {}
    for item, text in items:
        buf, starts, ends, _, _ = words_of([text or ""])
        words = [buf[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        if words:
            held = by_size.setdefault(min(n, len(words)), ([], []))
            held[0].append(words)
            held[1].append(item)
    return [Windows(words, names, size) for size, (words, names) in by_size.items()]


def scan(rows: DataFrame, items: list[tuple[str, str]], n: int = 10, only_hits: bool = False) -> DataFrame:
    """The hit words of rows (id, text) against one block of items, as word numbers and as byte spans."""
    held = rows.sparkSession.sparkContext.broadcast(item_windows(items, n))

    def scanned(batches):
        for b in batches:
            for out in _scan(b, held.value):
                yield out.filter(pc.greater(pc.list_value_length(out["hits"]), 0)) if only_hits else out

    return rows.mapInArrow(scanned, SPANS)


def _scan(b: pa.RecordBatch, tables: list[Windows], chunk: int = 1 << 22):
    """In parts of about ``chunk`` bytes, so that memory doesn't depend on how a batch was cut."""
    ids, texts = b.column(0), b.column(1).to_pylist()
    sizes = np.cumsum([len(t) for t in texts]) // chunk
    for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes)) + 1):
        if not len(part):
            continue
        buf, starts, ends, h, first = words_of([texts[i] for i in part])
        doc_of = np.repeat(np.arange(len(part)), np.diff(first))
        hit, found = np.zeros(len(h) + 1, np.int64), [set() for _ in part]
        for table in tables:
            size, w, seen = table.n, windows(h, table.n), {}
            at = table.possible(w)
            at = at[doc_of[at] == doc_of[at + size - 1]] if len(at) else at
            for k in at.tolist():
                said = b" ".join([buf[starts[j] : ends[j]].tobytes() for j in range(k, k + size)])
                if said not in seen:
                    seen[said] = table.items(w[k], said)
                if items := seen[said]:
                    hit[k] += 1
                    hit[k + size] -= 1
                    found[doc_of[k]].update(items)
        covered = np.cumsum(hit[:-1]) > 0
        base = np.concatenate([[0], np.cumsum([len(texts[i].encode()) + 1 for i in part])])
        cols: dict[str, list] = {"hits": [], "starts": [], "ends": [], "items": []}
        for d in range(len(part)):
            own = np.flatnonzero(covered[first[d] : first[d + 1]])
            cols["hits"].append(own.tolist())
            g = own + first[d]
            cols["starts"].append((starts[g] - base[d]).tolist())
            cols["ends"].append((ends[g] - base[d]).tolist())
            cols["items"].append(sorted(found[d]))
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(part)), pa.array(np.diff(first), pa.int64())] + [pa.array(cols[c], pa.list_(pa.int64())) for c in ("hits", "starts", "ends")] + [pa.array(cols["items"], pa.list_(pa.string()))],
            names=["doc_id", "n_words", "hits", "starts", "ends", "items"],
        )


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES):
    """The items in blocks of at most ``block_bytes`` (or one item): the driver holds one block at a time."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    block, held = [], 0
    for r in rows.toLocalIterator():
        if block and held + len(r["text"]) > block_bytes:
            yield block
            block, held = [], 0
        block.append((r["item"], r["text"]))
        held += len(r["text"])
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, hits (numbers of the hit words), starts and ends (their UTF-8 byte spans), items (sorted ids).

    One row for each row of ``docs``, however many blocks the benchmark needs. With several, rows are numbered in a
    staged copy, and what the blocks hit is added up by that number; rows without a hit don't shuffle but once.
    """
    blocks = item_blocks(benchmark, block_bytes=block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return scan(text_rows(docs), first, n)
    rows = stage(text_rows(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
    numbered = rows.select(F.col("row").alias("doc_id"), "text")
    whole = scan(numbered, first, n)
    for block in chain([second], blocks):
        whole = whole.unionByName(scan(numbered, block, n, only_hits=True))
    merge = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    merged = whole.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), *[merge(c) for c in ("hits", "starts", "ends", "items")])
    return rows.select("doc_id", "row").join(merged.withColumnRenamed("doc_id", "found"), F.col("row") == F.col("found")).drop("row", "found")


def report(found: DataFrame) -> DataFrame:
    """The digest of each document's hits."""
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the contaminated documents: one map-side filter for each block of the benchmark, no shuffle."""
    at = docs.columns.index(text_col)
    for block in item_blocks(benchmark, block_bytes=block_bytes):
        held = docs.sparkSession.sparkContext.broadcast(item_windows(block, n))

        def kept(batches, held=held):
            for b in batches:
                texts = b.column(at).fill_null("") if b.column(at).null_count else b.column(at)
                rows = pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), texts], names=["doc_id", "text"])
                keep = np.ones(b.num_rows, np.bool_)
                for out in _scan(rows, held.value):
                    keep[[i for i, hits in zip(out["doc_id"].to_pylist(), out["hits"].to_pylist(), strict=True) if hits]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(kept, docs.schema)
    return docs
