"""Exact substring de-duplication of bytes by prefix-free parsing.

Every string of ``length`` bytes holds the least rolling hash of its ``GRAM``-byte parts; that part is its trigger.
Consecutive strings with one trigger form a phrase, so phrases overlap, cover the text, and depend on content alone:
equal strings lie in phrases of equal trigger, in any two documents. Phrases whose trigger only one document has cannot
repeat; the others make the dictionary, which holds a repeated phrase once for each block of documents. A bucket of the
dictionary then takes the phrases of its triggers, and where a trigger has phrases that differ, sorts their suffixes by
content (a suffix array cut at ``length``). Equal suffixes get the smallest document of the parse, that is of all phrases
they occur in; it decides what goes. Whole bytes are compared; hashes only choose candidates.

Edge cases: a null text is empty; texts shorter than ``length`` stay whole; rows that repeat an id are not each other's
copies, as neither id is smaller; null ids count as larger than all others and give a null id; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltern.llm.blocks import ANSWERED, ASKED, Block, answers, answers_of, bucket_slices, pack_table, per_block, shared_names, spread, stage_blocks, unpack_table
from saltern.llm.common import mix

LENGTH = 50
#: Bytes of a trigger.
GRAM = 24
_CHUNK = 1 << 16
_A, _B, _C = (np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))
_ONE, _S32 = np.uint64(1), np.uint64(32)

KEPT = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long"


def _slide_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, at the first of them."""
    have = 1
    while have < width:
        step = min(have, width - have)
        a = np.minimum(a[: len(a) - step], a[step:])
        have += step
    return a


def triggers(buf: np.ndarray, n: int, length: int) -> np.ndarray:
    """For each of the first ``n`` starts, the least hash of the string of ``length`` bytes there. ``buf`` is padded."""
    out = np.empty(n, np.uint64)
    for lo in range(0, n, _CHUNK):
        m = min(_CHUNK, n - lo) + length - GRAM
        part = np.ascontiguousarray(buf[lo : lo + m + GRAM])
        load = lambda o: np.ndarray((m,), "<u8", part, o, (1,)).astype(np.uint64)  # noqa: B023, E731
        h = load(0) * _A
        h ^= h >> _S32
        h += load(8)
        h *= _B
        h ^= h >> _S32
        h += load(16)
        h *= _C
        out[lo : lo + _CHUNK] = _slide_min(mix(h), length - GRAM + 1)
    return out


class Parse:
    """A block's phrases: first string start, count of strings, document number and name of each."""

    def __init__(self, block: Block, length: int):
        self.block = block
        sizes = np.array([len(t) for t in block.texts], np.int64)
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        n = int(self.at[-1])
        self.raw = b"".join([*block.texts, bytes(length + 64)])
        least = triggers(np.frombuffer(self.raw, np.uint8), n, length)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        valid = np.arange(n) + length <= self.at[1:][doc]
        new = np.ones(n, np.bool_)
        new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new & valid)
        edge = np.flatnonzero(np.concatenate([new | ~valid, [True]]))
        self.first = first
        self.count = edge[np.searchsorted(edge, first, "right")] - first if len(first) else first
        self.doc = doc[first]
        self.name = mix(least[first] * _C) | _ONE  # mixed anew: least values crowd at the low end

    def distinct(self) -> np.ndarray:
        return np.unique(self.name)

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Phrases whose name another block has, or another document of this block."""
        names, of = np.unique(self.name, return_inverse=True)
        ids = self.block.ids[self.doc]
        low, high = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), np.iinfo(np.int64).min)
        np.minimum.at(low, of, ids)
        np.maximum.at(high, of, ids)
        return np.flatnonzero((shared | (low < high))[of])


class Dictionary:
    """The distinct candidate phrases of a block, by bucket, each with its smallest document."""

    def __init__(self, parse: Parse, shared: np.ndarray, length: int, log2: int):
        own = parse.candidates(shared)
        raw = parse.raw
        spans = zip(parse.first[own].tolist(), (parse.first[own] + parse.count[own] + length - 1).tolist(), strict=True)
        entry: dict[bytes, int] = {}
        self.of = np.fromiter((entry.setdefault(raw[a:b], len(entry)) for a, b in spans), np.int64, len(own))
        self.own, self.phrases = own, list(entry)
        leader = np.zeros(len(entry), np.int64)
        leader[self.of[::-1]] = own[::-1]  # documents ascend, so the first phrase has the smallest
        self.doc = parse.block.ids[parse.doc[leader]] if len(leader) else leader
        self.count = parse.count[leader] if len(leader) else leader
        self.name = parse.name[leader] if len(leader) else leader.astype(np.uint64)
        bucket = self.name >> np.uint64(64 - log2)
        self.order = np.lexsort((np.arange(len(bucket)), self.doc, bucket))  # by bucket, then document
        self.slices = list(bucket_slices(self.name[self.order], log2))


def _ask(block_id: int, block: Block, answered: pa.Table, length: int, log2: int) -> pa.Table:
    parse = Parse(block, length)
    shared = spread(parse.distinct(), answers_of(answered, 1), log2)
    d = Dictionary(parse, shared, length, log2)
    rows = []
    for bucket, s in d.slices:
        own = d.order[s]
        t = pa.table({"doc": pa.array(d.doc[own]), "name": pa.array(d.name[own].astype(np.uint32)), "phrase": pa.array([d.phrases[k] for k in own.tolist()], pa.binary())})
        rows.append((bucket, block_id, pack_table(t)))
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([r[1] for r in rows], pa.int64()), "asked": pa.array([r[2] for r in rows], pa.binary())})


def suffix_classes(text: bytes, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts in the order of the ``length`` bytes there, and where in that order a new string begins."""
    buf = np.frombuffer(text + bytes(8), np.uint8)
    keys = [np.ndarray((len(buf) - 7,), ">u8", buf, 0, (1,))[starts + min(o, length - 8)].astype(np.uint64) for o in range(0, length, 8)]
    order = np.lexsort(keys[::-1])
    new = np.ones(len(starts), np.bool_)
    new[1:] = False
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, new


def _answer(t: pa.Table, length: int) -> pa.Table:
    parts = [unpack_table(x.as_py()) for x in t["asked"]]
    phrases = [p for x in parts for p in x["phrase"].to_pylist()]
    doc = np.concatenate([x["doc"].to_numpy() for x in parts])
    name = np.concatenate([x["name"].to_numpy() for x in parts])
    entry: dict[bytes, int] = {}
    of = np.fromiter((entry.setdefault(p, len(entry)) for p in phrases), np.int64, len(phrases))
    least = np.full(len(entry), np.iinfo(np.int64).max)
    np.minimum.at(least, of, doc)
    entry_name = np.zeros(len(entry), name.dtype)
    entry_name[of] = name
    count = np.fromiter((len(p) - length + 1 for p in entry), np.int64, len(entry))
    at = np.concatenate([[0], np.cumsum(count)])
    smallest = np.repeat(least, count)  # of each string of each phrase
    # strings of one trigger in phrases that differ: sort their suffixes
    _, group, size = np.unique(entry_name, return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(size[group] > 1)
    if len(mixed):
        texts = list(entry)
        text = b"".join(texts[k] for k in mixed.tolist())
        lengths = count[mixed] + length - 1
        base = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        within = np.arange(count[mixed].sum()) - np.repeat(np.cumsum(count[mixed]) - count[mixed], count[mixed])
        order, new = suffix_classes(text, np.repeat(base, count[mixed]) + within, length)
        where = np.repeat(at[:-1][mixed], count[mixed]) + within
        first = np.flatnonzero(new)
        found = np.minimum.reduceat(smallest[where][order], first)
        smallest[where[order]] = np.repeat(found, np.diff(np.append(first, len(order))))
    sizes = count[of]
    pick = np.repeat(at[:-1][of], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    bits = smallest[pick] < np.repeat(doc, sizes)
    edges = np.cumsum([0] + [len(x) for x in parts])
    total = np.concatenate([[0], np.cumsum(sizes)])
    return answers(t, bits, np.diff(total[edges]).tolist(), 2)


def _finish(block: Block, answered: pa.Table, length: int, log2: int) -> pa.Table:
    parse = Parse(block, length)
    shared = spread(parse.distinct(), answers_of(answered, 1), log2)
    d = Dictionary(parse, shared, length, log2)
    replies = answers_of(answered, 2)
    # bits of each dictionary entry, in the order in which they were asked
    at = np.zeros(len(d.phrases) + 1, np.int64)
    sizes = d.count[d.order]
    flat = np.zeros(int(sizes.sum()), np.bool_)
    total = np.concatenate([[0], np.cumsum(sizes)])
    for bucket, s in d.slices:
        lo, hi = int(total[s.start]), int(total[s.stop])
        flat[lo:hi] = replies[bucket][: hi - lo]
    at[d.order] = total[:-1]
    n = int(parse.at[-1])
    starts = np.zeros(n + 1, np.bool_)
    own, count = d.own, parse.count[d.own]
    later = parse.block.ids[parse.doc[own]] > d.doc[d.of] if len(own) else np.zeros(0, np.bool_)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    flag = flat[np.repeat(at[d.of], count) + within] | np.repeat(later, count) if len(own) else np.zeros(0, np.bool_)
    starts[(np.repeat(parse.first[own], count) + within)[flag]] = True
    hit = np.flatnonzero(starts)
    cover = np.zeros(n + 1, np.int32)
    np.add.at(cover, hit, 1)
    np.subtract.at(cover, hit + length, 1)
    gone = np.cumsum(cover[:-1]) > 0
    buf = np.frombuffer(parse.raw, np.uint8)
    kept, removed, spans = [], [], []
    for k, text in enumerate(block.texts):
        g = gone[parse.at[k] : parse.at[k + 1]]
        m = int(g.sum())
        removed.append(m)
        spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if m else 0)
        kept.append(buf[parse.at[k] : parse.at[k + 1]][~g].tobytes() if m else text)
    ids = pa.array(block.ids, mask=~block.present)
    return pa.table({"doc_id": ids, "kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(np.diff(parse.at)), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64())})


def remove_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int | None = None) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans (maximal removed runs)."""
    blocks, log2 = stage_blocks(docs, block_bytes) if block_bytes else stage_blocks(docs)
    shared = shared_names(blocks, lambda b: Parse(b, length).distinct(), log2)
    asked = per_block(blocks, shared, lambda k, b, t: _ask(k, b, t, length, log2), ASKED)
    found = asked.groupBy("bucket").applyInArrow(lambda t: _answer(t, length), ANSWERED)
    return per_block(blocks, shared.union(found), lambda k, b, t: _finish(b, t, length, log2), KEPT)


def report(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
