"""Exact removal of repeated word windows by recompression.

Words are named by hashes of their bytes. Round by round, the inner part of each run of equal symbols gets one name, and
so does each adjacent pair whose left symbol falls in the left half and whose right symbol in the right half of a split
that the symbols' own hashes decide. A name is a hash of its parts, so it is the same in every document without a shared
list of names. Whether a symbol forms depends on its context alone: its own words and, next to runs, the neighbours
that bound the run. Hence equal windows hold equal symbols wherever a symbol's context lies inside them.

A window is known by the symbol of the last round whose context it holds. Windows whose symbol occurs once are unique;
the others are compared whole, by 96-bit fingerprints of their words and within the bucket of their symbol. The first
one by document and start stays, and the words that later ones cover go.

Edge cases: a null text has no words; texts of fewer words than a window stay whole; rows that repeat an id are not each
other's copies, as neither id is smaller; null ids count as larger than all others and give a null id; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltern.llm.blocks import ANSWERED, ASKED, Block, answers, answers_of, bucket_slices, per_block, shared_names, spread, stage_blocks
from saltern.llm.common import SPACE_TABLE, hash_words, mix, padded, word_spans

WINDOW = 20
ROUNDS = 10
_P, _Q, _R = (np.uint64(x) for x in (0x9FB21C651E98DF25, 0xA24BAED4963EE407, 0x9E3779B97F4A7C15))
_TOP = np.uint64(63)

KEPT = "doc_id long, kept string, n_words long, n_removed long"


class Symbols:
    """One round's symbols of a block: name, words [start, end), context [low, high), and whether it is new."""

    def __init__(self, name, start, end, low, high, doc):
        self.name, self.start, self.end, self.low, self.high, self.doc = name, start, end, low, high, doc

    def take(self, at):
        return Symbols(*(x[at] for x in (self.name, self.start, self.end, self.low, self.high, self.doc)))


def sides(name: np.ndarray) -> np.ndarray:
    """The side of a pair that a symbol may be, the same in all rounds: what it may join never depends on its far neighbour."""
    return mix(name * _R) >> _TOP


def _reach(low: np.ndarray, leans: np.ndarray, began: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """How far the context reaches of a symbol and, where it ``leans``, of those before it up to one that doesn't.

    ``began`` marks a document's first symbol, before which anything could be: ``outside``.
    """
    low = np.where(leans & began, outside, low)
    stretch = np.cumsum(~leans | began) * (2 * int(np.abs(low).max(initial=0)) + 4)
    return np.minimum.accumulate(low - stretch) + stretch


def compress_runs(s: Symbols, level: int, fresh: np.ndarray) -> tuple[Symbols, np.ndarray]:
    """Runs of four or more equal symbols: all but the first and the last become one. Also, which symbols are new.

    Only ``fresh`` symbols, made since the last call, start runs; what is left of earlier ones has its context already,
    and their neighbours may have grown past a window since.
    """
    n = len(s.name)
    same = np.zeros(n + 1, np.bool_)  # symbol i equals symbol i - 1
    same[1:n] = (s.name[1:] == s.name[:-1]) & (s.doc[1:] == s.doc[:-1]) & fresh[1:]
    if not same.any():
        return s, np.zeros(n, np.bool_)
    # the ends of a run are ends only as their outer neighbours differ, so these join the context, as far as they
    # could be other symbols elsewhere: one that is older and was free to join its own outer neighbour stands only as that
    # one gave it no occasion
    side, began, ended = sides(s.name), np.ones(n, np.bool_), np.ones(n, np.bool_)
    began[1:] = ended[:-1] = s.doc[1:] != s.doc[:-1]
    far_low = _reach(s.low, ~fresh & (side == 1), began, s.start - 1)
    far_high = -_reach(-s.high[::-1], (~fresh & (side == 0))[::-1], ended[::-1], -(s.end + 1)[::-1])[::-1]
    first = np.flatnonzero(same[1:] & ~same[:-1])
    last = np.flatnonzero(same[:-1] & ~same[1:])
    low, high = s.low.copy(), s.high.copy()
    before_at, after_at = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
    before = (first > 0) & (s.doc[before_at] == s.doc[first])
    after = (last + 1 < n) & (s.doc[after_at] == s.doc[last])
    low[first] = np.minimum(low[first], np.where(before, far_low[before_at], s.start[first] - 1))
    high[first] = np.maximum(high[first], np.where(before, s.high[before_at], 0))
    low[last] = np.minimum(low[last], np.where(after, s.low[after_at], s.start[last]))
    high[last] = np.maximum(high[last], np.where(after, far_high[after_at], s.end[last] + 1))
    size = last - first + 1
    # the middle of a run of three stays only as the run is no longer, so it depends on both ends
    three = first[size == 3]
    low[three + 1], high[three + 1] = low[three], high[three + 2]
    long = size >= 4
    f, e = first[long], last[long]
    keep = np.ones(n, np.bool_)
    inner = np.zeros(n + 1, np.int32)
    inner[f + 2] += 1
    inner[e] -= 1
    keep[np.cumsum(inner[:-1]) > 0] = False  # all inner symbols but the first, which stands for them
    name, end = s.name.copy(), s.end.copy()
    name[f + 1] = mix(s.name[f] * _P + (size[long] - 2).astype(np.uint64) * _Q + np.uint64(level))
    end[f + 1] = s.end[e - 1]
    low[f + 1], high[f + 1] = low[f], high[e]
    new = np.zeros(n, np.bool_)
    new[f + 1] = True
    return Symbols(name, s.start, end, low, high, s.doc).take(keep), new[keep]


def compress_pairs(s: Symbols, level: int, _: np.ndarray) -> tuple[Symbols, np.ndarray]:
    """Adjacent symbols of the left and the right half of this round's split become one. Also, which symbols are new."""
    n = len(s.name)
    side = sides(s.name)
    left = np.zeros(n, np.bool_)
    left[:-1] = (side[:-1] == 0) & (side[1:] == 1) & (s.doc[1:] == s.doc[:-1])
    at = np.flatnonzero(left)
    keep = np.ones(n, np.bool_)
    keep[at + 1] = False
    name, end, low, high = s.name.copy(), s.end.copy(), s.low.copy(), s.high.copy()
    name[at] = mix((s.name[at] * _P) ^ (s.name[at + 1] * _Q) ^ np.uint64(level))
    end[at] = s.end[at + 1]
    low[at] = np.minimum(s.low[at], s.low[at + 1])
    high[at] = np.maximum(s.high[at], s.high[at + 1])
    return Symbols(name, s.start, end, low, high, s.doc).take(keep), left[keep]


def window_symbols(words: np.ndarray, doc: np.ndarray, valid: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start: the name it is known by, and the number of that symbol's occurrence (-1: not valid)."""
    n = len(words)
    name = mix(words * _R)
    occurrence = np.arange(n)
    made = n
    at = np.arange(n)
    s = Symbols(words.copy(), at, at + 1, at, at + 1, doc)
    new = np.ones(n, np.bool_)
    for level in range(ROUNDS):
        for step in (compress_runs, compress_pairs):
            if len(s.name) < 2:
                break
            s, new = step(s, level, new)
            own = np.flatnonzero(new & (s.high - s.low <= window) & (s.low >= 0) & (s.high <= n))
            if not len(own):
                continue
            # of this round's symbols whose context a window holds, the one whose context ends first
            if (s.low[own[1:]] < s.low[own[:-1]]).any():  # contexts next to runs can start before their neighbours'
                own = own[np.argsort(s.low[own], kind="stable")]
            m = len(own)
            ends = np.minimum.accumulate((s.high[own] * m + np.arange(m - 1, -1, -1))[::-1])[::-1]
            before = np.zeros(n + 1, np.int64)
            before[1:] = np.cumsum(np.bincount(s.low[own], minlength=n)[:n])
            pick = before[:n]  # symbols whose context starts before the window
            some = pick < m
            k = own[m - 1 - ends[np.minimum(pick, m - 1)] % m]
            some &= s.high[k] <= at + window
            some &= valid
            name[some] = mix(s.name[k[some]] * _R + np.uint64(level + 1))
            occurrence[some] = made + k[some]
            made += len(s.name)
    occurrence[~valid] = -1
    return name, occurrence


def window_prints(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 more bits for each ``window`` consecutive words, in two unlike ways (meaningless past a document's end)."""
    n = len(words)
    out = []
    for base, start in ((_P, words), (_Q, mix(words * _P))):
        h = np.zeros(n, np.uint64)
        for k in range(window):
            h *= base
            h[: n - k] += start[k:]
        out.append(mix(h))
    return out[0], out[1].astype(np.uint32)


class Parse:
    """A block's words and the name of each window."""

    def __init__(self, block: Block, window: int):
        self.block, self.window = block, window
        sizes = np.array([len(t) + 1 for t in block.texts], np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        buf = padded([x for t in block.texts for x in (t, b"\n")])
        starts, ends = word_spans(buf, int(at[-1]), SPACE_TABLE)
        self.words = hash_words(buf, starts, ends)
        self.first = np.searchsorted(starts, at)
        self.doc = np.repeat(np.arange(len(block.texts)), np.diff(self.first))
        n = len(self.words)
        self.valid = np.arange(n) + window <= self.first[1:][self.doc]
        self.name, self.occurrence = window_symbols(self.words, self.doc, self.valid, window)
        self.starts = np.flatnonzero(self.valid)

    def distinct(self) -> np.ndarray:
        return np.unique(self.name[self.starts])

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Starts of windows whose symbol another block has, or this block twice."""
        names, of = np.unique(self.name[self.starts], return_inverse=True)
        own = self.occurrence[self.starts]
        low, high = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), np.iinfo(np.int64).min)
        np.minimum.at(low, of, own)
        np.maximum.at(high, of, own)
        return self.starts[(shared | (low < high))[of]]


class Windows:
    """A block's distinct candidate windows by bucket and document, and how each candidate relates to them."""

    def __init__(self, parse: Parse, shared: np.ndarray, log2: int):
        own = parse.candidates(shared)
        one, two = window_prints(parse.words, parse.window)
        name, one, two, row = parse.name[own], one[own], two[own], parse.doc[own]
        order = np.lexsort((own, two, one, name))  # starts ascend with the document, documents with the id
        differ = lambda x: x[order][1:] != x[order][:-1]
        new = np.ones(len(own), np.bool_)
        new[1:] = differ(name) | differ(one) | differ(two)
        leader = order[new]
        of = np.empty(len(own), np.int64)
        of[order] = np.cumsum(new) - 1
        ids = parse.block.ids[row] if len(own) else own
        doc = ids[leader]
        again = np.zeros(len(own), np.bool_)
        again[order[1:]] = ~new[1:] & ~differ(row)  # earlier in the same row
        self.own, self.of, self.later = own, of, again | (ids > doc[of] if len(own) else again)
        bucket = name[leader] >> np.uint64(64 - log2)
        self.order = np.lexsort((doc, bucket))
        self.doc, self.one, self.two = doc[self.order], one[leader][self.order], two[leader][self.order]
        self.slices = list(bucket_slices(name[leader][self.order], log2))


def _runs(doc: np.ndarray) -> bytes:
    """Ascending documents as (id, count) pairs."""
    edge = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1, [len(doc)]])
    return np.stack([doc[edge[:-1]], np.diff(edge)]).astype("<i8").tobytes()


def _ask(block_id: int, block: Block, answered: pa.Table, window: int, log2: int) -> pa.Table:
    parse = Parse(block, window)
    w = Windows(parse, spread(parse.distinct(), answers_of(answered, 1), log2), log2)
    rows = []
    for bucket, s in w.slices:
        runs = _runs(w.doc[s])
        rows.append((bucket, block_id, len(runs).to_bytes(8, "little") + runs + w.one[s].tobytes() + w.two[s].tobytes()))
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([r[1] for r in rows], pa.int64()), "asked": pa.array([r[2] for r in rows], pa.binary())})


def _read(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = int.from_bytes(raw[:8], "little")
    ids, counts = np.frombuffer(raw[8 : 8 + size], "<i8").reshape(2, -1)
    n = int(counts.sum())
    body = raw[8 + size :]
    return np.repeat(ids, counts), np.frombuffer(body[: 8 * n], "<u8"), np.frombuffer(body[8 * n :], "<u4")


def _answer(t: pa.Table) -> pa.Table:
    parts = [_read(x.as_py()) for x in t["asked"]]
    doc, one, two = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.lexsort((two, one))
    new = np.ones(len(order), np.bool_)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    first = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(order))))
    bits = np.zeros(len(order), np.bool_)
    bits[order] = least < doc[order]
    return answers(t, bits, [len(p[0]) for p in parts], 2)


def _finish(block: Block, answered: pa.Table, window: int, log2: int) -> pa.Table:
    parse = Parse(block, window)
    w = Windows(parse, spread(parse.distinct(), answers_of(answered, 1), log2), log2)
    replies = answers_of(answered, 2)
    earlier = np.zeros(len(w.order), np.bool_)
    for bucket, s in w.slices:
        earlier[w.order[s]] = replies[bucket][: s.stop - s.start]
    hit = w.own[w.later | earlier[w.of]] if len(w.own) else w.own
    n = len(parse.words)
    cover = np.zeros(n + 1, np.int32)
    np.add.at(cover, hit, 1)
    np.subtract.at(cover, hit + window, 1)
    stays = ~(np.cumsum(cover[:-1]) > 0)
    kept, removed = [], []
    for k, text in enumerate(block.texts):
        own = stays[parse.first[k] : parse.first[k + 1]]
        gone = len(own) - int(own.sum())
        words = text.split()
        kept.append(b" ".join(compress(words, own.tolist()) if gone else words).decode())
        removed.append(gone)
    ids = pa.array(block.ids, mask=~block.present)
    return pa.table({"doc_id": ids, "kept": pa.array(kept, pa.string()), "n_words": pa.array(np.diff(parse.first)), "n_removed": pa.array(removed, pa.int64())})


def remove_repeats(docs: DataFrame, window: int = WINDOW, block_bytes: int | None = None) -> DataFrame:
    """doc_id, kept (the remaining words, joined by one space), n_words, n_removed."""
    blocks, log2 = stage_blocks(docs, block_bytes) if block_bytes else stage_blocks(docs)
    shared = shared_names(blocks, lambda b: Parse(b, window).distinct(), log2)
    asked = per_block(blocks, shared, lambda k, b, t: _ask(k, b, t, window, log2), ASKED)
    found = asked.groupBy("bucket").applyInArrow(_answer, ANSWERED)
    return per_block(blocks, shared.union(found), lambda k, b, t: _finish(b, t, window, log2), KEPT)


def report(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
