"""Ranked search: documents reordered by recursive graph bisection, and clusters visited by their bound until none can matter.

Recursive bisection splits documents in halves and swaps them as long as that shortens the logarithmic gaps of their terms' lists.
Its upper levels are fitted on a sample of about ``SAMPLE`` documents with up to ``SAMPLE_TERMS`` terms each, chosen by hash;
every document then goes down that tree to a leaf. A leaf is cut into shards of about ``SHARD_BYTES`` of text, and within its
shard the bisection goes on over all documents and terms, down to clusters of ``CLUSTER``. The order decides the speed alone: results
are exact for any.

A shard is a row: its terms with their document counts and greatest impacts, and the lists (document, impact) by term,
with the greatest impact in each cluster. An item's bound in a shard is the sum of its terms' weights by their greatest
impacts. Shards are visited by descending bound, in rounds of growing numbers; an item is done as soon as no other shard's
bound reaches the last of its ``k`` best scores (equal counts as reaching, as ties go to the smaller doc_id). Within a
shard, clusters are left out by the same rule. Items come in blocks of bounded text, which are what is broadcast.

Edge cases: a null text has no terms; a document without terms isn't counted and never found; items without an id or a
text aren't asked, an item without terms or without a found term has no rows; rows that repeat an item id are asked each for
itself; rows that repeat a doc_id are documents of their own; a null doc_id goes after all others; empty tables give no
rows; other columns are ignored, whatever their names. Terms are known by 64-bit hashes of their bytes. A document has to
fit in a task.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saltern.llm.common import small_batches, stage, text_rows
from saltern.llm.decontamination import item_blocks, words_of

SAMPLE, SAMPLE_TERMS = 4096, 128
#: Documents of the sample in a leaf at least, and rounds of swaps of a bisection.
LEAF, ROUNDS = 64, 8
SHARD_BYTES = 2 << 20
CLUSTER = 64
#: Text of the items of a block, and its greatest number of visits in a round.
ITEM_BYTES, VISITS = 1 << 20, 1 << 20
#: Shards that the first round visits for an item, and how many times as many each next one.
FIRST, GROWTH = 4, 4
#: Clusters of a shard that are scored before the others are held against what they gave.
AHEAD = 4
#: The place of a null id in the order of ids: after all others.
NULL_ID = (1 << 63) - 1

_ARRAYS = {"terms": "<u8", "df": "<i4", "most": "<i4", "head": "<i4", "cluster": "<i4", "greatest": "<i4", "at": "<i4", "doc": "<i4", "impact": "<i4", "ids": "<i8"}
SHARD = "shard long, " + ", ".join(f"{c} binary" for c in _ARRAYS)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of consecutive ranges."""
    size = size.astype(np.int64)
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def bisect(start: np.ndarray, term: np.ndarray, docs: np.ndarray, n_terms: int, rounds: int = ROUNDS):
    """Which of ``docs`` go left, the terms that two have, and in how many documents each of these is on either side.

    ``term`` has the terms of document d at start[d] to start[d + 1].
    """
    size = start[docs + 1] - start[docs]
    t = term[ranges(start[docs], size)]
    own = np.repeat(np.arange(len(docs)), size)
    every = np.bincount(t, minlength=n_terms)
    used = np.flatnonzero(every > 1)  # a term of one document costs the same on both sides
    own, t = own[every[t] > 1], t[every[t] > 1]
    small = np.zeros(n_terms, np.int64)
    small[used] = np.arange(len(used))
    t, both = small[t], every[used]
    left = np.arange(len(docs)) < len(docs) // 2
    n_left, n_right = len(docs) // 2, len(docs) - len(docs) // 2
    cost = lambda a, b: a * np.log2(n_left / (a + 1)) + b * np.log2(n_right / (b + 1))
    for _ in range(rounds):
        a = np.bincount(t[left[own]], minlength=len(used))
        b = both - a
        now = cost(a, b)
        to_right, to_left = now - cost(np.maximum(a - 1, 0), b + 1), now - cost(a + 1, np.maximum(b - 1, 0))
        gain = np.bincount(own, np.where(left[own], to_right[t], to_left[t]), len(docs))
        x, y = np.flatnonzero(left), np.flatnonzero(~left)
        x, y = x[np.argsort(-gain[x], kind="stable")], y[np.argsort(-gain[y], kind="stable")]
        m = min(len(x), len(y))
        n = int((gain[x[:m]] + gain[y[:m]] > 0).sum())
        if not n:
            break
        left[x[:n]], left[y[:n]] = False, True
    a = np.bincount(t[left[own]], minlength=len(used))
    return left, used, a, both - a


def by_least_term(start: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Documents in the order of their smallest terms: alike ones begin on one side."""
    n = len(start) - 1
    least = np.full(n, np.iinfo(np.int64).max)
    some = np.flatnonzero(np.diff(start))
    if len(some):
        least[some] = np.minimum.reduceat(term, start[some])
    return np.argsort(least, kind="stable")


def reorder(start: np.ndarray, term: np.ndarray, n_terms: int, least: int = CLUSTER) -> np.ndarray:
    """All documents in the order of the recursive bisection down to ``least``."""
    todo, done = [by_least_term(start, term)], []
    while todo:
        docs = todo.pop()
        if len(docs) <= least:
            done.append(docs)
            continue
        left, _, _, _ = bisect(start, term, docs, n_terms)
        todo += [docs[~left], docs[left]]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


class Tree:
    """The upper levels: for each level, which side a term speaks for, by (node, term), and the leaves' shares of the sample."""

    def __init__(self, sample: list[np.ndarray]):
        every, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *sample]), return_counts=True)
        self.terms = every[count > 1]  # a term of one document tells no side
        doc = np.repeat(np.arange(len(sample)), [len(x) for x in sample]).astype(np.int64)
        term = _at(self.terms, np.concatenate([np.zeros(0, np.uint64), *sample]))
        start = np.searchsorted(doc[term >= 0], np.arange(len(sample) + 1))
        term = term[term >= 0]
        self.levels, nodes = [], [by_least_term(start, term)]
        while min(map(len, nodes)) >= 2 * LEAF:
            keys, says, below = [], [], []
            for k, docs in enumerate(nodes):
                left, own, a, b = bisect(start, term, docs, len(self.terms))
                keys.append(k * len(self.terms) + own)
                says.append(np.log2((a + 1) / max(1, left.sum())) - np.log2((b + 1) / max(1, (~left).sum())))
                below += [docs[left], docs[~left]]
            self.levels.append((np.concatenate(keys), np.concatenate(says).astype(np.float32)))
            nodes = below
        self.leaves = len(nodes)

    def leaf(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """The leaf of each of ``n`` documents with (doc, term), by as many of its terms as the sample has."""
        node = np.zeros(n, np.int64)
        few = np.arange(len(doc)) - np.searchsorted(doc, doc) < SAMPLE_TERMS
        doc, term = doc[few], term[few]
        if not self.levels or not len(self.terms):
            return node
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        known = self.terms[at] == term
        doc, at = doc[known], at[known]
        for keys, says in self.levels:
            want = node[doc] * len(self.terms) + at
            if not len(keys):
                node = 2 * node
                continue
            k = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            side = np.bincount(doc, np.where(keys[k] == want, says[k], 0), n)
            node = 2 * node + (side < 0)
        return node


def term_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, occurrences) of each term of each text, by document and term, and all terms of each text."""
    _, _, _, h, first = words_of(texts)
    size = np.diff(first)
    doc = np.repeat(np.arange(len(texts)), size)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), np.bool_)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h))), size


def _parts(batches, chunk: int = 1 << 20):
    """Batches cut into parts of about ``chunk`` bytes of text."""
    for b in batches:
        size = pc.binary_length(b["text"]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.cumsum(size) // chunk
        for rows in np.split(np.arange(len(size)), np.flatnonzero(np.diff(at)) + 1):
            if len(rows):
                yield b.slice(int(rows[0]), len(rows))


@dataclass
class Index:
    """``shards`` as the module says, how many documents have terms, and how many terms all have together."""

    shards: DataFrame
    n: int
    total: int


def _sample(rows: DataFrame, count: int) -> list[tuple[np.ndarray, int]]:
    """(terms, bytes of text) of about ``SAMPLE`` documents."""
    share = min(1.0, SAMPLE / max(1, count))

    def chosen(batches):
        for b in _parts(batches):
            texts = b["text"].to_pylist()
            doc, term, _, _ = term_counts(texts)
            edge = np.searchsorted(doc, np.arange(b.num_rows + 1))
            terms = [term[x : min(y, x + SAMPLE_TERMS)].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), pa.array([len(t) for t in texts], pa.int64())], names=["terms", "size"])

    picked = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(13)), F.lit(1 << 32)) < int(share * (1 << 32)))
    found = picked.select("text").mapInArrow(chosen, "terms binary, size long").collect()
    return [(np.frombuffer(r.terms, "<u8"), r.size) for r in sorted(found, key=lambda r: (r.terms, r.size)) if r.terms]


def _shard_of(ids: pa.Array, texts: list[str], n: int, total: int) -> dict[str, np.ndarray]:
    """The arrays of a shard; documents in the order of the bisection, impacts as all documents' counts make them."""
    doc, h, tf, size = term_counts(texts)
    terms, term = np.unique(h, return_inverse=True)
    start = np.searchsorted(doc, np.arange(len(texts) + 1))
    order = reorder(start, term, len(terms))
    place = np.empty(len(texts), np.int64)
    place[order] = np.arange(len(texts))
    m = np.array([25 + 75 * int(x) * n // max(1, total) for x in size], np.int64)
    impact = (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m[doc])
    doc = place[doc]
    by = np.lexsort((doc, term))
    doc, term, impact = doc[by], term[by], impact[by]
    cluster = doc // CLUSTER
    new = np.ones(len(doc), np.bool_)
    new[1:] = (term[1:] != term[:-1]) | (cluster[1:] != cluster[:-1])
    at = np.flatnonzero(new)
    head = np.searchsorted(term[at], np.arange(len(terms) + 1))
    first = np.searchsorted(term, np.arange(len(terms) + 1))
    some = len(at) > 0
    return {
        "terms": terms,
        "df": np.diff(first),
        "most": np.maximum.reduceat(impact, first[:-1]) if some else impact,
        "head": head,
        "cluster": cluster[at],
        "greatest": np.maximum.reduceat(impact, at) if some else impact,
        "at": np.append(at, len(doc)),
        "doc": doc,
        "impact": impact,
        "ids": ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False)[order],
    }


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Every document in shards in the shared folder."""
    rows = text_rows(docs, id_col, text_col)

    def sized(batches):
        for b in _parts(batches):
            texts = b["text"].to_pylist()
            size = np.diff(words_of(texts)[4])
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (len(size), int((size > 0).sum()), int(size.sum()), sum(len(t.encode()) for t in texts))], names=["every", "n", "total", "size"])

    with small_batches(docs.sparkSession):
        sums = rows.mapInArrow(sized, "every long, n long, total long, size long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("every", "n", "total", "size")]).first()
        sample = _sample(rows, sums["every"])
        terms = [x for x, _ in sample]
        tree = Tree(terms)
        leaf = tree.leaf(np.repeat(np.arange(len(terms)), [len(x) for x in terms]).astype(np.int64), np.concatenate([np.zeros(0, np.uint64), *terms]), len(terms))
        share = np.bincount(leaf, [size + 1 for _, size in sample], tree.leaves) if sample else np.ones(1)
        # a leaf's share of the sample says into how many shards it is cut
        cuts = np.maximum(1, np.ceil(share / share.sum() * sums["size"] / SHARD_BYTES)).astype(np.int64)
        first = np.cumsum(cuts) - cuts
        held = docs.sparkSession.sparkContext.broadcast((tree, cuts, first))

        def dealt(batches):
            tree, cuts, first = held.value
            for b in _parts(batches):
                doc, term, _, _ = term_counts(b["text"].to_pylist())
                leaf = tree.leaf(doc, term, b.num_rows)
                shard = first[leaf] + (b["hash"].to_numpy().view(np.uint64) % cuts[leaf].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shard), b["doc_id"], b["text"]], names=["shard", "doc_id", "text"])

        n, total = int(sums["n"]), int(sums["total"])

        def built(t: pa.Table) -> pa.Table:
            arrays = _shard_of(t["doc_id"].combine_chunks(), t["text"].to_pylist(), n, total)
            return pa.table({"shard": t["shard"].slice(0, 1), **{c: pa.array([arrays[c].astype(kind).tobytes()], pa.binary()) for c, kind in _ARRAYS.items()}})

        numbered = rows.withColumn("hash", F.xxhash64("doc_id", "text", F.lit(7))).mapInArrow(dealt, "shard long, doc_id long, text string")
        return Index(stage(numbered.groupBy("shard").applyInArrow(built, SHARD), "shards"), n, total)


def _read(b: pa.RecordBatch, k: int, names) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(b[c][k].as_py(), _ARRAYS[c]) for c in names}


def _at(terms: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted term among the shard's, -1 if it isn't there."""
    if not len(terms):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    return np.where(terms[at] == wanted, at, -1)


class Asked:
    """The items of a block: their distinct terms, and for each item its terms by place with weights."""

    def __init__(self, texts: list[str]):
        _, _, _, h, first = words_of(texts)
        counts = [Counter(h[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)]
        self.terms = np.unique(h)
        self.start = np.cumsum([0] + [len(c) for c in counts])
        self.term = np.searchsorted(self.terms, np.array([t for c in counts for t in c], np.uint64))
        self.repeats = np.array([n for c in counts for n in c.values()], np.int64)

    def weigh(self, df: dict[int, int], n: int) -> None:
        weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(k, 0) + 1))) for k in range(len(self.terms))]
        self.weight = np.array(weight, np.int64)[self.term] * self.repeats

    def bounds(self, terms: np.ndarray, most: np.ndarray) -> np.ndarray:
        at = _at(terms, self.terms)[self.term]
        part = np.where(at >= 0, most[np.maximum(at, 0)].astype(np.int64) if len(most) else 0, 0) * self.weight
        whole = np.concatenate([[0], np.cumsum(part)])
        return whole[self.start[1:]] - whole[self.start[:-1]]

    def best(self, item: int, s: dict[str, np.ndarray], place: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the item's ``k`` best documents of a shard with a score of at least ``least``."""
        own = slice(self.start[item], self.start[item + 1])
        term, weight = place[self.term[own]], self.weight[own]
        there = (term >= 0) & (weight > 0)
        term, weight = term[there], weight[there]
        size = s["head"][term + 1] - s["head"][term]
        heads, by = ranges(s["head"][term], size), np.repeat(weight, size)
        bound = np.zeros(len(s["ids"]) // CLUSTER + 1, np.int64)
        np.add.at(bound, s["cluster"][heads], s["greatest"][heads] * by)
        order = np.argsort(-bound, kind="stable")
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part in (order[:AHEAD], order[AHEAD:]):
            wanted = np.zeros(len(bound), np.bool_)
            wanted[part[bound[part] >= max(1, least)]] = True
            mine = wanted[s["cluster"][heads]]
            if not mine.any():
                continue
            h, w = heads[mine], by[mine]
            n = s["at"][h + 1] - s["at"][h]
            postings = ranges(s["at"][h], n)
            score = np.zeros(len(s["ids"]), np.int64)
            np.add.at(score, s["doc"][postings], s["impact"][postings] * np.repeat(w, n))
            found = np.flatnonzero(score >= max(1, least))
            ids, scores = np.append(ids, s["ids"][found]), np.append(scores, score[found])
            top = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[top], scores[top]
            if len(ids) == k:
                least = max(least, int(scores[-1]))
        return ids, scores


def _search_block(index: Index, texts: list[str], k: int) -> DataFrame:
    """(item, doc_id, score, rank) of the items of one block, known by their places."""
    spark = index.shards.sparkSession
    asked = Asked(texts)
    wanted = spark.sparkContext.broadcast(asked.terms)

    def frequencies(batches):
        total = np.zeros(len(wanted.value), np.int64)
        for b in batches:
            for j in range(b.num_rows):
                s = _read(b, j, ("terms", "df"))
                at = _at(s["terms"], wanted.value)
                total[at >= 0] += s["df"][at[at >= 0]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    # a row for each term of the block, whose text is bounded
    asked.weigh({r.term: r.df for r in index.shards.select("terms", "df").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}, index.n)
    held = spark.sparkContext.broadcast(asked)

    def bounded(batches):
        for b in batches:
            for j in range(b.num_rows):
                s = _read(b, j, ("terms", "most"))
                bound = held.value.bounds(s["terms"], s["most"])
                some = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([b["shard"][j].as_py()] * len(some), pa.int64()), pa.array(bound[some])], names=["item", "shard", "bound"])

    bounds = index.shards.select("shard", "terms", "most").mapInArrow(bounded, "item long, shard long, bound long")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "shard")
    bounds = stage(bounds.withColumn("place", F.row_number().over(order) - 1), "bounds")

    def visited(batches):
        for b in batches:
            for j in range(b.num_rows):
                s = _read(b, j, _ARRAYS)
                place = _at(s["terms"], held.value.terms)
                found = [(v["item"], *held.value.best(v["item"], s, place, v["least"], k)) for v in b["visits"][j].as_py()]
                item = np.concatenate([np.full(len(x), i, np.int64) for i, x, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.concatenate([x for _, x, _ in found])), pa.array(np.concatenate([y for _, _, y in found]))], names=["item", "doc_id", "score"])

    most = max(1, VISITS // max(1, len(texts)))
    lo, hi, best = 0, min(FIRST, most), spark.createDataFrame([], "item long, doc_id long, score long, rank int")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    while True:
        least = best.where(F.col("rank") == k).select("item", F.col("score").alias("least"))
        todo = bounds.where((F.col("place") >= lo) & (F.col("place") < hi)).join(least, "item", "left").withColumn("least", F.coalesce("least", F.lit(1)))
        todo = todo.where("bound >= least").groupBy("shard").agg(F.collect_list(F.struct("item", "least")).alias("visits"))
        todo = stage(todo, "visits")  # at most VISITS of them, for the broadcast
        if todo.isEmpty():  # an item's bounds descend, so no later one reaches its least either
            break
        found = index.shards.join(F.broadcast(todo), "shard").mapInArrow(visited, "item long, doc_id long, score long")
        best = stage(best.drop("rank").unionByName(found).withColumn("rank", rank).where(F.col("rank") <= k), "best")
        lo, hi = hi, hi + min(most, (GROWTH - 1) * hi)
    return best


def search(index: Index, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of each item's ``k`` best documents with a score above zero."""
    spark = index.shards.sparkSession
    kind = items.schema[id_col].dataType
    out = spark.createDataFrame([], "item_id string, rank int, doc_id long, score long")
    for block in item_blocks(items, id_col, text_col, item_bytes):
        names = F.broadcast(spark.createDataFrame([(k, name) for k, (name, _) in enumerate(block)], "item long, item_id string"))
        with small_batches(spark):
            best = _search_block(index, [text for _, text in block], k)
        found = best.join(names, "item")
        out = out.unionByName(found.select("item_id", "rank", F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "score"))
    return out.withColumn("item_id", F.col("item_id").cast(kind))
