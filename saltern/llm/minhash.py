"""MinHash near-duplicates: one-permutation signatures, banded buckets, star-shaped candidates, exact confirmation.

A document's set are the hashes of its distinct word shingles. One hash of each shingle fills all ``BINS``: its leading bits
name the bin, and a bin keeps its least. An empty bin takes the value of the first bin with one in an order of its own
(optimal densification), so bins of two documents agree with the probability of their sets' similarity however short they are.
Documents of equal sets count once from the start, and the rest meet in buckets, one for each band of ``ROWS`` bins. With
``BANDS`` bands a pair of similarity 0.8 shares none once in 20 million, a more similar one less often.

A bucket proposes a star: its least member with each other one, so candidates grow with the documents, not with a
bucket's square. Whether a candidate is a link is decided on the words of both whole texts. Where a bucket still holds several
components afterwards, a member may be linked to another but not to the centre. Its members are then compared by their
signatures: those of different components that agree in at least ``LEAST_BINS`` bins, which a pair of similarity 0.8 misses
once in ten billion, are neighbours. A bucket says which members have neighbours, and which components these connect to a
cluster, in rows that grow with its members, not with their pairs. Within a cluster the sets of the members that have
neighbours are compared, each document beside one part of the cluster at a time. The links found there, one for each two
components that meet, are confirmed on the words too. No bucket is capped.

Edge cases: a null text or one without words has an empty set and is linked with nothing; texts of fewer words than a
shingle are one shingle; repeated rows give a row each; rows that share an id but not the text are documents of their own
that report the same id; rows of a null id are linked with nothing and report null; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltern.llm.common import SPACE_TABLE, hash_words, join_heavy, mix, padded, small_batches, stage, text_rows, word_spans
from saltern.llm.components import components, least_members
from saltern.llm.simhash import forest

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
LEAST_BINS = 72
#: Members that are compared with one centre in one group, and members of a bucket that are compared with each other.
STAR, TILE = 256, 1024
#: Shingles of the members that wait in one part of a cluster.
PART = 1 << 18
#: Bytes of text that are hashed at a time.
CHUNK = 4 << 20
_P, _Q, _R = (np.uint64(x) for x in (0x9FB21C651E98DF25, 0xA24BAED4963EE407, 0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LOWER_BYTES = _LOWER.tobytes()
#: For each bin, the place of every bin in its own order: fixed values from a generator of fixed seed.
_TURN = np.random.default_rng(11).permuted(np.tile(np.arange(BINS, dtype=np.uint8), (BINS, 1)), axis=1)

MARKED = "doc_id long, print long, n long, one long, two long, bins binary, keys array<long>"


def shingle_hashes(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of each text, by document and hash."""
    at = np.cumsum([0] + [len(x) + 1 for x in texts])
    buf = _LOWER[padded([y for x in texts for y in (x, b"\n")])]
    starts, ends = word_spans(buf, int(at[-1]), SPACE_TABLE)
    h = hash_words(buf, starts, ends)
    first = np.searchsorted(starts, at)
    size = np.diff(first)
    doc = np.repeat(np.arange(len(texts)), size)
    left = np.repeat(first[1:], size) - np.arange(len(h))
    whole = np.minimum(size, width)  # words of a shingle of this document
    place = np.flatnonzero(left >= whole[doc]) if len(h) else np.zeros(0, np.int64)
    value, own = np.zeros(len(place), np.uint64), doc[place]
    for k in range(width):
        there = k < whole[own]
        value[there] = mix(value[there] * _P + h[place[there] + k] * _Q)
    order = np.lexsort((value, own))
    own, value = own[order], value[order]
    new = np.ones(len(own), np.bool_)
    new[1:] = (own[1:] != own[:-1]) | (value[1:] != value[:-1])
    return own[new], value[new]


def signatures(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The value of each bin of ``n`` documents (zero for a document without shingles)."""
    of = (value >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(doc), np.bool_)
    first[1:] = (doc[1:] != doc[:-1]) | (of[1:] != of[:-1])  # values ascend, so a bin's first is its least
    out, filled = np.zeros((n, BINS), np.uint64), np.zeros((n, BINS), np.bool_)
    out[doc[first], of[first]] = value[first]
    filled[doc[first], of[first]] = True
    rows = np.flatnonzero(filled.any(1) & ~filled.all(1))
    for lo in range(0, len(rows), 128):
        part = rows[lo : lo + 128]
        source = np.where(filled[part][:, None, :], _TURN[None], np.uint8(255)).argmin(2)
        own = out[part]
        out[part] = np.where(filled[part], own, np.take_along_axis(own, source, 1))
    return out


def band_keys(bins: np.ndarray) -> np.ndarray:
    """A bucket's name for each band."""
    parts = bins.reshape(len(bins), BANDS, ROWS)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _R, (len(bins), 1))
    for k in range(ROWS):
        key = mix(key * _P + parts[:, :, k] * _Q)
    return key


def marks(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, print (of the text), n (distinct shingles), one and two (of the set), bins (a byte of each), keys of buckets."""

    def of(ids, prints, texts):
        doc, value = shingle_hashes(texts, width)
        n = len(texts)
        size = np.bincount(doc, minlength=n)
        bins = signatures(doc, value, n)
        # a set's name: sums of its members' hashes, in two unlike ways
        names = []
        for salt in (_P, _R):
            total = np.zeros(n, np.uint64)
            np.add.at(total, doc, mix(value * salt))
            names.append(pa.array(total.view(np.int64)))
        raw = (bins & np.uint64(255)).astype(np.uint8).tobytes()
        keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(band_keys(bins).view(np.int64).ravel()))
        bins = pa.array([raw[k * BINS : (k + 1) * BINS] for k in range(n)], pa.binary())
        return pa.RecordBatch.from_arrays([ids, prints, pa.array(size), *names, bins, keys], names=["doc_id", "print", "n", "one", "two", "bins", "keys"])

    def mapped(batches):
        for b in batches:
            texts = [x.encode() for x in b.column(1).to_pylist()]
            part = np.cumsum([len(x) for x in texts]) // CHUNK
            for at in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(part)) + 1):
                if len(at):
                    yield of(b.column(0).take(pa.array(at)), b.column(2).take(pa.array(at)), [texts[i] for i in at])

    return text_rows(docs).withColumn("print", F.xxhash64("text")).mapInArrow(mapped, MARKED)


def word_set(text: str, width: int) -> set:
    words = text.encode().translate(_LOWER_BYTES).split()
    return set(zip(*[words[k:] for k in range(width)], strict=False)) if len(words) >= width else {tuple(words)}


def texts_of(nodes: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of each of ``nodes``; rows that say the same under the same id may come more than once."""
    wanted = nodes.join(reps.select("node", "first", "print"), "node").select("node", F.col("first").alias("doc_id"), F.col("print").alias("own"))
    return text_rows(docs).join(wanted, "doc_id").where(F.xxhash64("text") == F.col("own")).select("node", "text")


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) of which 100 * intersection >= ``percent`` * union, on the shingles of both whole texts.

    Each group is a centre with at most about ``STAR`` others, whose texts pass by one at a time.
    """
    held = stage(pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("long").alias("parts")), "stars")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts = stage(texts_of(nodes, reps, docs), "texts")
    dealt = pairs.join(held, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    others = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "text")
    centres = held.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    centres = centres.join(texts.withColumnRenamed("node", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    met = centres.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def compared(batches):
        centre = own = None
        for batch in batches:
            a, b = [], []
            for x, part, y, text in zip(*(batch[c] for c in ("a", "part", "b", "text")), strict=True):
                if not y.is_valid:
                    centre, own = (x.as_py(), part.as_py()), word_set(text.as_py(), width)
                elif centre == (x.as_py(), part.as_py()):
                    other = word_set(text.as_py(), width)
                    same = len(own & other)
                    if 100 * same >= percent * (len(own) + len(other) - same):
                        a.append(centre[0])
                        b.append(y.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return met.mapInArrow(compared, "a long, b long")


NEIGHBOURS = "node long, component long, other long, key long"


def _neighbours(node, component, other, key=None) -> pa.RecordBatch:
    columns = [pa.nulls(len(node), pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (node, component, other, key)]
    return pa.RecordBatch.from_arrays(columns, names=["node", "component", "other", "key"])


def across(batches, percent: int, tile: int):
    """Members with neighbours in their bucket, and the components that these connect: ``NEIGHBOURS`` without a key.

    Rows are sorted by key. Those of buckets of more than ``tile`` go out as they came, with their key.
    """

    def large(t):
        return _neighbours(t["node"], t["component"], None, t["key"])

    def pairs(rows):
        node, n, component = (rows[c].combine_chunks().to_numpy() for c in ("node", "n", "component"))
        bins = np.frombuffer(b"".join(rows["bins"].to_pylist()), np.uint8).reshape(-1, BINS)
        near = np.zeros((len(node), len(node)), np.bool_)
        for lo in range(0, len(node), 64):
            i = slice(lo, lo + 64)
            may = (component[i, None] != component[None]) & (100 * np.minimum(n[i, None], n[None]) >= percent * np.maximum(n[i, None], n[None]))
            x, y = np.nonzero(may)
            for at in range(0, len(x), 1 << 16):
                u, v = x[at : at + (1 << 16)] + lo, y[at : at + (1 << 16)]
                near[u, v] = (bins[u] == bins[v]).sum(1) >= LEAST_BINS
        a, b = forest(near)
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        yield _neighbours(node[a], component[a], component[b])

    names = ["key", "node", "n", "component", "bins"]
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch]).select(names)
        held = t if held is None else pa.concat_tables([held, t])
        key = held["key"].to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        for a, b in zip(cut[:-2].tolist(), cut[1:-1].tolist(), strict=True):  # the last bucket may go on
            if b - a > tile:
                yield from (large(x) for x in held.slice(a, b - a).to_batches())
            else:
                yield from pairs(held.slice(a, b - a))
        held = held.slice(cut[-2])
    if held is not None and len(held):
        yield from (large(x) for x in held.to_batches()) if len(held) > tile else pairs(held)


def across_parts(batches, percent: int):
    """As ``across``, for large buckets: rows sorted by (key, part, visits), a part's own members before its visitors."""
    key, part, held, joined, touched, known = None, [], None, {}, set(), set()

    def top(c):
        while joined.get(c, c) != c:
            c = joined[c]
        return c

    for batch in batches:
        out = []
        for k, own, visits, node, n, component, main, bins in zip(*(batch[c].to_pylist() for c in ("key", "part", "visits", "node", "n", "component", "main", "bins")), strict=True):
            if (k, own) != key:
                key, part, held, joined, touched, known = (k, own), [], None, {}, set(), set()
            if not visits:
                part.append((node, n, component, main, bins))
                continue
            if not part:
                continue
            if held is None:
                held = [np.array([x[c] for x in part]) for c in range(4)]
                held.append(np.frombuffer(b"".join(x[4] for x in part), np.uint8).reshape(-1, BINS))
            nodes, sizes, components_, mains, all_bins = held
            may = (components_ != component) & (mains | (nodes < node)) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
            at = np.flatnonzero(may)
            at = at[(all_bins[at] == np.frombuffer(bins, np.uint8)).sum(1) >= LEAST_BINS]
            for j in at.tolist():
                if j not in touched:
                    touched.add(j)
                    out.append((part[j][0], part[j][2], component))
            for other in np.unique(components_[at]).tolist():
                x, y = top(component), top(other)
                if x != y or node not in known:
                    if x != y:
                        joined[x] = y
                    known.add(node)
                    out.append((node, component, other))
        yield _neighbours(*(np.array([x[c] for x in out], np.int64) for c in range(3)))


def _parted(rows: DataFrame, group: str, weight: str, size: int) -> DataFrame:
    """``rows`` (node, component, ...) of each ``group`` in parts of about ``size`` of ``weight``: all wait in one part, and
    those outside the group's largest component, ``main``, visit all parts too."""
    each = rows.groupBy(group, "component").agg(F.count("*").alias("members"), F.sum(weight).alias("weight"))
    whole = each.groupBy(group).agg(F.max(F.struct("members", "component")).alias("most"), F.ceil(F.sum("weight") / size).cast("long").alias("parts"))
    placed = rows.join(stage(whole, "wholes"), group).withColumn("main", F.col("component") == F.col("most.component"))
    last = F.greatest(F.col("parts"), F.lit(1)) - 1
    waits = placed.withColumns({"part": F.pmod(F.xxhash64("node", F.lit(1)), last + 1), "visits": F.lit(False)})
    visits = placed.where("not main").withColumns({"part": F.explode(F.sequence(F.lit(0).cast("long"), last)), "visits": F.lit(True)})
    return waits.unionByName(visits).drop("most", "parts")


def residual(bands: DataFrame, stars: DataFrame, roots: DataFrame, reps: DataFrame, percent: int, tile: int = TILE) -> DataFrame:
    """(node, component, other): members of some bucket with a neighbour, and the components of neighbours."""
    wide = bands.join(stars.where("held > 2").select("key"), "key").select("key", "node")
    wide = wide.join(roots, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    wide = stage(wide, "wide")
    mixed = wide.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    rows = stage(wide.join(stage(mixed, "mixed"), "key").join(reps.select("node", "n", "bins"), "node"), "rows")
    met = stage(rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: across(it, percent, tile), NEIGHBOURS), "met")
    large = met.where("key is not null").select("key", "node", "component").withColumn("one", F.lit(1))
    dealt = _parted(large, "key", "one", tile // 2).drop("one").join(reps.select("node", "n", "bins"), "node")
    dealt = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "visits")
    more = dealt.mapInArrow(lambda it: across_parts(it, percent), NEIGHBOURS)
    return met.where("key is null").drop("key").union(more.drop("key"))


def met_sets(batches, width: int, percent: int):
    """Links between visitors and the members of a part of a cluster, one at most for each two components.

    Rows are sorted by (cluster, part, visits): first come the part's own members, then the visitors, one at a time.
    """

    def flush(part):
        vocabulary, back = np.unique(np.concatenate([x[2] for x in part]), return_inverse=True)
        size = np.array([len(x[2]) for x in part])
        return vocabulary, back, np.cumsum(size) - size, size, np.array([x[0] for x in part]), np.array([x[1] for x in part]), np.array([x[3] for x in part])

    key, part, held, joined = None, [], None, {}

    def top(c):
        while joined.get(c, c) != c:
            c = joined[c]
        return c

    for batch in batches:
        texts = batch["text"].to_pylist()
        _, value = doc_value = shingle_hashes([t.encode() for t in texts], width)
        edge = np.searchsorted(doc_value[0], np.arange(len(texts) + 1))
        a, b = [], []
        for k, (cluster, own, visits, node, component, main) in enumerate(zip(*(batch[c].to_pylist() for c in ("cluster", "part", "visits", "node", "component", "main")), strict=True)):
            if (cluster, own) != key:
                key, part, held, joined = (cluster, own), [], None, {}
            mine = value[edge[k] : edge[k + 1]]
            if not visits:
                part.append((node, component, mine, main))
                continue
            if not part:
                continue
            held = held or flush(part)
            vocabulary, back, start, size, nodes, others, mains = held
            seen = np.zeros(len(vocabulary), np.bool_)
            at = np.minimum(np.searchsorted(vocabulary, mine), len(vocabulary) - 1)
            seen[at[vocabulary[at] == mine]] = True
            same = np.add.reduceat(seen[back].astype(np.int64), start)
            linked = (100 * same >= percent * (size + len(mine) - same)) & (others != component) & (mains | (nodes < node))
            for j in np.flatnonzero(linked).tolist():
                x, y = top(component), top(int(others[j]))
                if x != y:
                    joined[x] = y
                    a.append(int(nodes[j]))
                    b.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def settled(near: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links between components in the clusters that ``near`` (node, component, other) connects.

    The largest component of a cluster needs no comparison with itself: its members wait in parts of about ``PART``
    shingles, and all others, which wait too, visit each part.
    """
    edges = near.select(F.col("component").alias("a"), F.col("other").alias("b"))
    clusters = stage(components(edges).select(F.col("node").alias("component"), F.col("component").alias("cluster")), "clusters")
    member = near.select("node", "component").distinct().join(reps.select("node", "n"), "node").join(clusters, "component")
    member = stage(member, "clusters")
    texts = stage(texts_of(member.select("node"), reps, docs), "texts")
    rows = _parted(member, "cluster", "n", PART).join(texts, "node").repartition("cluster", "part").sortWithinPartitions("cluster", "part", "visits")
    return rows.mapInArrow(lambda it: met_sets(it, width, percent), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links of at least ``percent`` similarity."""
    with small_batches(docs.sparkSession):
        marked = stage(marks(docs, width), "marked")
    usable = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    sets = marked.where(usable).groupBy("one", "two").agg(F.min(F.struct("doc_id", "print", "n", "bins", "keys")).alias("r"), F.count("*").alias("held"))
    reps = stage(sets.select("one", "two", "held", F.col("r.doc_id").alias("first"), "r.print", "r.n", "r.bins", "r.keys").withColumn("node", F.monotonically_increasing_id()), "sets")
    bands = reps.select("node", "n", F.explode("keys").alias("key"))
    stars = stage(bands.groupBy("key").agg(F.min(F.struct("node", "n")).alias("centre"), F.count("*").alias("held")).where("held > 1"), "stars")
    star = bands.join(stars, "key").where("node <> centre.node").where(100 * F.least("n", "centre.n") >= percent * F.greatest("n", "centre.n"))
    star = stage(star.select(F.col("centre.node").alias("a"), F.col("node").alias("b")).distinct(), "candidates")
    links = stage(confirmed(star, reps, docs, width, percent), "links")
    roots = stage(components(links), "roots")
    near = stage(residual(bands, stars, roots, reps, percent), "near")
    rest = stage(settled(near, reps, docs, width, percent).distinct(), "candidates")
    links = links.union(stage(confirmed(rest, reps, docs, width, percent), "links"))
    member = least_members(reps.select("node", "first"), links)
    member = stage(reps.select("one", "two", "held", "node").join(member, "node").drop("node"), "members")
    linked = join_heavy(marked.where(usable).select("doc_id", "n", "one", "two"), member, ["one", "two"], "held", marked.count())
    alone = marked.where(~usable | usable.isNull()).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n", "component_id").unionByName(alone).withColumnRenamed("n", "n_shingles")


def with_kept(found: DataFrame) -> DataFrame:
    """Whether a document is the one that stays of its component; a row without an id stays."""
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
