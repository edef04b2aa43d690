"""Phrase collocations: weighted n-gram counts of distinct pieces, and the phrases whose words stick together most.

Texts fall into pieces at sentence marks, and equal pieces of a language become one row with its multiplicity before
anything is counted. Map tasks reduce their pieces to distinct n-grams with weights and send them, packed, to hash
buckets; each bucket is counted by duckdb with a memory bound and a spill folder of the task's own, so a bucket larger
than memory works too. Only n-grams of at least ``least`` occurrences come back: a part of a candidate occurs at least as
often as the candidate, so all that scores need is among them.

Scores need the counts of a candidate's parts. Candidates are dealt out in blocks of bounded size; a block asks for each
part once, however many of its candidates hold it, the requests meet the counts by (lang, part), and the answers go back to the
block. A word in a third of all candidates therefore makes one request a block. The first ``top`` are picked within
blocks, then within groups of 64 blocks, until one is left.

Edge cases: a null text has no pieces, a null lang counts as ``und`` (together with rows that say so); pieces without a
word count nothing; repeated rows and repeated or null ids are texts of their own; an empty table gives no rows; a language
without a candidate gives none; other columns are ignored, whatever their names. A single piece has to fit in a task.
"""

from __future__ import annotations

import json
import tempfile

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import csv
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saltern.llm.common import hash_words, mix, padded, stage, word_spans

#: Words of the pieces that a map task reduces at a time.
CHUNK_WORDS = 1 << 19
#: Memory of the count of a bucket, beyond which duckdb spills.
COUNT_MEMORY = "256MB"
#: Candidates of a block.
BLOCK = 4096
#: Blocks whose first candidates meet in one task.
FAN_IN = 64
UNKNOWN = "und"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_IS_WORD = np.ones(256, np.bool_)
_IS_WORD[[0x20, 0x0A]] = False
_P, _Q = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA24BAED4963EE407)
def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, piece (its words, parted by one space), m: how often the piece occurs."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.translate(F.col(text_col), _UPPER, _LOWER).alias("text"))
    cut = rows.select("lang", F.explode(F.split("text", r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    plain = cut.select("lang", F.trim(F.regexp_replace("piece", r"[\x20\x09]+", " ")).alias("piece"))
    return plain.where("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("m"))


def sent_schema(longest: int) -> pa.Schema:
    """What buckets get: lang, head (the first one or two words), the words after two (null past a piece's end), f."""
    return pa.schema([("lang", pa.string()), ("head", pa.string()), *((f"next_{k}", pa.string()) for k in range(3, longest + 1)), ("f", pa.int64())])


def grams(lang: list[str], piece: list[str], m: list[int], longest: int):
    """Distinct n-grams of some pieces as a table of ``sent_schema``, and a hash of each (lang, head).

    Words go out alone, and from each word but a piece's last one the ``longest`` words that start there, or what the piece
    still has of them: the counts of all n-grams in between are sums of those that they begin.
    """
    raw = [x.encode() for x in piece]
    buf = padded([x + b"\n" for x in raw])
    at = np.cumsum([0] + [len(x) + 1 for x in raw])
    starts, ends = word_spans(buf, int(at[-1]), _IS_WORD)
    of = np.searchsorted(at, starts, "right") - 1
    left = np.searchsorted(starts, at[1:])[of] - np.arange(len(starts))  # words of the piece from here on
    langs, lang_of = np.unique(np.array(lang, object), return_inverse=True)
    tongue, weight = lang_of[of], np.array(m, np.int64)[of]
    # words as equal strings, each with the one separator behind it
    flat = buf[: int(at[-1])].copy()
    flat[ends] = 0x20
    offsets = pa.array(np.append(starts, at[-1]), pa.int64())
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets.buffers()[1], pa.py_buffer(flat)]).dictionary_encode()
    word = coded.indices.to_numpy().astype(np.int64)
    vocabulary = pc.binary_slice(coded.dictionary, 0, -1)
    name = hash_words(*_buffer([x.as_py() for x in vocabulary]))
    seed = hash_words(*_buffer([x.encode() for x in langs]))
    size = np.int64(len(vocabulary) + 1)

    def made(key, place, heads):
        distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, back, weight[place])
        place = place[first]
        said = [_text(vocabulary, word[place + j]) for j in range(heads)]
        columns = [pa.array(langs[tongue[place]].tolist(), pa.string()), said[0] if heads == 1 else pc.binary_join_element_wise(*said, " ")]
        for k in range(2, longest):
            there = (left[place] > k) & (heads == 2)
            columns.append(_text(vocabulary, np.where(there, word[np.minimum(place + k, len(word) - 1)], 0), ~there))
        h = seed[tongue[place]].copy()
        for j in range(heads):
            h = mix(h * _P + name[word[place + j]] * _Q)
        return pa.table([*columns, pa.array(total)], schema=sent_schema(longest)), h

    one = tongue * size + word
    pairs = np.flatnonzero(left > 1)
    key = one[pairs] * size + word[pairs + 1]
    for k in range(2, longest):
        # (words so far, next word or none) is one number; before that, the former becomes its place among the distinct
        key = np.unique(key, return_inverse=True)[1] * size
        there = left[pairs] > k
        key[there] += word[pairs[there] + k] + 1
    parts = [made(one, np.arange(len(word)), 1), made(key, pairs, 2)]
    return pa.concat_tables([t for t, _ in parts]), np.concatenate([h for _, h in parts])


def _text(vocabulary: pa.Array, at: np.ndarray, mask=None) -> pa.Array:
    return vocabulary.take(pa.array(at, mask=mask)).cast(pa.large_string()).cast(pa.string())


def _buffer(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in parts], np.int64)
    end = np.cumsum(size)
    return padded(parts), end - size, end


def packed_lines(table: pa.Table, edges: list[int]) -> list[bytes]:
    """The rows between consecutive ``edges``, as lines: without the offsets of Arrow strings they take half the space.

    Words hold no tab or line break, and languages, which may, go by their place in a list.
    """
    coded = table["lang"].combine_chunks().dictionary_encode()
    cells = [coded.indices.cast(pa.string()), *(pc.fill_null(table[c].combine_chunks(), "") for c in table.column_names[1:-1]), table["f"].combine_chunks().cast(pa.string())]
    lines = pc.binary_join_element_wise(pc.binary_join_element_wise(*cells, "\t"), "", "\n").cast(pa.large_string())
    at = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
    data = memoryview(lines.buffers()[2] or b"")
    head = json.dumps(coded.dictionary.to_pylist()).encode() + b"\n"
    return [zstandard.compress(head + data[at[a] : at[b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def unpacked_lines(raw: bytes, longest: int) -> pa.Table:
    head, body = zstandard.decompress(raw).split(b"\n", 1)
    schema = sent_schema(longest)
    types = {f.name: f.type for f in schema} | {"lang": pa.int32()}
    t = csv.read_csv(
        pa.BufferReader(body),
        csv.ReadOptions(use_threads=False, column_names=schema.names),
        csv.ParseOptions(delimiter="\t", quote_char=False, escape_char=False),
        csv.ConvertOptions(column_types=types, null_values=[""], strings_can_be_null=True, check_utf8=False),
    )
    return t.set_column(0, "lang", pa.chunked_array([pa.array(json.loads(head), pa.string()).take(c) for c in t["lang"].chunks], pa.string())).cast(schema)


def count_bucket(tables, longest: int, least: int):
    """lang, phrase, k, f: the n-grams of at least ``least`` occurrences of all ``tables``, and each language's words.

    The latter have no phrase (k 0). duckdb spills to the task's own temporary folder, which goes with the task.
    """
    words: dict[str, int] = {}

    def batches():
        for t in tables:
            alone = t.filter(pc.invert(pc.match_substring(t["head"], " "))).group_by("lang").aggregate([("f", "sum")])
            for x, n in zip(alone["lang"].to_pylist(), alone["f_sum"].to_pylist(), strict=True):
                words[x] = words.get(x, 0) + n
            yield from t.to_batches()

    after = [f"next_{k}" for k in range(3, longest + 1)]
    sets = ", ".join("(" + ", ".join(["lang", "head", *after[:k]]) + ")" for k in range(len(after) + 1))
    # a group of a longer set with a null word ended before it, and was counted among the shorter ones
    whole = " and ".join(["true", *(f"({c} is not null or grouping({c}) = 1)" for c in after)])
    with tempfile.TemporaryDirectory() as folder, duckdb.connect(config={"threads": 1, "memory_limit": COUNT_MEMORY, "temp_directory": f"{folder}/spill"}) as db:
        db.register("sent", pa.RecordBatchReader.from_batches(sent_schema(longest), batches()))
        found = f"select lang, concat_ws(' ', {', '.join(['head', *after])}) as phrase, sum(f) as f from sent group by grouping sets ({sets}) having sum(f) >= {int(least)} and {whole}"
        found = db.sql(f"select lang, phrase, cast(length(phrase) - length(replace(phrase, ' ', '')) + 1 as integer) as k, cast(f as bigint) as f from ({found})")
        yield from found.to_arrow_reader(65536)
    yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.nulls(len(words), pa.string()), pa.array([0] * len(words), pa.int32()), pa.array(list(words.values()), pa.int64())], names=["lang", "phrase", "k", "f"])


def counts(docs: DataFrame, longest: int = 3, least: int = 10) -> DataFrame:
    """lang, phrase, k (its words), f: occurrences, at least ``least``; a null phrase (k 0) has words of a language."""
    spark = docs.sparkSession
    log2 = max(6, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())

    def packed(batches):
        lang, piece, m, words = [], [], [], 0

        def send():
            table, h = grams(lang, piece, m, longest)
            bucket = (h >> np.uint64(64 - log2)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            table, bucket = table.take(pa.array(order)), bucket[order]
            edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]]), pa.array(packed_lines(table, edge.tolist()), pa.binary())], names=["bucket", "payload"])

        for batch in batches:
            for x, y, z in zip(*(batch[c].to_pylist() for c in ("lang", "piece", "m")), strict=True):
                lang.append(x)
                piece.append(y)
                m.append(z)
                words += y.count(" ") + 1
                if words >= CHUNK_WORDS:
                    yield from send()
                    lang, piece, m, words = [], [], [], 0
        if piece:
            yield from send()

    def counted(batches):
        yield from count_bucket((unpacked_lines(x.as_py(), longest) for b in batches for x in b["payload"]), longest, least)

    sent = pieces(docs).mapInArrow(packed, "bucket long, payload binary").repartition("bucket")
    return stage(sent.mapInArrow(counted, "lang string, phrase string, k int, f long"), "counts")


def _first(rows: DataFrame, groups: int, top: int) -> DataFrame:
    """The ``top`` best rows of each language with their rank; rows carry their ``block``."""
    while True:
        within = Window.partitionBy("lang", "block").orderBy(F.desc("score"), F.desc("a"), "phrase")
        rows = rows.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= top)
        if groups == 1:
            return rows
        groups = -(-groups // FAN_IN)
        rows = rows.withColumn("block", F.pmod("block", F.lit(groups)))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` candidates, as the module says.

    A candidate is a phrase of 2 to ``longest`` words with at least ``least`` occurrences. It falls away where its words
    lie in a longer candidate that has at least ``share`` percent of its occurrences.
    """
    known = counts(docs, longest, least)
    groups = max(1, -(-known.where("k > 1").count() // BLOCK))
    block = F.pmod(F.xxhash64("lang", "phrase"), F.lit(groups))
    candidates = known.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), block.alias("block"), F.split("phrase", " ").alias("words"))
    cut = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    join = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cut = cut.select("lang", "phrase", "a", "block", "cut", join(F.lit(1), F.col("cut")).alias("head"), join(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    asked = cut.select("block", "lang", F.explode(F.array("head", "tail")).alias("part")).distinct()
    answered = asked.join(known.where("k > 0").select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    own = lambda part, name: answered.select("block", "lang", F.col("part").alias(part), F.col("f").alias(name))
    met = cut.join(own("head", "l"), ["block", "lang", "head"]).join(own("tail", "r"), ["block", "lang", "tail"])
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    met = met.withColumns({"above": F.lit(1_000_000).cast("decimal(7,0)") * (wide("a") * wide("a")), "below": wide("l") * wide("r")})
    best = met.groupBy("lang", "phrase", "a", "block").agg(F.min(F.struct(F.expr("above div below").alias("score"), "cut", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "block", "b.score", "b.l", "b.r")
    # every shorter phrase of two words or more that lies in a candidate, with its most frequent holder
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: F.array_join(F.slice("words", at, size), " "))))
    holders = candidates.where("k > 2").select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(holders, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    total = known.where("k = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    ranked = _first(kept.drop("longer"), groups, top).join(total, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
