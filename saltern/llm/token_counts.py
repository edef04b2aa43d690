"""Token counts by a map-side two-tier lookup: no piece of text is ever shuffled to be counted.

Tier one is a broadcast table of the corpus's most frequent pre-token pieces and their token counts; its size is fixed
by ``table_entries``, whatever the corpus. Tier two is each worker's cache, which encodes misses once. The table only
saves encoding: counts never depend on what it holds.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows and repeated ids give a row each; an empty
table gives no rows; columns besides the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltern.llm.common import text_rows
from saltern.llm.tokens import ByteCounter

#: Pieces in the broadcast table: a size bound that holds for any corpus.
TABLE_ENTRIES = 16_384
#: Pieces that each task reports, and how many it counts at a time before it drops the rare half.
REPORTED, COUNTED = 8_192, 300_000
#: Longer pieces stay out of the table, so its bytes are bounded too.
TABLE_CHARS = 64


def frequent_pieces(docs: DataFrame, table_entries: int = TABLE_ENTRIES) -> list[str]:
    """The pieces most often found after a space, by a lossy count over all documents: each task prunes and reports its
    most frequent ones, Spark sums the reports."""

    def local(batches):
        seen: Counter[str] = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(p for p in text.split(" ")[1:] if len(p) <= TABLE_CHARS)
                if len(seen) > COUNTED:
                    seen = Counter(dict(seen.most_common(COUNTED // 2)))
        top = [(p, n) for p, n in seen.most_common(REPORTED) if n > 1]
        yield pa.RecordBatch.from_pydict({"piece": pa.array([p for p, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    counted = text_rows(docs).select("text").mapInArrow(local, "piece string, n long")
    rows = counted.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(table_entries).collect()
    return [r["piece"] for r in rows]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, table_entries: int = TABLE_ENTRIES) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens as the tokenizer library counts them, over_limit (n_tokens > limit)."""
    plain = ByteCounter(tokenizer_path)
    lengths = {p: plain.piece(" " + p) for p in frequent_pieces(docs, table_entries)}
    held = docs.sparkSession.sparkContext.broadcast(lengths)

    def count(batches):
        counter = ByteCounter(tokenizer_path, held.value)
        for b in batches:
            n = [counter.count(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    sized = text_rows(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = sized.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
