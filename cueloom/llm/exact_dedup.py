"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries find the digests that may hold a large share of all rows; their exact
winners are counted and broadcast (at most `k` of them), so no hot digest is ever shuffled row by
row. All other digests take the ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled

#: The most digests that count as frequent: bounds each task's summary and the broadcast.
HEAVY_K = 512


def text_digest(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "").cast("binary"), 256)


def digests(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"), F.length(text).cast("long").alias("n_chars"))


def misra_gries(counts: dict, batch: dict, k: int) -> dict:
    """Merges batch into counts and keeps at most k counters, each low by at most the sum that was taken off."""
    for key, n in batch.items():
        counts[key] = counts.get(key, 0) + n
    if len(counts) > k:
        cut = sorted(counts.values(), reverse=True)[k]
        counts = {key: n - cut for key, n in counts.items() if n > cut}
    return counts


def frequent(rows: DataFrame, k: int = HEAVY_K) -> DataFrame:
    """At most k digests, among them every one that holds more than 2/(k+1) of the rows.

    A task's summary misses a digest's count by n/(k+1) at most, so the sums miss it by N/(k+1).
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for b in batches:
            seen = pc.value_counts(b.column(0))
            counts = misra_gries(counts, dict(zip(seen.field(0).to_pylist(), seen.field(1).to_pylist(), strict=True)), k)
        yield pa.RecordBatch.from_pydict({"digest": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    sums = rows.select("digest").mapInArrow(summarise, "digest string, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    return sums.orderBy(F.desc("n"), "digest").limit(k).select("digest")


def exact_dedup(docs: DataFrame, k: int = HEAVY_K) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters [\\x20\\x09-\\x0D]; a null text counts as
    empty, so null and blank texts form one group. The row with the most code points stays, then the
    smallest doc_id; a null doc_id loses every tie. Rows that repeat a doc_id and its text are one
    document written twice: all get the same verdict. Extra columns are ignored; no rows give no rows.
    """
    rows = settled(digests(docs))
    best = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("not_id"))).alias("best")
    won = lambda x: x.groupBy("digest").agg(best, F.count("*").alias("group_size"))
    hot = settled(won(rows.join(F.broadcast(frequent(rows, k)), "digest")))  # at most k rows
    cold = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    both = rows.join(F.broadcast(hot), "digest").unionByName(cold.join(won(cold), "digest"))
    keep = F.bitwise_not(F.col("best.not_id"))
    return both.select("doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("digest").alias("text_sha256"))
