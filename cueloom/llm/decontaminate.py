"""Benchmark decontamination: a bounded set of test windows is broadcast, token windows are looked up in it, hits are verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, gather, release, settled
from .words import ALNUM, STEP, Words, in_slices

#: Most bytes that the windows of one pass take when built; a larger benchmark is scanned in several passes.
BUILT_BYTES = 64 << 20
#: A byte of text gives at most half a word, with BYTES_A_WORD in four arrays, and a byte in the buffer.
BYTES_A_WORD = 24
PASS_BYTES = BUILT_BYTES // (1 + BYTES_A_WORD // 2)
WINDOW = 10


class Windows:
    """The windows of benchmark items; an item with fewer words than the window is one window of its own length.

    Built once, as flat arrays: for each number of words the windows' hashes in order, and where each
    window's words, a space between them, begin and end in one buffer, and its item.
    """

    def __init__(self, items: list[tuple], width: int = WINDOW):
        self.names = [i for i, _ in items]
        texts, found = [], {k: [] for k in range(1, width + 1)}
        used = 0
        for at, words in in_slices(pa.array([t for _, t in items], pa.string()), ALNUM):
            size = words.end - words.start
            place = used + np.cumsum(size + 1) - size - 1
            buffer = np.full(int((size + 1).sum()), 32, np.uint8)
            buffer[gather(np.arange(len(buffer)), place - used, size)] = words.raw[gather(np.arange(len(words.raw)), words.start, size)]
            used += len(buffer)
            texts.append(buffer)
            n = np.diff(words.first)
            for k in found:
                h, whole = words.windows(k)
                begin = np.flatnonzero(whole) if k == width else words.first[:-1][n == k]
                item = np.searchsorted(words.first, begin, "right") - 1 + at
                last = begin + k - 1
                found[k].append((h[begin], place[begin], (place[last] + size[last]), item))
        self.buffer = np.concatenate(texts).tobytes() if texts else b""
        self.at = {}
        for k, parts in found.items():
            h, begin, end, item = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else ([],) * 4
            if len(h):
                order = np.lexsort((begin, item, h))
                kept = self._different(h[order], begin[order], end[order], item[order])
                order = order[kept]
                self.at[k] = h[order], begin[order].astype(np.int32), end[order].astype(np.int32), item[order].astype(np.int32)

    def _different(self, h: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Not those that repeat the window before, of the same item."""
        kept = np.ones(len(h), bool)
        for i in (np.flatnonzero((h[1:] == h[:-1]) & (item[1:] == item[:-1])) + 1).tolist():
            kept[i] = self.buffer[begin[i] : end[i]] != self.buffer[begin[i - 1] : end[i - 1]]
        return kept

    @property
    def built_bytes(self) -> int:
        return len(self.buffer) + sum(x.nbytes for a in self.at.values() for x in a)

    def ready(self) -> Windows:
        """With marks for a first look by 20 bits, which spares most searches."""
        self.marks = {}
        for k, (keys, *_) in self.at.items():
            self.marks[k] = np.zeros(1 << 20, bool)
            self.marks[k][(keys >> np.uint64(44)).astype(np.int64)] = True
        return self

    def hits(self, words: Words) -> tuple[np.ndarray, dict[int, set]]:
        """Which words are inside an occurrence of a window, and by text the ids of the items whose windows occur."""
        hit, items = np.zeros(len(words.hash) + 1, np.int32), {}
        for k, (keys, begin, end, item) in self.at.items():
            for lo in range(0, len(words.hash), STEP):
                h, whole = words.windows(k, lo, lo + STEP)
                maybe = np.flatnonzero(self.marks[k][(h >> np.uint64(44)).astype(np.int64)] & whole)
                if not len(maybe):
                    continue
                first, last = np.searchsorted(keys, h[maybe]), np.searchsorted(keys, h[maybe], "right")
                at = np.flatnonzero(last > first)
                maybe, first, last = maybe[at] + lo, first[at], last[at]
                text = np.searchsorted(words.first, maybe, "right") - 1
                for i, t, a, b in zip(maybe.tolist(), text.tolist(), first.tolist(), last.tolist(), strict=True):
                    said = b" ".join(words.word(j) for j in range(i, i + k))  # verified word by word
                    if ids := {self.names[item[w]] for w in range(a, b) if self.buffer[begin[w] : end[w]] == said}:
                        items.setdefault(t, set()).update(ids)
                        hit[i] += 1
                        hit[i + k] -= 1
        return np.cumsum(hit, dtype=np.int32)[:-1] > 0, items


def _passes(spark: SparkSession, benchmark: DataFrame, width: int) -> Iterator:
    """The benchmark's windows in broadcasts, each built from PASS_BYTES of text or so: the size is summed first, and a larger one cut by hash."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // PASS_BYTES))
    for p in range(n):
        part = bench if n == 1 else bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == p)
        yield spark.sparkContext.broadcast(Windows([tuple(r) for r in part.collect()], width))


REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<struct<first:long,last:long>>, items array<string>"
SO_FAR = "doc_id long, text string, mask binary, items array<string>"


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2] - 1


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per document with its hit words and items; hit_spans are runs of hit words (first and last word, from 0).

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lowered. A null or empty text
    has no words and no hits; rows that repeat are reported each. Item ids that repeat count once;
    items with a null text or id are never hit. Extra columns are ignored; no rows give no rows.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.list_(pa.string())]

    def report(mask: np.ndarray, found: set) -> tuple:
        names = sorted(found)
        spans = [{"first": int(x), "last": int(y)} for x, y in zip(*_runs(mask), strict=True)] if found else []
        return len(mask), int(mask.sum()), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(found), spans, names

    def scan_with(shared, more: bool):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = shared.value.ready()
            for b in batches:
                for at, words in in_slices(b.column(1), ALNUM):
                    part, (mask, found) = b.slice(at, len(words)), windows.hits(words)
                    hits = [(mask[lo:hi], found.get(i, set())) for i, (lo, hi) in enumerate(zip(words.first[:-1], words.first[1:], strict=True))]
                    if part.num_columns > 2:
                        before = zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)
                        hits = [(m | np.frombuffer(old, bool), f | set(ids)) for (m, f), (old, ids) in zip(hits, before, strict=True)]
                    if more:
                        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([m.tobytes() for m, _ in hits], pa.binary()), pa.array([sorted(f) for _, f in hits], pa.list_(pa.string()))], names=["doc_id", "text", "mask", "items"])
                    else:
                        rows = [report(*x) for x in hits]
                        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                        yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans", "items"])

        return scan

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    passes = _passes(docs.sparkSession, benchmark, width)
    shared = next(passes)
    for following in passes:
        rows = settled(rows.mapInArrow(scan_with(shared, True), SO_FAR))
        shared.unpersist()
        shared = following
    return rows.mapInArrow(scan_with(shared, False), REPORT)


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, remove: str = "documents") -> DataFrame:
    """docs without contaminated documents (remove="documents"), or with hit words cut out of their texts (remove="spans").

    In the second mode a cut goes from the first to the last word of a run; what lies between other
    words stays. All columns of docs are returned as they were; a text with no hit is not touched.
    Rows that repeat stay or go alike; null and blank texts stay; no rows give no rows. Of the rows
    the text alone is handed to Python.
    """
    spark, first = docs.sparkSession, True
    text = F.col("text").cast("string")
    if remove == "documents":
        for shared in _passes(spark, benchmark, width):
            docs = docs if first else settled(docs)
            docs, first = docs.where(~_leaks(shared)(text)), False
        return docs
    names = docs.columns
    mask = free_name(names, "mask")
    for shared in _passes(spark, benchmark, width):
        docs = docs.withColumn(mask, F.lit(None).cast("binary")) if first else settled(docs)
        docs, first = docs.withColumn(mask, _masks(shared)(text, F.col(mask))), False
    return docs.withColumn("text", _cuts()(text, F.col(mask))).select(names)


def _leaks(shared):
    @F.arrow_udf("boolean")
    def leaks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        windows = shared.value.ready()
        for texts in batches:
            out = np.zeros(len(texts), bool)
            for at, words in in_slices(texts, ALNUM):
                out[[at + i for i in windows.hits(words)[1]]] = True
            yield pa.array(out)
        release()

    return leaks


def _masks(shared):
    @F.arrow_udf("binary")
    def masks(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        """A byte for each word of a text with a hit, by this pass or an earlier one; null without hits."""
        windows = shared.value.ready()
        for texts, before in batches:
            out = []
            for _, words in in_slices(texts, ALNUM):
                mask, found = windows.hits(words)
                out += [mask[lo:hi].tobytes() if i in found else None for i, (lo, hi) in enumerate(zip(words.first[:-1], words.first[1:], strict=True))]
            both = ((x, y) if x and y else (x or y, None) for x, y in zip(out, before.to_pylist(), strict=True))
            yield pa.array([x if y is None else (np.frombuffer(x, bool) | np.frombuffer(y, bool)).tobytes() for x, y in both], pa.binary())

    return masks


def _cuts():
    @F.arrow_udf("string")
    def cuts(texts: pa.Array, masks: pa.Array) -> pa.Array:
        return pa.array([t if m is None else _cut(t, np.frombuffer(m, bool)) for t, m in zip(texts.to_pylist(), masks.to_pylist(), strict=True)], pa.string())

    return cuts


def _cut(text: str, hit: np.ndarray) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    inside = np.frombuffer(raw.translate(ALNUM), np.uint8) != 32
    (starts, ends), (first, last) = _runs(inside), _runs(hit)
    out, at = [], 0
    for a, b in zip(first, last, strict=True):
        out.append(raw[at : starts[a]])
        at = ends[b] + 1
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")
