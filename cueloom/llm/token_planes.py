"""Token ids in a binary format of byte or bit planes, each compressed with zstandard, with an index of its chunks.

A file row holds whole documents: a header, the table of its documents, an index with the sizes of all
planes, then the planes. Ids are cut into blocks of a fixed number; a block's little-endian 32-bit
ids are transposed so that all first bytes (or bits) lie together, then all second ones, and so on.
Spark writes the rows, so its commit protocol covers lost executors and any store it can reach.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled
from .words import EXACT, SPACED, STEP, KnownWords, Words, in_slices

MAGIC, VERSION = b"TKPL", 1
HEAD = struct.Struct("<4sBBHIQI")
BLOCK_IDS = 1 << 14
#: A file row is closed at the first document that takes it over this many ids.
FILE_IDS = 1 << 18
CACHE_WORDS = 500_000


def planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        rows = np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1, bitorder="little")
        return [r.tobytes() for r in rows]
    return [r.tobytes() for r in rows.T]


def unplanes(parts: list[bytes], n: int, bits: bool) -> np.ndarray:
    rows = np.stack([np.frombuffer(p, np.uint8) for p in parts])
    if bits:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


def pack(doc_ids: list, counts: np.ndarray, ids: np.ndarray, bits: bool = False, block: int = BLOCK_IDS) -> bytes:
    """A file row: these documents (an id may be None) and all their ids."""
    zip_ = zstandard.ZstdCompressor(level=3)
    known = np.array([i is not None for i in doc_ids], np.uint8)
    docs = zip_.compress(known.tobytes() + np.array([i or 0 for i in doc_ids], "<i8").tobytes() + counts.astype("<i8").tobytes())
    body = [zip_.compress(p) for at in range(0, len(ids), block) for p in planes(ids[at : at + block], bits)]
    index = np.array([len(p) for p in body], "<u4").tobytes()
    return b"".join([HEAD.pack(MAGIC, VERSION, bits, 0, block, len(ids), len(doc_ids)), struct.pack("<I", len(docs)), docs, index, *body])


def unpack(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """The document ids, their counts, and all ids of a file row."""
    magic, version, bits, _, block, n_ids, n_docs = HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token file of this format")
    unzip, at = zstandard.ZstdDecompressor(), HEAD.size + 4
    (size,) = struct.unpack_from("<I", data, HEAD.size)
    raw = unzip.decompress(data[at : at + size])
    known, doc_ids, counts = np.frombuffer(raw, np.uint8, n_docs), np.frombuffer(raw, "<i8", n_docs, n_docs), np.frombuffer(raw, "<i8", n_docs, 9 * n_docs)
    at, each = at + size, 32 if bits else 4
    n_blocks = -(-n_ids // block)
    sizes = np.frombuffer(data, "<u4", n_blocks * each, at)
    starts = at + sizes.nbytes + np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    out = []
    for b in range(n_blocks):
        parts = [unzip.decompress(data[starts[i] : starts[i + 1]]) for i in range(b * each, (b + 1) * each)]
        out.append(unplanes(parts, min(block, n_ids - b * block), bits))
    return [int(i) if k else None for i, k in zip(doc_ids, known, strict=True)], counts, np.concatenate(out) if out else np.empty(0, np.uint32)


class Encoder:
    """A tokenizer of the tokenizers library that encodes each distinct run of characters between ASCII white space once.

    That is exact for tokenizers whose words never hold or look across white space; where the
    tokenizer lowers letters itself, A-Z are lowered before, so that fewer runs differ. New runs are
    encoded together, with a mark between them whose id tells where each ends: a control character
    of one id that stands apart, or else a special token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            normalizer = json.load(f)["normalizer"] or {}
        lowers = any(n["type"] == "Lowercase" for n in normalizer.get("normalizers", [normalizer]) if n)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = SPACED if lowers and all(t == t.lower() for t in special) else EXACT
        ids = self.tokenizer.encode("\x01", add_special_tokens=False).ids
        if len(ids) == 1 and self.tokenizer.encode("a \x01 a", add_special_tokens=False).ids.count(ids[0]) == 1:
            self.mark_id, self.mark, self.between = ids[0], b"\x01", b" \x01 "
        else:
            self.mark_id, mark = max((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items())
            self.mark = self.between = mark.encode()
        self.known = KnownWords(CACHE_WORDS)

    def encode(self, words: Words, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, each with end_id after it; and how many each has with it."""
        numbers = self.known.numbers(words, self._learn)
        out, counts = [], np.zeros(len(words.hash) + 1, np.int64)
        for at in range(0, len(numbers), STEP):
            ids, n = self.known.ids(numbers[at : at + STEP])
            out.append(ids)
            counts[at + 1 : at + 1 + len(n)] = n
        sums = np.cumsum(counts)[words.first]
        return np.insert(np.concatenate(out) if out else np.zeros(0, np.int32), sums[1:], end_id).astype(np.uint32), np.diff(sums) + 1

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        encode = lambda t: np.array(self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.int32)
        plain, odd = [], []
        for i, w in enumerate(words):
            (odd if self.mark in w else plain).append(i)
        got = [encode(self.between.join([*(words[i] for i in plain[at : at + 64]), b""])) for at in range(0, len(plain), 64)]
        flat = np.concatenate([np.zeros(0, np.int32), *got])
        marks = np.flatnonzero(flat == self.mark_id)
        flat, lengths = np.delete(flat, marks), np.diff(marks, prepend=-1) - 1
        if odd:  # a run that holds the mark itself is encoded alone
            pieces: list = [None] * len(words)
            for i, ids in zip(plain, np.split(flat, np.cumsum(lengths)[:-1]), strict=False):
                pieces[i] = ids
            for i in odd:
                pieces[i] = encode(words[i])
            return np.concatenate(pieces), np.array(list(map(len, pieces)), np.int32)
        return flat, lengths.astype(np.int32)


@lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def token_files(docs: DataFrame, vocab_path: str, end_id: int, bits: bool = False, file_ids: int = FILE_IDS) -> DataFrame:
    """File rows with the ids of whole texts in ascending doc_id order: shard, file, at (ids before it in its shard), n_ids, data.

    Shards are range partitions, so shard order is doc_id order. A null text counts as empty and has
    the end id alone; a null doc_id sorts first; rows with equal doc_id are ordered by text. Extra
    columns are ignored; no rows give no file rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, file, at = load(vocab_path), TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        counts: list = []
        ids: list = []

        def closed() -> pa.RecordBatch:
            nonlocal file, at
            flat = np.concatenate(ids)
            row = pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": pa.array([file], pa.int32()), "at": pa.array([at], pa.int64()), "n_ids": pa.array([len(flat)], pa.int64()), "data": pa.array([pack(doc_ids, np.concatenate(counts), flat, bits)], pa.binary())})
            file, at = file + 1, at + len(flat)
            doc_ids.clear(), counts.clear(), ids.clear()
            return row

        for b in batches:
            for lo, words in in_slices(b.column(1), encoder.kind):
                got, n = encoder.encode(words, end_id)
                doc_ids += b.column(0).slice(lo, len(words)).to_pylist()
                counts.append(n)
                ids.append(got)
                if sum(map(len, ids)) >= file_ids:
                    yield closed()
        if doc_ids:
            yield closed()

    return settled(rows.mapInArrow(write, "shard int, file int, at long, n_ids long, data binary"))


def read_tokens(files: DataFrame) -> DataFrame:
    """Documents read back from file rows: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    placed = files.join(F.broadcast(shards.select("shard", F.coalesce("base", F.lit(0)).alias("base"))), "shard")  # a row for each shard

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc_ids, counts, ids = unpack(data.as_py())
                raw, ends = ids.tobytes(), np.cumsum(counts)
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(start + ends - counts, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    return placed.select((F.col("base") + F.col("at")).alias("start"), "data").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
