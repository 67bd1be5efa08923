"""Byte-level BPE, encoded with contiguous rank arrays and decoded again.

A word is short, so its parts and the ranks of joining neighbours are kept in plain arrays: the least
rank is found by a scan, its boundary is deleted, and only the two neighbouring ranks are looked up
anew. numpy does this for all new words of a batch at once, a row of a matrix for each. Each task
keeps the words it has met, up to a bound.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordStore, gather, text_pieces

#: The split pattern of the vocabulary's byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a task remembers; all are forgotten when there are more.
CACHE_WORDS = 200_000
#: Words are put in matrices by their length in bytes; longer ones are joined by a heap, so that a long word costs n log n.
WIDTHS = (0, 1, 2, 4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 96, 192)
NO_RANK = 1 << 60
#: Characters, or ids, of a text that are worked on together.
PIECE = 1 << 20
#: A lone space between other characters begins a word of the pattern, whatever is around it, and no special token holds one.
_CUT = regex.compile(r"(?<=\S) (?=\S)")


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, by a rule: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_chars()
        raw = lambda s: bytes(of[c] for c in s)
        self.id_of = {raw(s): i for s, i in spec["model"]["vocab"].items() if all(c in of for c in s)}
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((raw(left), raw(right)), rank)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.split = regex.compile(PATTERN)
        self.of_byte = np.array([self.id_of[bytes([b])] for b in range(256)], np.int64)
        pairs = [(self.id_of[a], self.id_of[b], rank, self.id_of[a + b]) for (a, b), rank in self.ranks.items()]
        left, right, rank, joined = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.joined = np.zeros(int(rank.max()) + 1, np.int64)
        self.joined[rank] = joined
        self._hash_pairs((left << 32) | right, rank)
        tokens = {i: b for b, i in self.id_of.items()} | {i: s.encode() for s, i in self.special.items()}
        self.size = max(tokens) + 1
        self.token_len = np.array([len(tokens.get(i, b"")) for i in range(self.size)], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(self.size)), np.uint8)
        self.store = WordStore(CACHE_WORDS)

    def _hash_pairs(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """An open-addressing table from pairs of ids to ranks."""
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.pair, self.pair_rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NO_RANK, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.pair[slot[left]] == -1
            _, first = np.unique(slot[left][free], return_index=True)
            put = left[free][first]
            self.pair[slot[put]], self.pair_rank[slot[put]] = keys[put], ranks[put]
            left = np.setdiff1d(left, put)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 32) | right
        slot = self._slot(keys)
        out = np.where(self.pair[slot] == keys, self.pair_rank[slot], NO_RANK)
        rest = np.flatnonzero((self.pair[slot] != keys) & (self.pair[slot] != -1))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            there = self.pair[slot[rest]]
            out[rest] = np.where(there == keys[rest], self.pair_rank[slot[rest]], out[rest])
            rest = rest[(there != keys[rest]) & (there != -1)]
        return out

    def _joined(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of some words of about the same length, a row each, and how many parts each has."""
        width = int(lengths.max())
        column = np.arange(width)
        valid = column < lengths[:, None]
        parts = np.full(valid.shape, 0, np.int64)
        parts[valid] = self.of_byte[gather(raw, starts, lengths)]
        n = lengths.copy()
        if width == 1:
            return parts, n
        ranks = np.full((len(n), width), NO_RANK, np.int64)
        both = valid[:, 1:]
        ranks[:, :-1][both] = self.pair_ranks(parts[:, :-1][both], parts[:, 1:][both])
        live = np.arange(len(n))
        while len(live):
            r = ranks[live]
            i = r.argmin(1)
            least = r[np.arange(len(live)), i]
            go = least < NO_RANK
            live, i, least, r = live[go], i[go], least[go], r[go]
            if not len(live):
                break
            row = np.arange(len(live))
            shift = np.minimum(column + (column > i[:, None]), width - 1)  # deletes the boundary after part i
            p = np.take_along_axis(parts[live], shift, 1)
            r = np.take_along_axis(r, np.minimum(column + (column >= i[:, None]), width - 1), 1)
            p[row, i] = self.joined[least]
            n[live] -= 1
            r[:, -1] = NO_RANK
            after, before = np.flatnonzero(i + 1 < n[live]), np.flatnonzero(i > 0)
            r[row, i] = NO_RANK
            r[after, i[after]] = self.pair_ranks(p[after, i[after]], p[after, i[after] + 1])
            r[before, i[before] - 1] = self.pair_ranks(p[before, i[before] - 1], p[before, i[before]])
            parts[live], ranks[live] = p, r
        return parts, n

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths
        n, pieces = np.zeros(len(words), np.int64), []
        for low, high in zip(WIDTHS, WIDTHS[1:], strict=False):
            of = np.flatnonzero((lengths > low) & (lengths <= high))
            for part in np.array_split(of, 1 + len(of) * high // (1 << 18)) if len(of) else ():
                ids, n[part] = self._joined(raw, starts[part], lengths[part])
                pieces.append((part, ids[np.arange(ids.shape[1]) < n[part, None]]))
        for j in np.flatnonzero(lengths > WIDTHS[-1]).tolist():
            ids = self._long_word(words[j])
            n[j] = len(ids)
            pieces.append((np.array([j]), np.array(ids, np.int64)))
        out, at = np.empty(int(n.sum()), np.int32), np.cumsum(n) - n
        for part, ids in pieces:
            out[gather(np.arange(len(out)), at[part], n[part])] = ids
        return out, n

    def _long_word(self, word: bytes) -> tuple[int, ...]:
        """The same ids by a heap over linked parts: the least rank first, then the leftmost."""
        from heapq import heapify, heappop, heappush

        n, ranks = len(word), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        at = lambda i: word[i : end[i]]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get((word[i : i + 1], word[i + 1 : i + 2]))) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = end[i]
            if j < 0 or j >= n or end[j] != stop:
                continue  # a part of the pair has been joined since
            end[i], end[j] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := ranks.get((at(i), at(stop)))) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get((at(p), at(i)))) is not None:
                heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(self.id_of[at(i)])
            i = end[i]
        return tuple(out)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        if len(texts) == 1 and len(texts[0]) > PIECE and not any(" " in s for s in self.special):
            ids = np.concatenate([self._encode([x])[0] for x in text_pieces(texts[0], _CUT, PIECE)])
            return ids, np.array([len(ids)])
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words: list[str] = []
        ends = []
        for text in texts:
            at = 0
            for m in self.at_special.finditer(text) if self.at_special else ():
                words += self.split.findall(text[at : m.start()])
                words.append(m[0])  # no word that the pattern splits off is a special token's string
                at = m.end()
            words += self.split.findall(text[at:] if at else text)
            ends.append(len(words))
        store = self.store
        numbers = store.numbers(words)
        if store.fresh:
            ids, n = self.words([w.encode("utf-8", "surrogatepass") for w in store.fresh])
            if self.special and (of := [k for k, w in enumerate(store.fresh) if w in self.special]):
                pieces = np.split(ids, np.cumsum(n)[:-1])
                for k in of:
                    pieces[k], n[k] = np.array([self.special[store.fresh[k]]], np.int32), 1
                ids = np.concatenate(pieces)
            store.learn(ids, n)
        ids, n = store.ids(numbers)
        sums = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.array(ends, np.int64)))]
        return ids, np.diff(sums)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of runs of ids. Bytes that aren't UTF-8 become U+FFFD; ids outside the vocabulary are skipped."""
        raw, n = [], np.zeros(len(ids) + 1, np.int64)
        for at in range(0, len(ids), PIECE):
            part = ids[at : at + PIECE].astype(np.int64)
            known = (part >= 0) & (part < self.size)
            part = np.where(known, part, 0)
            lengths = np.where(known, self.token_len[part], 0)
            raw.append(gather(self.token_bytes, self.token_at[part], lengths).tobytes())
            n[at + 1 : at + 1 + len(part)] = lengths
        whole, ends = b"".join(raw), np.cumsum(n)[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [whole[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One encoder for each Python worker."""
    return Bpe(path)


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts or lists have about `most` values together; a longer one is alone."""
    import pyarrow.compute as pc

    kind = pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length
    sums = np.cumsum(np.concatenate(([0], kind(column).fill_null(0).to_numpy(zero_copy_only=False))))
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(sums, sums[at] + most, "right")) - 1)
        yield at, to
        at = to


def _map(rows: DataFrame, fn, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to in slices(b.column(1)):
                yield fn(b.slice(at, to - at))

    return rows.mapInArrow(run, schema)


def bpe_encode(docs: DataFrame, vocab_path: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (array<int>), then the columns that carry names.

    A null text counts as empty and has no ids; rows that repeat are encoded each; other columns are
    ignored; no rows give no rows. Texts of any length are encoded whole.
    """

    def encode(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, n = load(vocab_path).encode([t or "" for t in b.column(1).to_pylist()])
        ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), *b.columns[2:]], names=["doc_id", "n_tokens", "ids", *carry])

    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return _map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry), encode, f"doc_id long, n_tokens long, ids array<int>{more}")


def bpe_decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """One row per row of `encoded` (doc_id, ids): doc_id, n_tokens, text, ids_sha256 (of the ids as little-endian unsigned 32-bit integers). Null ids count as none."""

    def decode(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column(1).fill_null([])
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        raw, ends = ids.astype("<u4").tobytes(), np.concatenate(([0], 4 * np.cumsum(counts))).tolist()
        sha = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(ends, ends[1:], strict=False)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(counts), pa.array(load(vocab_path).decode(ids, counts), pa.string()), pa.array(sha, pa.string())], names=["doc_id", "n_tokens", "text", "ids_sha256"])

    return _map(encoded.select("doc_id", "ids"), decode, "doc_id long, n_tokens long, text string, ids_sha256 string")
