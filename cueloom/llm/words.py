"""Words of many texts at once: boundaries and 64-bit hashes from flat byte arrays, without an object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import GOLDEN, gather, mix64

#: Bytes of text that are worked on together; a longer text is alone, and is worked on in steps of STEP bytes or words.
SLICE_BYTES = 1 << 20
STEP = 1 << 20

_AZ = bytes(range(65, 91))
_lowered = lambda keep: bytes((b + 32 if b in _AZ else b) if keep(b + 32 if b in _AZ else b) else 32 for b in range(256))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z were lowered: digits, a-z and all of non-ASCII.
ALNUM = _lowered(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b > 127)
#: [^\x20\x09-\x0D]+ after A-Z were lowered.
SPACED = _lowered(lambda b: b != 32 and not 9 <= b <= 13)

#: The same with all letters as they are.
EXACT = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))

_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def eights(raw: np.ndarray) -> np.ndarray:
    """At each place the eight bytes from there on as one little-endian number; raw has eight more bytes at its end than are asked for."""
    return np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end]. raw is padded as in eights().

    Every eight bytes are mixed with their place by a bijection before they are summed, and the length
    is mixed into the sum: words of up to eight bytes differ in what is mixed, and no pattern of
    repetition in longer ones cancels out.
    """
    loads = eights(raw)
    n = end - start
    with np.errstate(over="ignore"):
        out = mix64((loads[start] & _MASK[np.minimum(n, 8)]) + GOLDEN)
        if len(long := np.flatnonzero(n > 8)):
            blocks = (n[long] - 1) // 8  # besides the first
            first = np.cumsum(blocks) - blocks
            at = np.arange(int(blocks.sum())) - np.repeat(first, blocks) + 1
            of = np.repeat(long, blocks)
            rest = loads[start[of] + 8 * at] & _MASK[np.minimum(n[of] - 8 * at, 8)]
            out[long] += np.add.reduceat(mix64(rest + GOLDEN * (at + 1).astype(np.uint64)), first)
        return mix64(out + n.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


class Words:
    """raw: normalised bytes of some texts, one after another; text i has the words first[i] to first[i + 1] - 1, word j the bytes start[j] to end[j] - 1.

    The bytes are read, and the words hashed, in steps, so that a long text needs little more than
    its bytes, its words' places and their hashes.
    """

    def __init__(self, raw: np.ndarray, ends: np.ndarray, kind: bytes):
        size, table = len(raw), np.frombuffer(kind, np.uint8)
        self.raw = np.full(size + 8, 32, np.uint8)
        cut = np.zeros(0, np.int64) if len(ends) < 2 else ends[:-1][(ends[:-1] > 0) & (ends[:-1] < size)]  # a text's end ends a word
        begins, stops, before = [], [], False
        for at in range(0, size, STEP):
            to = min(size, at + STEP)
            self.raw[at:to] = table[raw[at:to]]
            inside = np.empty(to - at + 1, bool)
            inside[0] = before
            np.not_equal(self.raw[at:to], 32, out=inside[1:])
            before = bool(inside[-1])
            b, s = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
            here = cut[(cut >= at) & (cut < to)] - at
            b[here] |= inside[1:][here]
            s[here] |= inside[:-1][here]
            begins.append(np.flatnonzero(b) + at)
            stops.append(np.flatnonzero(s) + at)
        if before:
            stops.append(np.array([size]))
        self.start, self.end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begins, stops))
        self.first = np.concatenate(([0], np.searchsorted(self.start, ends)))
        self.hash = np.empty(len(self.start), np.uint64)
        for at in range(0, len(self.start), STEP):
            self.hash[at : at + STEP] = hashes(self.raw, self.start[at : at + STEP], self.end[at : at + STEP])

    def __len__(self) -> int:
        return len(self.first) - 1

    def word(self, j: int) -> bytes:
        return self.raw[self.start[j] : self.end[j]].tobytes()

    def text_of(self) -> np.ndarray:
        """For each word the text it is in."""
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    def windows(self, k: int, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words by the position of their first word, from lo to hi - 1, and which of them lie inside one text."""
        hi = len(self.hash) if hi is None else hi
        n = min(hi, len(self.hash) - k + 1) - lo
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(lo, lo + k):  # odd multipliers, so no word's bits are lost
                out = (out + self.hash[i : i + n]) * np.uint64(0xD6E8FEB86659FD93)
                out ^= out >> np.uint64(29)
        text = np.searchsorted(self.first, np.arange(lo, lo + n), "right") if len(self) > 1 else None
        whole = np.ones(n, bool) if text is None else self.first[text] >= np.arange(lo, lo + n) + k
        return mix64(out), whole


def in_slices(column: pa.Array, kind: bytes) -> Iterator[tuple[int, Words]]:
    """(position of the first text, words) of about SLICE_BYTES of texts at a time; null texts are empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_string(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, Words(data[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at], kind)
        at = to


def _grown(a: np.ndarray, size: int) -> np.ndarray:
    if len(a) >= size:
        return a
    more = np.zeros(max(size, 2 * len(a)), a.dtype)
    more[: len(a)] = a
    return more


class KnownWords:
    """Words with the ids of each, in flat arrays: an open-addressing table by hash, and the words' bytes, which are compared.

    When `limit` words, or LIMIT_BYTES of them, are held, those met once are forgotten (or all are, if
    most were met again).
    """

    LIMIT_BYTES = 64 << 20

    def __init__(self, limit: int):
        self.limit, self.bits = limit, max(10, int(2 * limit).bit_length())
        self._clear()

    def _clear(self) -> None:
        self.n = self.used = self.raw_used = 0
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.hash, self.place, self.size, self.again = np.zeros(1024, np.uint64), np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, bool)
        self.raw = np.zeros(1 << 14, np.uint8)
        self.flat, self.starts, self.lengths = np.zeros(1024, np.int32), np.zeros(1024, np.int64), np.zeros(1024, np.int32)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _same(self, words: Words, j: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Whether words j are the known words e, of the same hashes: their lengths and all their bytes are compared."""
        n = words.end[j] - words.start[j]
        same = n == self.size[e]
        ours, theirs = eights(self.raw), eights(words.raw)
        mask = _MASK[np.minimum(n, 8)]
        same &= (ours[self.place[e]] & mask) == (theirs[words.start[j]] & mask)
        if len(long := np.flatnonzero(same & (n > 8))):
            blocks = (n[long] - 1) // 8
            first = np.cumsum(blocks) - blocks
            at = np.arange(int(blocks.sum())) - np.repeat(first, blocks) + 1
            of = np.repeat(long, blocks)
            mask = _MASK[np.minimum(n[of] - 8 * at, 8)]
            equal = (ours[self.place[e[of]] + 8 * at] & mask) == (theirs[words.start[j[of]] + 8 * at] & mask)
            same[long] = np.logical_and.reduceat(equal, first)
        return same

    def find(self, words: Words, j: np.ndarray) -> np.ndarray:
        """The numbers of words j; -1 for unknown ones."""
        out, h = np.full(len(j), -1, np.int64), words.hash[j]
        live, slot = np.arange(len(j)), self._slots(h)
        while len(live):
            e = self.table[slot].astype(np.int64)
            some = e >= 0
            live, slot, e = live[some], slot[some], e[some]
            alike = np.flatnonzero(self.hash[e] == h[live])
            right = alike[self._same(words, j[live[alike]], e[alike])]
            out[live[right]] = e[right]
            go_on = np.ones(len(live), bool)
            go_on[right] = False
            live, slot = live[go_on], (slot[go_on] + 1) & ((1 << self.bits) - 1)
        return out

    def numbers(self, words: Words, learn) -> np.ndarray:
        """The numbers of all words; learn(list of bytes) gives the flat ids of those that aren't known, and how many each has."""
        if self.n >= self.limit or self.raw_used > self.LIMIT_BYTES:
            self._forget()
        out = self.find(words, np.arange(len(words.hash)))
        self.again[out[out >= 0]] = True
        missing = np.flatnonzero(out < 0)
        while len(missing):  # once, but for words whose hashes are equal
            _, first = np.unique(words.hash[missing], return_index=True)
            new = missing[np.sort(first)]
            ids, lengths = learn([words.word(j) for j in new.tolist()])
            size = words.end[new] - words.start[new]
            self._put(words.hash[new], gather(words.raw, words.start[new], size), size, ids, lengths)
            out[missing] = self.find(words, missing)
            missing = missing[out[missing] < 0]
        return out

    def _put(self, h: np.ndarray, raw: np.ndarray, size: np.ndarray, ids: np.ndarray, lengths: np.ndarray, again: bool = False) -> None:
        at, to = self.n, self.n + len(h)
        while 2 * to > len(self.table):  # one slice may hold more words than the limit
            self.bits += 1
            self.table = np.full(1 << self.bits, -1, np.int32)
            self._enter(np.arange(self.n))
        for name in ("hash", "place", "size", "again", "starts", "lengths"):
            setattr(self, name, _grown(getattr(self, name), to))
        self.raw, self.flat = _grown(self.raw, self.raw_used + len(raw) + 8), _grown(self.flat, self.used + len(ids))
        self.hash[at:to], self.size[at:to], self.lengths[at:to], self.again[at:to] = h, size, lengths, again
        self.place[at:to], self.starts[at:to] = self.raw_used + np.cumsum(size) - size, self.used + np.cumsum(lengths) - lengths
        self.raw[self.raw_used : self.raw_used + len(raw)], self.flat[self.used : self.used + len(ids)] = raw, ids
        self.raw_used, self.used, self.n = self.raw_used + len(raw), self.used + len(ids), to
        self._enter(np.arange(at, to))

    def _enter(self, left: np.ndarray) -> None:
        """Puts these numbers into free slots."""
        slot = self._slots(self.hash[left])
        while len(left):
            free = np.flatnonzero(self.table[slot] < 0)
            self.table[slot[free]] = left[free]
            on = self.table[slot] != left
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)

    def _forget(self) -> None:
        often = np.flatnonzero(self.again[: self.n])
        often = often if 2 * len(often) < self.limit else often[:0]
        ids, lengths = self.ids(often)
        kept = self.hash[often], gather(self.raw, self.place[often], self.size[often]), self.size[often], ids, lengths
        self._clear()
        self._put(*kept)

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words, and how many each has."""
        lengths = self.lengths[numbers].astype(np.int64)
        return gather(self.flat, self.starts[numbers], lengths), lengths
