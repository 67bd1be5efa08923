"""Chat formatting: turns become template text by columnar byte assembly, and are parsed back.

Lengths of all segments are computed first, cumulative offsets place them, and headers and contents
are scattered into one preallocated Arrow buffer per batch. A turn's text depends on that turn alone,
so formatting needs no grouping, and a conversation of any length is never held whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices

#: The template's control strings.
OPEN, CLOSE = b"<|im_start|>", b"<|im_end|>"
LOSS_ROLE = b"assistant"
#: Bytes from which a segment is copied as one piece, so that no index grows with it.
LONG = 1 << 16

#: "<", any number of backslashes, "|": one more backslash makes control strings inert, one less brings them back.
_HIDE, _SHOW = re.compile(rb"<(\\*)\|"), re.compile(rb"<\\(\\*)\|")


def escape(text: bytes) -> bytes:
    return _HIDE.sub(rb"<\\\1|", text) if b"|" in text else text


def unescape(text: bytes) -> bytes:
    return _SHOW.sub(rb"<\1|", text) if b"|" in text else text


def escape_role(role: bytes) -> bytes:
    """A role is one line: its backslashes and line feeds are escaped too."""
    return escape(role.replace(b"\\", b"\\\\").replace(b"\n", b"\\n"))


def unescape_role(role: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], unescape(role), flags=re.S)


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.fromiter(map(len, parts), np.int64, len(parts))


def _scatter(view: np.ndarray, place: np.ndarray, parts: np.ndarray, lengths: np.ndarray) -> None:
    """Copies the parts, which lie one after another, to their places: by an index for each byte, but long ones as they are."""
    starts = np.cumsum(lengths) - lengths
    short = lengths < LONG
    for i in np.flatnonzero(~short).tolist():
        view[place[i] : place[i] + lengths[i]] = parts[starts[i] : starts[i] + lengths[i]]
    n, of = lengths[short], np.arange(int(lengths[short].sum()))
    within = of - np.repeat(np.cumsum(n) - n, n)
    view[np.repeat(place[short], n) + within] = parts[np.repeat(starts[short], n) + within]


def assemble(roles: list[bytes], texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted turns as one Arrow array, and where in each turn the loss mask begins and ends (equal: no loss)."""
    n = len(roles)
    names, name_len = _flat([escape_role(r) for r in roles])
    content, content_len = _flat([escape(t) for t in texts])
    fixed = np.frombuffer(OPEN + b"\n" + CLOSE + b"\n", np.uint8)
    lengths = np.stack([np.full(n, len(OPEN)), name_len, np.full(n, 1), content_len, np.full(n, len(CLOSE) + 1)], 1)
    place = np.cumsum(lengths.ravel()).reshape(n, 5) - lengths  # where each segment goes
    ends = place[:, 4] + lengths[:, 4]
    total = int(ends[-1]) if n else 0
    out = pa.allocate_buffer(total)
    view = np.frombuffer(out, np.uint8)
    view[place[:, :1] + np.arange(len(OPEN))] = fixed[: len(OPEN)]
    _scatter(view, place[:, 1], names, name_len)
    view[place[:, 2]] = ord("\n")
    _scatter(view, place[:, 3], content, content_len)
    view[place[:, 4:] + np.arange(len(CLOSE) + 1)] = fixed[len(OPEN) + 1 :]
    starts = np.concatenate(([0], ends)).astype(np.int64)
    loss = np.array([r == LOSS_ROLE for r in roles], bool)
    begin = np.where(loss, place[:, 3] - starts[:-1], 0)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(starts), out]), begin, np.where(loss, begin + content_len, 0)


FORMATTED = "conv_id long, turn long, formatted binary, loss_begin long, loss_end long"


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, its formatted bytes, and the bytes of it that bear loss (assistants' texts).

    A null text or role counts as empty. A null conv_id is a conversation of its own; within a
    conversation rows go by turn (null first), then by formatted bytes, and repeated rows all count.
    Extra columns are ignored; no rows give no rows.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to in slices(b.column(3)):
                part = b.slice(at, to - at)
                out, begin, end = assemble(part.column(2).to_pylist(), part.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), out.cast(pa.binary()), pa.array(begin), pa.array(end)], names=["conv_id", "turn", "formatted", "loss_begin", "loss_end"])

    return rows.mapInArrow(run, FORMATTED)


_TURN = re.compile(re.escape(OPEN) + rb"([^\n]*)\n(.*?)" + re.escape(CLOSE) + rb"\n", re.S)
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn in formatted text; ValueError if it is anything else."""
    out, at = [], 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError("not in the template")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _chars(text: bytes) -> int:
    return len(text) - int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted turns.

    A digest of texts in order can't be put together from parts, so a conversation's turns stream
    through one task, batch by batch; only the running digests are kept.
    """
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")

    class State:
        def __init__(self):
            self.n = self.loss = self.chars = 0
            self.turns, self.lost = hashlib.sha256(), hashlib.sha256()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, conv, seen = State(), None, False

        def row(s: State, c) -> tuple:
            return c, s.n, s.turns.hexdigest(), s.loss, s.lost.hexdigest(), s.chars

        for b in batches:
            out = []
            for c, raw, begin, end in zip(b.column(0).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if not seen or c != conv:
                    out += [row(state, conv)] if seen else []
                    state, conv, seen = State(), c, True
                raw = raw.as_py()
                state.chars += _chars(raw)
                for role, text in parse(raw):
                    state.n += 1
                    state.turns.update(role + b"\n" + text + b"\n")
                lost = unescape(raw[begin:end])
                state.lost.update(lost)
                state.loss += _chars(lost)
            if out:
                yield _rows(out)
        if seen:
            yield _rows([row(state, conv)])

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(run, DIGESTS)
