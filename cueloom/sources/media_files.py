"""Subtitle and WAV files as Spark data sources: cues and samples as rows, read by file and written one file a medium.

    media_files.register(spark)
    spark.read.format("subtitles").load(folder)                          # media, kind, at, start_ms, end_ms, text
    cues.write.format("subtitles").option("kind", "srt").mode("append").save(folder)
    spark.read.format("wav").option("rows", "samples").load(folder)      # or headers, or files
    samples.write.format("wav").option("rate", 16000).mode("append").save(folder)

Files are dealt to tasks by size, and a long WAV file by ranges of samples; many small ones share a task. A file's name is its medium's, quoted as in URLs.
Written rows must be sorted by medium and place in each task, with all of a medium in one: repartition("media")
and sortWithinPartitions. Files go through pyarrow's file systems and become visible when the job is committed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from cueloom import storage
from cueloom.functions.text import SPACE
from cueloom.sources import audio
from cueloom.sources.subtitles import ASS_LINE, SRT_TIME, VTT_TIME

CUES = "media string, kind string, at long, start_ms long, end_ms long, text string"
ROWS = {
    "samples": "media string, i long, x double",
    "headers": "media string, format long, channels long, rate long, align long, bits long, offset long, size long",
    "files": "media string, content binary",
}
KINDS = ("vtt", "srt", "ass")
#: Bytes of files that one task reads, unless the option "split" says otherwise, and of a range of a WAV file.
SPLIT = 32 << 20
#: Beyond so many tasks, each takes more files or ranges than "split" says, but not more than SPLIT.
TASKS = 64
#: Rows of a batch that a reader gives out, and samples of WAV files.
BATCH, SAMPLES = 8192, 1 << 18

_SPACES = SPACE.encode("ascii").decode("unicode_escape")
_ENDS = re.compile(f"^{_SPACES}+|{_SPACES}+$")
_TIMES = {"vtt": re.compile(VTT_TIME, re.ASCII), "srt": re.compile(SRT_TIME, re.ASCII)}
_ASS = re.compile(ASS_LINE, re.ASCII)


def _ms(parts: tuple[str, ...], fraction: int = 1) -> int:
    h, m, s, f = map(int, parts)
    return ((h * 60 + m) * 60 + s) * 1000 + f * fraction


def cues_of(content: str, kind: str) -> Iterator[tuple[int, int, str]]:
    """(start_ms, end_ms, text) of each cue of a file. kind vtt: time lines with a point, texts as they are; any other: SRT, VTT and ASS lines, without tags.

    A cue is a time line and what follows it to the next blank line; one without text is left out.
    """
    loose = kind != "vtt"
    pattern, cue = _TIMES["srt" if loose else "vtt"], None
    bare = lambda s: _ENDS.sub("", s)

    def ended():
        if cue and cue[2]:
            text = "\n".join(cue[2])
            text = bare(re.sub("<[^>]+>", "", text)) if loose else text
            if text or not loose:
                yield cue[0], cue[1], text

    for line in content.replace("\r\n", "\n").split("\n"):
        short = bare(line)
        if cue is not None:
            if short:
                cue[2].append(line)
                continue
            yield from ended()
            cue = None
        if m := pattern.match(short if loose else line):
            cue = (_ms(m.groups()[:4]), _ms(m.groups()[4:8]), [])
        elif loose and (m := _ASS.match(short)):
            g = m.groups()
            if said := bare(re.sub(r"\{[^}]*\}", "", g[8].replace("\\N", "\n"))):
                yield _ms(g[:4], 10), _ms(g[4:8], 10), said
    yield from ended()


@dataclass
class Files(InputPartition):
    """Files of one task: path and size."""

    names: list[tuple[str, int]]


@dataclass
class Ranges(InputPartition):
    """Samples of one task: path and size of a file, the first sample and how many at most."""

    pieces: list[tuple[str, int, int, int]]


def _medium(path: str) -> tuple[str, str]:
    stem, _, kind = path.rpartition("/")[2].rpartition(".")
    return unquote(stem or kind), kind.lower() if stem else ""


class _Reader(DataSourceReader):
    kinds: tuple[str, ...] = ()

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def files(self) -> list[tuple[str, int]]:
        _, found = storage.visible(self.path)
        return [(f.path, f.size) for f in found if _medium(f.path)[1] in self.kinds]

    def room(self, files: list[tuple[str, int]]) -> int:
        """Bytes of one task's files, opening them included."""
        return max(self.split, min(SPLIT, sum(n + storage.OPEN for _, n in files) // TASKS))

    def partitions(self) -> list[InputPartition]:
        files = self.files()
        return [Files(x) for x in storage.packed(files, self.room(files))] or [Files([])]  # none at all would be read as a partition of None

    def content(self, path: str) -> bytes:
        store, _ = storage.opened(self.path)
        with store.open_input_stream(path) as f:
            return f.read()


class SubtitleReader(_Reader):
    kinds = KINDS

    def __init__(self, options: dict):
        super().__init__(options)
        self.parser = options.get("parser", "extension")

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path, _ in partition.names:
            media, kind = _medium(path)
            text = self.content(path).decode("utf-8", "replace").removeprefix("﻿")
            rows: list[tuple] = []
            for at, cue in enumerate(cues_of(text, kind if self.parser == "extension" else self.parser)):
                rows.append((at, *cue))
                if len(rows) == BATCH:
                    yield self._batch(media, kind, rows)
                    rows = []
            if rows:
                yield self._batch(media, kind, rows)

    def _batch(self, media: str, kind: str, rows: list[tuple]) -> pa.RecordBatch:
        at, start, end, text = zip(*rows, strict=True)
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([media] * n), pa.array([kind] * n), *(pa.array(x, pa.int64()) for x in (at, start, end)), pa.array(text, pa.string())], names=["media", "kind", "at", "start_ms", "end_ms", "text"])


class WavReader(_Reader):
    kinds = ("wav",)

    def __init__(self, options: dict):
        super().__init__(options)
        self.rows = options.get("rows", "samples")

    def header(self, f, size: int) -> dict | None:
        head = f.read(min(size, 1 << 16))
        if (h := audio.header(head, size)) or size <= len(head) or head[:4] != b"RIFF":
            return h
        f.seek(0)
        return audio.header(f.read(size), size)

    def partitions(self) -> list[InputPartition]:
        """Files by size; samples of files over `split` bytes in ranges of as many, of which a task takes those that fit."""
        if self.rows != "samples":
            return super().partitions()
        files, step = self.files(), max(1, self.split // 2)
        room, left = self.room(files), -1
        parts: list[Ranges] = []
        for path, size in files:
            at, n = 0, size // 2  # with the header, so there may be fewer
            while at < n:
                one = storage.OPEN + min(size, 2 * step)
                if not parts or left < one:
                    parts.append(Ranges([]))
                    left = room
                many = max(1, (left - storage.OPEN) // (2 * step)) * step if size > self.split else n
                parts[-1].pieces.append((path, size, at, many))
                left -= storage.OPEN + 2 * min(many, n - at)
                at += many
        return parts or [Ranges([])]

    def pieces(self, store, ranges: list[tuple[str, int, int, int]]) -> Iterator[tuple[str, int, np.ndarray]]:
        """Medium, place of the first sample, and samples, at most SAMPLES at once."""
        for path, size, first, count in ranges:
            with store.open_input_file(path) as f:
                h = self.header(f, size)
                if not h or (h["format"], h["channels"], h["bits"]) != (1, 1, 16):
                    continue
                end = min(h["size"] // 2, first + count)
                f.seek(h["offset"] + 2 * first)
                for at in range(first, end, SAMPLES):
                    yield _medium(path)[0], at, np.frombuffer(f.read(2 * min(SAMPLES, end - at)), "<i2")

    def _batch(self, held: list[tuple[str, int, np.ndarray]]) -> pa.RecordBatch:
        names, firsts, xs = zip(*held, strict=True)
        sizes = [len(x) for x in xs]
        media = pa.DictionaryArray.from_arrays(np.repeat(np.arange(len(names), dtype=np.int32), sizes), pa.array(names, pa.string())).cast(pa.string())
        i = np.concatenate([np.arange(at, at + n) for at, n in zip(firsts, sizes, strict=True)])
        return pa.RecordBatch.from_arrays([media, pa.array(i), pa.array(np.concatenate(xs) / 32768)], names=["media", "i", "x"])

    def read(self, partition: Files | Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = storage.opened(self.path)
        if isinstance(partition, Ranges):
            held: list[tuple[str, int, np.ndarray]] = []
            n = 0
            for piece in self.pieces(store, partition.pieces):
                if held and n + len(piece[2]) > SAMPLES:
                    yield self._batch(held)
                    held, n = [], 0
                held.append(piece)
                n += len(piece[2])
            if held:
                yield self._batch(held)
            return
        for path, size in partition.names:
            media = _medium(path)[0]
            if self.rows == "files":
                yield pa.RecordBatch.from_pydict({"media": pa.array([media]), "content": pa.array([self.content(path)], pa.binary())})
                continue
            with store.open_input_file(path) as f:
                h = self.header(f, size)
            names = ["format", "channels", "rate", "align", "bits", "offset", "size"]
            yield pa.RecordBatch.from_pydict({"media": pa.array([media])} | {n: pa.array([h and h[n]], pa.int64()) for n in names})


@dataclass
class Part(WriterCommitMessage):
    name: str
    files: int


class _Writer(DataSourceArrowWriter):
    """One file a medium, from rows that come sorted by medium."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def begin(self, media: str, first: pa.RecordBatch) -> bytes:
        return b""

    def end(self) -> bytes:
        return b""

    def encode(self, rows: pa.RecordBatch, at: int) -> bytes:
        raise NotImplementedError

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        store, folder, name = storage.new_part(self.path)
        media, out, n, done = None, None, 0, set()
        try:
            for b in batches:
                of = b.column(b.schema.get_field_index("media"))
                if of.null_count:
                    raise ValueError("a file needs a medium's name")
                starts = np.flatnonzero(np.array(of.slice(1)) != np.array(of.slice(0, len(of) - 1))) + 1 if len(of) > 1 else []
                cuts = [0, *map(int, starts), len(b)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if lo == hi:
                        continue
                    rows, this = b.slice(lo, hi - lo), str(of[lo].as_py())
                    if this != media:
                        if out:
                            out.write(self.end())
                            out.close()
                        if this in done:
                            raise ValueError(f"rows of {this} aren't together: sort by media")
                        done.add(this)
                        media, n = this, 0
                        out = store.open_output_stream(f"{folder}/{quote(this, safe='')}.{self.kind}")
                        out.write(self.begin(this, rows))
                    out.write(self.encode(rows, n))
                    n += len(rows)
            if out:
                out.write(self.end())
        finally:
            if out:
                out.close()
        return Part(name, len(done))

    def commit(self, messages: list[Part | None]) -> None:
        storage.commit(self.path, [m.name for m in messages if m and m.files], self.overwrite)

    def abort(self, messages: list[Part | None]) -> None:
        storage.discard(self.path, [m.name for m in messages if m])


def _clock(ms: int, mark: str, places: int = 3) -> str:
    return f"{ms // 3_600_000:02}:{ms // 60_000 % 60:02}:{ms // 1000 % 60:02}{mark}{ms % 1000 // 10 ** (3 - places):0{places}}"


class SubtitleWriter(_Writer):
    """Rows media, start_ms, end_ms, text in the order of the cues. ASS has hundredths of a second: the rest is cut off."""

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, overwrite)
        self.kind = options.get("kind", "vtt")
        if self.kind not in KINDS:
            raise ValueError(f"no such kind of subtitles: {self.kind}")

    def begin(self, media: str, first: pa.RecordBatch) -> bytes:
        return {"vtt": b"WEBVTT\n\n", "srt": b"", "ass": b"[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"}[self.kind]

    def encode(self, rows: pa.RecordBatch, at: int) -> bytes:
        out = []
        for i, r in enumerate(rows.select(["start_ms", "end_ms", "text"]).to_pylist(), at + 1):
            text = r["text"] or ""
            if self.kind == "ass":
                out.append(f"Dialogue: 0,{_clock(r['start_ms'], '.', 2)},{_clock(r['end_ms'], '.', 2)},Default,,0,0,0,,{text.replace(chr(10), chr(92) + 'N')}\n")
            else:
                mark = "." if self.kind == "vtt" else ","
                number = f"{i}\n" if self.kind == "srt" else ""
                out.append(f"{number}{_clock(r['start_ms'], mark)} --> {_clock(r['end_ms'], mark)}\n{text}\n\n")
        return "".join(out).encode()


class WavWriter(_Writer):
    """Rows media, i, x, n (samples of the medium: a header states its size first) as mono 16-bit PCM."""

    kind = "wav"

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, overwrite)
        self.rate = int(options.get("rate", 16_000))

    def begin(self, media: str, first: pa.RecordBatch) -> bytes:
        self.left = first.column("n")[0].as_py()
        h = {"format": 1, "channels": 1, "rate": self.rate, "align": 2, "bits": 16}
        return audio.wav_head(2 * self.left, h)

    def encode(self, rows: pa.RecordBatch, at: int) -> bytes:
        i = rows.column("i").to_numpy()
        if (i != np.arange(at, at + len(i))).any():
            raise ValueError("samples aren't in order from 0: sort by media, i")
        self.left -= len(i)
        return np.clip(np.rint(rows.column("x").to_numpy() * 32768), -32768, 32767).astype("<i2").tobytes()

    def end(self) -> bytes:
        if self.left:
            raise ValueError("n isn't the number of samples")
        return b""


class Subtitles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "subtitles"

    def schema(self) -> str:
        return CUES

    def reader(self, schema: StructType) -> SubtitleReader:
        return SubtitleReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> SubtitleWriter:
        return SubtitleWriter(dict(self.options), overwrite)


class Wav(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return ROWS[self.options.get("rows", "samples")]

    def reader(self, schema: StructType) -> WavReader:
        return WavReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WavWriter:
        return WavWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    for source in (Subtitles, Wav):
        spark.dataSource.register(source)
