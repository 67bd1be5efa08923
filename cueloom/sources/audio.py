"""PCM WAV files as rows: header, samples, slices and concatenations, from `binaryFile` or any binary column."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

HEADER = StructType([StructField(c, LongType()) for c in ("format", "channels", "rate", "align", "bits", "offset", "size")])


def header(data: bytes, length: int | None = None) -> dict | None:
    """Format and place of the samples of a RIFF file, of which data may be the first part (length: of the whole); None where it isn't one or they lie beyond data."""
    length = len(data) if length is None else length
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"fmt " and at + 24 <= len(data):
            kind, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            fmt = {"format": kind, "channels": channels, "rate": rate, "align": align, "bits": bits}
        if name == b"data":
            return fmt and fmt | {"offset": at + 8, "size": min(size, length - at - 8)}
        at += 8 + size + size % 2
    return None


def wav_head(size: int, h: dict) -> bytes:
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, h["format"], h["channels"], h["rate"], h["rate"] * h["align"], h["align"], h["bits"], b"data", size)


def wav(samples: bytes, h: dict) -> bytes:
    return wav_head(len(samples), h) + samples


def _cut(data: bytes, h: dict, start_s: float, end_s: float) -> bytes:
    n = h["size"] // h["align"]
    a, b = (min(n, max(0, int(x * h["rate"]))) for x in (start_s, end_s))
    return data[h["offset"] + a * h["align"] : h["offset"] + max(a, b) * h["align"]]


@F.pandas_udf(HEADER)
def wav_header(content: pd.Series) -> pd.DataFrame:
    names = ["format", "channels", "rate", "align", "bits", "offset", "size"]
    return pd.DataFrame([header(c) or dict.fromkeys(names) for c in content], columns=names).astype("Int64")


@F.pandas_udf(BinaryType())
def slice_wav(content: pd.Series, start_s: pd.Series, end_s: pd.Series) -> pd.Series:
    """A WAV file of the samples from start to end; null where content isn't one."""
    return pd.Series([(wav(_cut(c, h, a, b), h) if (h := header(c)) else None) for c, a, b in zip(content, start_s, end_s, strict=True)])


@F.pandas_udf(BinaryType())
def concat_wav(content: pd.Series, pieces: pd.Series) -> pd.Series:
    """A WAV file of several pieces (arrays of start and end seconds); empty ones are dropped, and null comes where nothing is left."""
    out = []
    for c, ps in zip(content, pieces, strict=True):
        h = header(c)
        parts = b"".join(_cut(c, h, p[0], p[1]) for p in ps if p[1] > p[0]) if h else b""
        out.append(wav(parts, h) if parts else None)
    return pd.Series(out)


def samples(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """media, i, x of mono 16-bit PCM files, x in -1 to 1; other files have no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, c in zip(f["media"], f["content"], strict=True):
                h = header(c)
                if h and (h["format"], h["channels"], h["bits"]) == (1, 1, 16):
                    x = np.frombuffer(c, "<i2", h["size"] // 2, h["offset"]) / 32768
                    for at in range(0, len(x), 1 << 20):
                        part = x[at : at + (1 << 20)]
                        yield pd.DataFrame({"media": name, "i": np.arange(at, at + len(part)), "x": part})

    return files.select(F.col(path).alias("media"), F.col(content).alias("content")).mapInPandas(run, "media string, i long, x double")


def block_aligned(seconds: Column, rate: int, align: int) -> Column:
    return F.floor(seconds * rate).cast("long") * align
