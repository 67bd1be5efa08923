"""Archives of named parts as a data source: one ZIP file a medium, with a list of its parts' sizes and hashes.

    bundles.register(spark)
    parts.write.format("bundle").mode("append").save(folder)      # media, name, seq, content
    spark.read.format("bundle").load(folder)                      # media, name, size, sha256, content

A part's content may come in several rows, which are written one after another in the order of seq, so that no
part is ever held as a whole. Rows must be sorted by medium, name and seq in each task: see sorted_parts(). Archives
become visible when the whole job is committed; reading one checks every part against the list.
"""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import StructType

from cueloom.sources.media_files import Files, _medium, _Reader, _Writer

PARTS = "media string, name string, size long, sha256 string, content binary"
#: The part that lists the others.
LIST = "parts.json"


class _Drain(io.RawIOBase):
    """Holds what was written until it is taken; it can't be rewound, so sizes follow each entry of the archive."""

    def __init__(self):
        self.held = bytearray()

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.held += data
        return len(data)

    def take(self) -> bytes:
        out, self.held = bytes(self.held), bytearray()
        return out


class BundleWriter(_Writer):
    kind = "zip"

    def begin(self, media: str, first: pa.RecordBatch) -> bytes:
        self.drain = _Drain()
        self.zip = zipfile.ZipFile(self.drain, "w", zipfile.ZIP_DEFLATED)
        self.parts: list[dict] = []
        self.entry = None
        return b""

    def _close(self) -> None:
        if self.entry:
            self.entry.close()
            self.parts[-1]["sha256"] = self.sha.hexdigest()
            self.entry = None

    def _open(self, name: str) -> None:
        self._close()
        if name == LIST or any(p["name"] == name for p in self.parts):
            raise ValueError(f"part {name} of an archive comes twice: sort by media, name, seq")
        self.parts.append({"name": name, "size": 0})
        self.sha = hashlib.sha256()
        info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))  # the same parts give the same archive
        info.compress_type = zipfile.ZIP_DEFLATED
        self.entry = self.zip.open(info, "w")

    def encode(self, rows: pa.RecordBatch, at: int) -> bytes:
        for name, content in zip(rows.column("name").to_pylist(), rows.column("content").to_pylist(), strict=True):
            if not self.parts or self.parts[-1]["name"] != name:
                self._open(name)
            raw = content.encode() if isinstance(content, str) else content or b""
            self.entry.write(raw)
            self.sha.update(raw)
            self.parts[-1]["size"] += len(raw)
        return self.drain.take()

    def end(self) -> bytes:
        self._close()
        self.zip.writestr(zipfile.ZipInfo(LIST, (1980, 1, 1, 0, 0, 0)), json.dumps(self.parts))
        self.zip.close()
        return self.drain.take()


class BundleReader(_Reader):
    kinds = ("zip",)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path, _ in partition.names:
            media = _medium(path)[0]
            with zipfile.ZipFile(io.BytesIO(self.content(path))) as z:
                listed = json.loads(z.read(LIST))
                if sorted(z.namelist()) != sorted([LIST, *(p["name"] for p in listed)]):
                    raise ValueError(f"{path}: its parts aren't those of its list")
                for p in listed:
                    content = z.read(p["name"])
                    if (len(content), hashlib.sha256(content).hexdigest()) != (p["size"], p["sha256"]):
                        raise ValueError(f"{path}: {p['name']} isn't what was written")
                    yield pa.RecordBatch.from_pydict({"media": pa.array([media]), "name": pa.array([p["name"]]), "size": pa.array([len(content)], pa.int64()), "sha256": pa.array([p["sha256"]]), "content": pa.array([content], pa.binary())})


class Bundle(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return PARTS

    def reader(self, schema: StructType) -> BundleReader:
        return BundleReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> BundleWriter:
        return BundleWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Bundle)


def sorted_parts(parts: DataFrame) -> DataFrame:
    """parts (media, name, seq, content) as the writer needs them: media dealt over tasks, each one's rows in order."""
    return parts.select(F.col("media").cast("string").alias("media"), "name", "seq", "content").repartition("media").sortWithinPartitions("media", "name", "seq")
