"""WARC archives: records with revisits for equal payloads, a reader, and capture indexes merged by loser trees.

Archives are written by Spark's text writer, whose line separator is the end of a WARC record: its
commit protocol covers lost executors and any store that Spark reaches. Each file is a run of
captures sorted by URL key and timestamp; the runs' indexes are range-partitioned, and a loser tree
merges the runs of each range into globally ordered capture histories.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timedelta
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import settled, shared_dir
from .exact_dedup import HEAVY_K, frequent

#: Captures in a file: bounds what a reader holds.
FILE_RECORDS = 4096
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of page 0 where pages have no capture time of their own; page n counts as n seconds later.
FIRST_DATE = datetime(2024, 1, 1)
#: Seconds from FIRST_DATE to the end of year 9999, the last that a record's date can name; pages beyond it share that last second.
_LAST_SECOND = int((datetime(9999, 12, 31, 23, 59, 59) - FIRST_DATE).total_seconds())
_FIRST_SECOND = -int((FIRST_DATE - datetime(1, 1, 1)).total_seconds())
#: Index rows of a range, which one task merges: bounds what it holds, whatever the number of captures.
RANGE_ROWS = 100_000


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """Sort-friendly form of a URL: host labels reversed, then the path and query in lower case; no scheme, user, default port or fragment."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^#]*)", url.strip().lower(), re.S)
    host, port, rest = m.groups()
    host = re.sub(r"^www\d*\.", "", host)
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in ("80", "443") else "") + ")" + (rest or "/")


def target_uri(url: str) -> str:
    """url as records hold it: ASCII, with what a URL can't have escaped. Keys are made from it on both sides, so that runs are in the order of the merge."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")


def stamp(page_id: int | None) -> str:
    """The date of a page, in the order of page ids; ids outside of the years 1 to 9999 have the first or last second of them."""
    return (FIRST_DATE + timedelta(seconds=min(max(page_id or 0, _FIRST_SECOND), _LAST_SECOND))).isoformat() + "Z"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """A record without its closing blank lines. A revisit has the HTTP header alone, with the payload's length in it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [f"WARC/1.1\r\nWARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {stamp(page_id)}", f"WARC-Target-URI: {target_uri(url)}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*head, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]).encode() + block


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record; ValueError where bytes aren't WARC."""
    at = 0
    while at < len(data):
        head_end = data.find(b"\r\n\r\n", at)
        lines = data[at:head_end].decode("utf-8").split("\r\n") if head_end >= 0 else [""]
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, size = head_end + 4, int(headers["content-length"])
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield at, start + size + 4 - at, headers, data[start : start + size]
        at = start + size + 4


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def first_captures(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, html) with `refers_to`: the smallest page_id whose payload is the same, or null for that page itself.

    Payloads under `least` bytes and pages without an id refer to nothing. Frequent payloads are
    found by their digests, and their first pages broadcast; the rest are joined by digest.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    narrow = settled(rows.where(F.octet_length("html") >= least).select("page_id", "digest"))
    first = lambda x: x.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    heavy = F.broadcast(frequent(narrow, HEAVY_K))
    hot = settled(first(narrow.join(heavy, "digest")))  # at most HEAVY_K rows
    cold = settled(first(narrow.join(F.broadcast(hot), "digest", "left_anti")))  # written, so that its measured size decides how it is joined
    both = rows.join(F.broadcast(hot), "digest").unionByName(rows.join(F.broadcast(hot), "digest", "left_anti").join(cold, "digest", "left"))
    other = F.col("first").isNotNull() & F.col("page_id").isNotNull() & (F.col("first") != F.col("page_id")) & (F.octet_length("html") >= least)
    return both.select("page_id", "url", "html", F.when(other, F.col("first")).alias("refers_to"))


def write_warc(captures: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Gzipped archives of captures (page_id, url, html, refers_to) below path; each file is sorted by URL key, timestamp and page."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to in slices(b.column(2)):
                rows = list(zip(*(c.to_pylist() for c in b.slice(at, to - at).columns), strict=True))
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array([url_key(target_uri(r[1])) for r in rows], pa.string()), "ts": pa.array([stamp(r[0]) for r in rows], pa.string()), "page_id": pa.array([r[0] for r in rows], pa.int64()),
                    "value": pa.array([record(r[0], r[1], r[2].encode(), r[3]).decode() for r in rows], pa.string()),
                })

    rows = captures.select("page_id", "url", "html", "refers_to").mapInArrow(build, "key string, ts string, page_id long, value string")
    runs = rows.sortWithinPartitions("key", "ts", "page_id").select("value")
    runs.write.option("lineSep", END).option("maxRecordsPerFile", file_records).option("compression", "gzip").text(path)


INDEX = "url_key string, ts string, page_id long, run string, seq long, offset long, length long, record_type string, refers_to long, payload_bytes long, payload_digest string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """An index row for each record of the archives below path, read whole: url_key, ts, page_id, run (its file), seq (its place there), offset, length, record_type, refers_to, payload_bytes, payload_digest.

    A response's length and digest come from its payload, a revisit's from its headers. Archives
    may be gzipped; offsets and lengths are those in the unpacked file.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for run, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out = []
                raw = data.as_py()
                for seq, (offset, length, h, block) in enumerate(parse(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    if h["warc-type"] == "revisit":
                        size, digest = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)[1]), h["warc-payload-digest"].removeprefix("sha1:")
                    else:
                        size, digest = len(payload), payload_digest(payload)
                    out.append((url_key(h["warc-target-uri"]), h["warc-date"], _page(h["warc-record-id"]), run, seq, offset, length, h["warc-type"], _page(h.get("warc-refers-to")), size, digest))
                if out:
                    yield _index_rows(out)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(read, INDEX)


def _index_rows(out: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so the next winner costs one match a level."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key = runs, key
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        kx, ky = self.key(x), self.key(y)
        return kx < ky or kx == ky and a < b

    def _play(self, leaf: int) -> None:
        node, winner = (leaf + self.k) // 2, leaf
        while node:
            other = self.losers[node]
            if other < 0:  # the first to come waits for its opponent
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while (head := self.heads[w := self.losers[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            self._play(w)


def merge_indexes(index: DataFrame) -> DataFrame:
    """Index rows of sorted runs in one order by URL key, timestamp and page over all partitions.

    Each partition gets one range of keys, of about RANGE_ROWS rows. As page and place are part of the
    key, a URL with any number of captures is split over several. A null page sorts first. The index
    is counted first, so it should be a written table.
    """
    names = index.columns
    at = [names.index(c) for c in ("url_key", "ts", "page_id", "run", "seq")]

    def key(row: tuple) -> tuple:
        k, ts, page, run, seq = (row[i] for i in at)
        return k, ts, page is not None, page or 0, run, seq

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list] = {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                runs.setdefault(row[at[3]], []).append(row)
        out = []
        for row in LoserTree([iter(r) for r in runs.values()], key):
            out.append(row)
            if len(out) == 4096:
                yield _index_rows(out)
                out = []
        if out:
            yield _index_rows(out)

    ranges = index.repartitionByRange(index.count() // RANGE_ROWS + 1, "url_key", "ts", "page_id", "run", "seq").sortWithinPartitions("run", "seq")
    return ranges.mapInArrow(merge, INDEX)


def capture_histories(pages: DataFrame, least: int = 0) -> DataFrame:
    """The merged index of archives written for all pages (see INDEX for its columns).

    A null url counts as empty, null html as an empty payload. Pages that repeat get a record each;
    equal payloads refer to the smallest page_id among them. Extra columns are ignored.
    """
    spark, path = pages.sparkSession, shared_dir(pages.sparkSession)
    write_warc(first_captures(pages, least), path)
    return merge_indexes(settled(read_warc(spark, path)))
