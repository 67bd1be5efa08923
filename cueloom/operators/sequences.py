"""Sequence operators over ordered rows of each media: segmentation, merging, gaps, packing, quality.

Segmentation, gaps and groups are scanned in blocks of a medium, packing is streamed; the others deal whole media over the
cluster and sort them once, and share the shuffle where they follow one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from cueloom.functions.text import trimmed
from cueloom.operators import blocks


def _ordered(key: str, *by: str):
    return Window.partitionBy(key).orderBy(*by)


def _running(key: str, *by: str):
    return _ordered(key, *by).rowsBetween(Window.unboundedPreceding, 0)


def islands(df: DataFrame, change: Column, name: str, key: str, *by: str) -> DataFrame:
    """df with `name`: how many rows so far, this one included, begin an island."""
    return df.withColumn(name, F.sum(F.coalesce(change, F.lit(True)).cast("int")).over(_running(key, *by)))


#: Frames, cues and milliseconds of a block: what one task scans of one medium.
BLOCK_ROWS, BLOCK_MS = 65_536, 3_600_000


def hysteresis(frames: DataFrame, enter: float = 0.5, leave: float = 0.35, frame_ms: int = 30, block: int = BLOCK_ROWS) -> DataFrame:
    """Runs that open at p >= enter and close at p < leave; one that is open at the end closes there. Scanned by blocks of frames."""
    if enter < leave:
        raise ValueError("enter must not be under leave")
    state = F.when(F.col("p") >= enter, 1).when(F.col("p") < leave, 0)
    x = blocks.with_entries(frames.select("media", "frame_idx", state.alias("on")), "media", "frame_idx", block, "on", skip_nulls=True)
    w = blocks.in_block("media", "frame_idx")
    x = x.withColumn("on", F.coalesce(F.last("on", ignorenulls=True).over(w), F.lit(0)))
    x = x.withColumn("run", F.sum(F.coalesce((F.col("on") != F.lag("on").over(w)).cast("int"), F.lit(0))).over(w))
    spans = x.where("on = 1 AND NOT entry").groupBy("media", "block", "run").agg(F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b"))
    spans = blocks.stitched(spans.withColumn("joined", F.col("run") == 0), "media", "a", "b")
    return spans.select("media", (F.col("a") * frame_ms).alias("start_ms"), ((F.col("b") + 1) * frame_ms).alias("end_ms"))


def merge_gaps(segments: DataFrame, gap_ms: int = 500, least_ms: int = 250, block_ms: int = BLOCK_MS) -> DataFrame:
    """Neighbours nearer than gap_ms become one; then what is shorter than least_ms goes. Scanned by blocks of time."""
    x = blocks.with_entries(segments.select("media", "start_ms", "end_ms"), "media", "start_ms", block_ms, "end_ms")
    w = blocks.in_block("media", "start_ms")
    far = ~F.col("entry") & F.coalesce(F.col("start_ms") - F.lag("end_ms").over(w) >= gap_ms, F.lit(True))
    runs = x.withColumn("far", far).withColumn("run", F.sum(F.col("far").cast("int")).over(w))
    runs = runs.where("NOT entry").groupBy("media", "block", "run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    one = blocks.stitched(runs.withColumn("joined", F.col("run") == 0), "media", "start_ms", "end_ms")
    return one.where(F.col("end_ms") - F.col("start_ms") >= least_ms)


def split_at_cap(segments: DataFrame, cap_ms: int = 30_000) -> DataFrame:
    cut = segments.where("end_ms > start_ms").withColumn("at", F.explode(F.expr(f"sequence(start_ms, end_ms - 1, {cap_ms}L)")))
    return cut.select("media", F.col("at").alias("start_ms"), F.least("end_ms", F.col("at") + cap_ms).alias("end_ms"))


def plan_by_duration(media: DataFrame, cap_s: int = 30) -> DataFrame:
    """media (media, duration_s): back-to-back chunks, the last one maybe short."""
    n = F.greatest(F.lit(1), F.ceil(F.col("duration_s") / cap_s)).cast("long")
    each = media.where("duration_s > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return each.select("media", "i", (F.col("i") * cap_s * 1000).alias("start_ms"), F.floor(F.least((F.col("i") + 1) * cap_s, F.col("duration_s")) * 1000 + 0.5).cast("long").alias("end_ms"))


def pack(segments: DataFrame, cap_ms: int = 30_000) -> DataFrame:
    """Greedy packing in order: a chunk is closed when the next piece would take it over the cap.

    Pieces are streamed by medium and start; from one batch to the next only the open chunk and its length are
    carried. Inside a batch a chunk's last piece is found in the running lengths by bisection, so time is linear
    in pieces and memory is that of a batch, even where one medium has all of them.
    """
    pieces = split_at_cap(segments, cap_ms).select("media", "start_ms", (F.col("end_ms") - F.col("start_ms")).alias("dur_ms"))
    schema = StructType([pieces.schema["media"], *(StructField(n, t) for n, t in (("chunk", IntegerType()), ("req_start_ms", LongType()), ("abs_start_ms", LongType()), ("dur_ms", LongType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        medium, chunk, used, begun = None, 0, 0, False
        for b in batches:
            if not b.num_rows:
                continue
            media, dur = b.column("media"), b.column("dur_ms").to_numpy()
            codes = media.dictionary_encode("encode").indices.to_numpy()
            borders = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            total = np.concatenate(([0], np.cumsum(dur)))
            chunks, at = np.empty(len(dur), np.int32), np.empty(len(dur), np.int64)
            for lo, hi in zip(borders[:-1], borders[1:], strict=True):
                if not begun or media[lo].as_py() != medium:
                    medium, chunk, used, begun = media[lo].as_py(), 0, 0, True
                while lo < hi:
                    end = int(np.searchsorted(total[: hi + 1], total[lo] + cap_ms - used, "right")) - 1
                    if end <= lo:  # the next piece doesn't fit
                        chunk, used = chunk + 1, 0
                        continue
                    chunks[lo:end], at[lo:end] = chunk, used + total[lo:end] - total[lo]
                    used, lo = used + int(total[end] - total[lo]), end
            yield pa.RecordBatch.from_arrays([media, pa.array(chunks), pa.array(at), b.column("start_ms"), b.column("dur_ms")], names=schema.names)

    return pieces.repartition("media").sortWithinPartitions("media", "start_ms", "dur_ms").mapInArrow(run, schema)


def remap(cues: DataFrame, pieces: DataFrame, slack_ms: int = 2000) -> DataFrame:
    """Cues (media, chunk, cue_idx, start_ms, end_ms in packed time) in absolute time by the pieces of their chunk.

    A cue begins in the piece that holds its start, and ends where the piece that holds its end
    says, slack_ms after its first piece's end at most. Cues that aren't placed or not positive go.
    """
    p = pieces.select("media", "chunk", F.col("req_start_ms").alias("r"), F.col("abs_start_ms").alias("a"), F.col("dur_ms").alias("d"))
    start, end = F.col("start_ms"), F.col("end_ms")
    first = cues.where("end_ms > start_ms").join(p, ["media", "chunk"]).where((start >= F.col("r")) & (start < F.col("r") + F.col("d")))
    first = first.select(*cues.columns, (F.col("a") + start - F.col("r")).alias("abs_start"), (F.col("a") + F.col("d")).alias("piece_end"))
    last = first.join(p, ["media", "chunk"], "left").withColumn("abs_end", F.when((end > F.col("r")) & (end <= F.col("r") + F.col("d")), F.col("a") + end - F.col("r")))
    last = last.groupBy("media", "chunk", "cue_idx", "abs_start", "piece_end").agg(F.max("abs_end").alias("abs_end"))
    out = last.select("media", "chunk", "cue_idx", F.col("abs_start").alias("start_ms"), F.least(F.coalesce("abs_end", "piece_end"), F.col("piece_end") + slack_ms).alias("end_ms"))
    return out.where("end_ms > start_ms")


def hallucination(cues: DataFrame, chunk_ms: Column) -> DataFrame:
    """One row per media and its first reason of repeat, reverse-ts, density, or null."""
    w = _ordered("media", "cue_idx")
    text = trimmed(F.col("text"))
    same = F.coalesce((text == F.lag(text, 1).over(w)) & (text == F.lag(text, 2).over(w)), F.lit(False))
    back = F.coalesce(F.col("start_ms") < F.lag("start_ms").over(w), F.lit(False))
    per = cues.select("media", same.alias("same"), back.alias("back"), "start_ms", "end_ms").groupBy("media").agg(F.bool_or("same").alias("same"), F.bool_or("back").alias("back"), F.count("*").alias("n"), chunk_ms.alias("ms"))
    dense = (F.col("ms") >= 10_000) & (F.col("n") / (F.col("ms") / 1000) > 1.5)
    return per.select("media", F.when(F.col("same"), "repeat").when(F.col("back"), "reverse-ts").when(dense, "density").alias("reason"))


def accept_attempt(attempts: DataFrame) -> DataFrame:
    """attempts (key, attempt, clean): the first clean one, else the first one as suspect after two retries."""
    per = attempts.groupBy("key").agg(F.min(F.when(F.col("clean"), F.col("attempt"))).alias("ok"))
    return per.select("key", F.coalesce("ok", F.lit(0)).alias("attempt"), F.when(F.col("ok").isNull(), "suspect").otherwise("ok").alias("quality"), F.coalesce("ok", F.lit(2)).alias("retry_count"))


def silent_gaps(cues: DataFrame, least_ms: int, block: int = BLOCK_ROWS) -> DataFrame:
    """media, cue_idx, start_ms, end_ms of the silence before a cue, least_ms or more. Scanned by blocks of cues."""
    x = blocks.with_entries(cues.select("media", "cue_idx", "start_ms", "end_ms"), "media", "cue_idx", block, "end_ms")
    gaps = x.select("media", "cue_idx", F.lag("end_ms").over(blocks.in_block("media", "cue_idx")).alias("start_ms"), F.col("start_ms").alias("end_ms"), "entry").where("NOT entry").drop("entry")
    return gaps.where(F.col("end_ms") - F.col("start_ms") >= least_ms)


def remerge_speaker(segments: DataFrame, slack_ms: int = 100) -> DataFrame:
    """Neighbours of one raw speaker that begin at most slack_ms after all before them have ended become one."""
    w = _ordered("media", "start_ms", "seg")
    runs = islands(segments, F.col("raw_speaker") != F.lag("raw_speaker").over(w), "turn", "media", "start_ms", "seg")
    within = Window.partitionBy("media", "turn").orderBy("start_ms", "seg")
    reach = F.max("end_ms").over(within.rowsBetween(Window.unboundedPreceding, -1))
    far = F.coalesce(F.col("start_ms") > reach + slack_ms, F.lit(True))
    part = runs.withColumn("far", far).withColumn("part", F.sum(F.col("far").cast("int")).over(within))
    return part.groupBy("media", "turn", "part").agg(F.first("raw_speaker").alias("raw_speaker"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("part")


def speaker_groups(cues: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Runs of cues of one speaker; null is a speaker of its own. Scanned by blocks of cues."""
    x = cues.select("media", "cue_idx", "start_ms", "end_ms", F.struct("speaker").alias("who"))
    x = blocks.with_entries(x, "media", "cue_idx", block, "who")
    w = blocks.in_block("media", "cue_idx")
    x = x.withColumn("new", ~F.col("entry") & ~F.col("who").eqNullSafe(F.lag("who").over(w))).withColumn("run", F.sum(F.col("new").cast("int")).over(w))
    runs = x.where("NOT entry").groupBy("media", "block", "run").agg(F.first("who").alias("who"), F.min("cue_idx").alias("first_cue"), F.count("*").alias("n"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    each = blocks.numbered(runs, "media").groupBy("media", F.col("run").alias("grp"))
    return each.agg(F.first("who")["speaker"].alias("speaker"), F.min("first_cue").alias("first_cue"), F.sum("n").alias("n_cues"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def peaks(samples: DataFrame, buckets: int) -> DataFrame:
    """samples (media, i, x): the largest |x| of each of `buckets` parts, 0 for an empty one, and the same over the media's largest."""
    n = samples.groupBy("media").agg(F.count("*").alias("n"))
    top = samples.join(n, "media").groupBy("media", F.floor(F.col("i") * buckets / F.col("n")).cast("int").alias("bucket")).agg(F.max(F.abs("x")).alias("peak"))
    every = n.select("media", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")).join(top, ["media", "bucket"], "left").withColumn("peak", F.coalesce("peak", F.lit(0.0)))
    most = F.max("peak").over(Window.partitionBy("media"))
    return every.select("media", "bucket", "peak", F.when(most > 0, F.col("peak") / most).otherwise(F.col("peak")).alias("norm"))


def tail(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """The last n rows of all, by a distributed top-n."""
    return rows.orderBy(*(F.desc(c) for c in by)).limit(n)


def newest_first(rows: DataFrame, key: str, by: str) -> DataFrame:
    """rows with their place in their key's list, the last one first."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by))))


def fixed_batches(rows: DataFrame, size: int, live: Column, key: str, by: str) -> DataFrame:
    """rows with their batch; a live source's last, unfilled batch waits."""
    w = _ordered(key, by)
    n = rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int")).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    return n.where(~live | (F.col("batch") < F.floor(F.col("n") / size))).drop("n")


def rolling_context(rows: DataFrame, size: int, back: int, key: str, by: str, value: str) -> DataFrame:
    """For the first row of each batch the values of the `back` rows before it."""
    w = _ordered(key, by)
    out = rows.withColumn("rn", F.row_number().over(w)).withColumn("context", F.collect_list(value).over(w.rowsBetween(-back, -1)))
    return out.where(F.col("rn") % size == 1).select(key, by, F.array_join("context", "|").alias("context"))
