"""Interval and nearest-key joins, and the assignment of speakers to cues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of the time bins on which intervals meet, so that a join stays an equi-join however long one media is.
BIN_MS = 60_000


def overlap_join(left: DataFrame, right: DataFrame, bin_ms: int = BIN_MS) -> DataFrame:
    """Pairs of left and right intervals of one media that overlap, with the clipped part (clip_start, clip_end).

    Columns of the right side but media get the prefix r_. Both sides are dealt over the bins they
    touch; a pair is kept only in the bin where its common part begins, so once.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_ms), F.greatest(F.floor(F.col(a) / bin_ms), F.floor((F.col(b) - 1) / bin_ms))))
    r = right.select("media", *(F.col(c).alias(f"r_{c}") for c in right.columns if c != "media")).where("r_end_ms > r_start_ms")
    a = left.where("end_ms > start_ms").withColumn("bin", bins("start_ms", "end_ms"))
    b = r.withColumn("bin", bins("r_start_ms", "r_end_ms"))
    both = a.join(b, ["media", "bin"]).withColumn("clip_start", F.greatest("start_ms", "r_start_ms")).withColumn("clip_end", F.least("end_ms", "r_end_ms"))
    return both.where((F.col("clip_end") > F.col("clip_start")) & (F.floor(F.col("clip_start") / bin_ms) == F.col("bin"))).drop("bin")


def resolve_speakers(cues: DataFrame, timeline: DataFrame) -> DataFrame:
    """cue -> none, single or split, its dominant speaker and that one's share of the cue.

    Under 30 % covered: none. A speaker with 70 %: single. Two or more with 25 % each: split. Else
    single. Of speakers with equal shares the one whose overlap comes first in the timeline leads.
    """
    both = overlap_join(cues.select("media", "cue_idx", "start_ms", "end_ms"), timeline)
    per = both.groupBy("media", "cue_idx", "r_speaker").agg(F.sum(F.col("clip_end") - F.col("clip_start")).alias("ms"), F.min("r_pos").alias("pos"))
    cue = per.groupBy("media", "cue_idx").agg(F.sum("ms").alias("all_ms"), F.max_by("r_speaker", F.struct("ms", -F.col("pos"))).alias("speaker"), F.max("ms").alias("top_ms"), F.collect_list("ms").alias("each"))
    out = cues.select("media", "cue_idx", (F.col("end_ms") - F.col("start_ms")).alias("len")).join(cue, ["media", "cue_idx"], "left")
    covered, top = F.col("all_ms") / F.col("len"), F.col("top_ms") / F.col("len")
    several = F.size(F.filter("each", lambda x: x / F.col("len") >= 0.25)) >= 2
    kind = F.when((F.col("len") <= 0) | F.col("all_ms").isNull() | (covered < 0.3), "none").when(top >= 0.7, "single").when(several, "split").otherwise("single")
    out = out.withColumn("kind", kind)
    led = F.col("kind") != "none"
    return out.select("media", "cue_idx", "kind", F.when(led, F.col("speaker")).alias("speaker"), F.when(led, F.round(top, 6)).alias("coverage"))


def most_overlap(cues: DataFrame, timeline: DataFrame) -> DataFrame:
    """The speaker of the one timeline entry that overlaps each cue most, the earliest on a tie; no floor."""
    both = overlap_join(cues.select("media", "cue_idx", "start_ms", "end_ms"), timeline)
    best = both.groupBy("media", "cue_idx").agg(F.max_by("r_speaker", F.struct(F.col("clip_end") - F.col("clip_start"), -F.col("r_pos"))).alias("speaker"))
    return cues.select("media", "cue_idx").join(best, ["media", "cue_idx"], "left")


def as_of(points: DataFrame, cues: DataFrame) -> DataFrame:
    """points (media, pos, at_ms) with the cues that begin last at or before them and first at or after them.

    One sorted pass over the union of both sides: nothing is paired.
    """
    marks = cues.select("media", F.col("start_ms").alias("at_ms"), F.lit(None).cast("long").alias("pos"), F.struct("start_ms", "cue_idx", "end_ms").alias("cue"))
    asks = points.select("media", "at_ms", F.col("pos").cast("long").alias("pos"), F.lit(None).cast(marks.schema["cue"].dataType).alias("cue"))
    both = marks.unionByName(asks)
    back = Window.partitionBy("media").orderBy("at_ms", F.col("pos").isNotNull(), "cue.cue_idx").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("media").orderBy(F.desc("at_ms"), F.col("pos").isNotNull(), F.desc("cue.cue_idx")).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("before", F.last("cue", ignorenulls=True).over(back)).withColumn("after", F.last("cue", ignorenulls=True).over(ahead))
    return placed.where("pos is not null").drop("cue")


def active_cue(points: DataFrame, cues: DataFrame) -> DataFrame:
    """The cue that is shown at each point: begun last at or before it, and not ended; else -1."""
    on = F.col("at_ms") < F.col("before.end_ms")
    return as_of(points, cues).select("media", "pos", F.when(on, F.col("before.cue_idx")).otherwise(-1).alias("cue_idx"))


def nearest_cue(points: DataFrame, cues: DataFrame) -> DataFrame:
    """The cue whose start is nearest to each point, the earlier on a tie."""
    b, a, at = F.col("before.start_ms"), F.col("after.start_ms"), F.col("at_ms")
    first = a.isNull() | (at - b <= a - at)
    near = as_of(points, cues).withColumn("cue", F.when(b.isNotNull() & first, F.col("before")).otherwise(F.col("after")))
    return near.select("media", "pos", "at_ms", F.col("cue.cue_idx").alias("cue_idx"), F.col("cue.start_ms").alias("cue_ms"))


def snap_chapters(chapters: DataFrame, cues: DataFrame) -> DataFrame:
    """chapters (media, pos, start_ms, title) at the nearest cue start; those past the last cue's end go, and of chapters at one cue the first stays."""
    ends = cues.groupBy("media").agg(F.max_by("end_ms", "cue_idx").alias("last_end"))
    near = nearest_cue(chapters.withColumn("at_ms", F.col("start_ms")), cues).join(chapters.select("media", F.col("pos").cast("long").alias("pos"), "title"), ["media", "pos"]).join(ends, "media").where("at_ms <= last_end")
    one = F.row_number().over(Window.partitionBy("media", "cue_ms").orderBy("pos"))
    return near.withColumn("rn", one).where("rn = 1").select("media", "pos", F.col("cue_ms").alias("start_ms"), "title")
