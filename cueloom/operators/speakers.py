"""Speaker statistics and the consolidation of raw speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions.text import cosine


def mean_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Element-wise mean of each key's vectors."""
    each = vectors.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def speech_seconds(segments: DataFrame, *keys: str) -> DataFrame:
    return segments.groupBy(*keys).agg((F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))) / 1000).alias("duration_s"), F.count("*").alias("segment_count"))


def representative_segments(segments: DataFrame, n: int, least_s: float) -> DataFrame:
    """Of each raw speaker the n longest segments of least_s or more."""
    length = F.col("end_ms") - F.col("start_ms")
    w = Window.partitionBy("media", "raw_speaker").orderBy(F.desc(length), "start_ms", "seg")
    return segments.where(length >= least_s * 1000).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).select("media", "raw_speaker", "seg", "start_ms", "end_ms")


def label(rank: Column) -> Column:
    """speaker_A, ... speaker_Z, speaker_AA, ... by rank from 0."""
    letter = lambda n: F.char(65 + n)
    return F.concat(F.lit("speaker_"), F.when(rank < 26, letter(rank)).otherwise(F.concat(letter(F.floor(rank / 26) - 1), letter(rank % 26))))


def consolidate(segments: DataFrame, centroids: DataFrame, top_k: int = 0, share: float = 0.05, least_s: float = 8.0, merge_at: float = 0.65) -> DataFrame:
    """media, raw_speaker, speaker_id: major raw speakers get labels by duration, others their most similar major's, if similar enough, else unknown.

    top_k of 0 takes as major whoever has the share and the seconds, or else the longest. Centroids
    (media, raw_speaker, centroid) are of each media's own raw speakers; one without is unknown. A media's
    total is a sum of whole milliseconds: a sum of seconds depends on its order, and with it who has just the share.
    """
    stats = speech_seconds(segments, "media", "raw_speaker")
    total = F.sum(F.round(F.col("duration_s") * 1000).cast("long")).over(Window.partitionBy("media")) / 1000
    stats = stats.withColumn("total_s", total).join(centroids.select("media", "raw_speaker", "centroid"), ["media", "raw_speaker"], "left")
    known = stats.where("centroid is not null")
    rank = F.row_number().over(Window.partitionBy("media").orderBy(F.desc("duration_s"), "raw_speaker")) - 1
    known = known.withColumn("rank", rank)
    fits = F.col("rank") < top_k if top_k else (F.col("duration_s") >= least_s) & (F.col("duration_s") / F.greatest("total_s", F.lit(1e-9)) >= share)
    known = known.withColumn("major", fits).withColumn("major", F.col("major") | (~F.max("major").over(Window.partitionBy("media")) & (F.col("rank") == 0)))
    majors = known.where("major").withColumn("speaker_id", label((F.row_number().over(Window.partitionBy("media").orderBy("rank")) - 1).cast("int")))
    other = known.where("not major").select("media", "raw_speaker", "centroid").join(majors.select("media", F.col("centroid").alias("c"), F.col("speaker_id").alias("s"), F.col("rank").alias("r")), "media")
    best = other.groupBy("media", "raw_speaker").agg(F.max(F.struct(cosine(F.col("centroid"), F.col("c")).alias("score"), -F.col("r"), "s")).alias("best"))
    near = best.select("media", "raw_speaker", F.when(F.col("best.score") >= merge_at, F.col("best.s")).otherwise("unknown").alias("speaker_id"))
    mapped = majors.select("media", "raw_speaker", "speaker_id").unionByName(near)
    return stats.select("media", "raw_speaker", "duration_s").join(mapped, ["media", "raw_speaker"], "left").withColumn("speaker_id", F.coalesce("speaker_id", F.lit("unknown")))


def final_speakers(mapping: DataFrame) -> DataFrame:
    """Duration and share of each final speaker of a media, unknown among them."""
    per = mapping.groupBy("media", "speaker_id").agg(F.sum("duration_s").alias("duration_s"))
    total = F.sum("duration_s").over(Window.partitionBy("media"))
    return per.select("media", "speaker_id", F.round("duration_s", 3).alias("duration_s"), F.when(total > 0, F.round(F.col("duration_s") / total, 6)).otherwise(0.0).alias("ratio"))
