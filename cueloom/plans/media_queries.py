"""Queries that write media files and read them again, with the SQL of what must come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueloom import storage
from cueloom.plans.queries import query
from cueloom.sources import adapters, audio, media_files
from cueloom.sources.adapters import table


def _by_medium(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("media").sortWithinPartitions("media", *order)


def _written(spark: SparkSession, rows: DataFrame, source: str, **options) -> str:
    media_files.register(spark)
    path = storage.shared_dir(spark)
    rows.write.format(source).options(**options).mode("append").save(path)
    return path


@query(r"""WITH c AS (SELECT CAST(media AS VARCHAR) AS media, cue_idx, start_ms, end_ms, regexp_replace(text, '\s*\n\s*', chr(10), 'g') AS said FROM {cues}),
    t AS (SELECT *, trim(regexp_replace(said, '<[^>]+>', '', 'g'), chr(32) || chr(9) || chr(10) || chr(13)) AS plain, trim(regexp_replace(said, '\{[^}]*\}', '', 'g'), chr(32) || chr(9) || chr(10) || chr(13)) AS ass FROM c)
    SELECT media, 'vtt' AS kind, row_number() OVER (PARTITION BY media ORDER BY cue_idx) - 1 AS at, start_ms, end_ms, said AS text FROM t WHERE trim(said) <> ''
    UNION ALL SELECT media, 'srt', row_number() OVER (PARTITION BY media ORDER BY cue_idx) - 1, start_ms, end_ms, plain FROM t WHERE plain <> ''
    UNION ALL SELECT media, 'ass', row_number() OVER (PARTITION BY media ORDER BY cue_idx) - 1, start_ms // 10 * 10, end_ms // 10 * 10, ass FROM t WHERE ass <> ''""")
def subtitle_files(spark, d):
    """All cues as VTT, SRT and ASS files, read by extension: blank lines would end a cue, so they are taken out first."""
    cues = adapters.cues(spark, d).withColumn("media", F.col("media").cast("string")).withColumn("text", F.regexp_replace("text", r"\s*\n\s*", "\n"))
    rows = _by_medium(cues, "cue_idx").select("media", "start_ms", "end_ms", "text")
    read = [spark.read.format("subtitles").load(_written(spark, rows, "subtitles", kind=kind)) for kind in media_files.KINDS]
    return read[0].unionByName(read[1]).unionByName(read[2])


def _samples(spark, d) -> DataFrame:
    w = Window.partitionBy("media").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("media", F.concat(F.lit("user/"), F.col("user_id").cast("string")))
    x = ((F.col("event_id") * 7919 + F.col("user_id")) % 65_536 - 32_768) / 32_768
    return e.select("media", (F.row_number().over(w) - 1).cast("long").alias("i"), x.alias("x"), F.count("*").over(Window.partitionBy("media")).alias("n"))


_PCM = "SELECT 'user/' || CAST(user_id AS VARCHAR) AS media, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, ((event_id * 7919 + user_id) % 65536 - 32768) / 32768 AS x FROM events"


@query(_PCM)
def wav_files(spark, d):
    """Values of events as mono 16-bit files, one a user, read as samples; files over a kilobyte are read in ranges."""
    path = _written(spark, _by_medium(_samples(spark, d), "i"), "wav", rate=1000)
    return spark.read.format("wav").option("split", 1024).load(path)


@query(f"""WITH s AS ({_PCM}), n AS (SELECT media, count(*) AS n FROM s GROUP BY 1)
    SELECT media, 1 AS format, 1 AS channels, 1000 AS rate, 16 AS bits, 2 * n AS size,
        (SELECT coalesce(CAST(sum(x * 32768) AS BIGINT), 0) FROM s WHERE s.media = n.media AND i >= 2 AND i < 7) AS cut,
        (SELECT CAST(sum(x * 32768) AS BIGINT) FROM s WHERE s.media = n.media AND (i < 2 OR i >= 4 AND i < 5)) AS joined FROM n""")
def wav_slices(spark, d):
    """Headers of the files, and the sums of the samples of one range and of three joined ones, of which one is empty."""
    path = _written(spark, _by_medium(_samples(spark, d), "i"), "wav", rate=1000)
    heads = spark.read.format("wav").option("rows", "headers").load(path).select("media", "format", "channels", "rate", "bits", "size")
    files = spark.read.format("wav").option("rows", "files").load(path)
    cut = audio.slice_wav(F.col("content"), F.lit(0.002), F.lit(0.007))
    ranges = F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in ((0.0, 0.002), (0.003, 0.003), (0.004, 0.005))))
    made = files.select("media", cut.alias("cut"), audio.concat_wav(F.col("content"), ranges).alias("joined"))
    total = lambda name: audio.samples(made, "media", name).groupBy("media").agg(F.sum(F.round(F.col("x") * 32768)).cast("long").alias(name))
    return heads.join(total("cut"), "media", "left").join(total("joined"), "media", "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
