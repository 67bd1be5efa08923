"""More queries: tool output, model replies, logs, context windows, split cues, list rows, bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.functions import parsing as P
from cueloom.operators import intervals, sequences, transcripts
from cueloom.sources import adapters
from cueloom.sources.adapters import table

from .queries import query


def _reply(texts: list[str]) -> list[str] | None:
    """A stand-in for a model: a mark before each text, and a wrong count for texts that hold an x, unless they are alone."""
    return None if len(texts) > 1 and any("x" in t for t in texts) else [f"r:{t}" for t in texts]


@query("""SELECT event_id, least(1.0, (event_id % 130) / 100) AS percent, CAST(floor((event_id % 50 + 0.5) * 1048576 + 0.5) AS BIGINT) AS bytes_total,
    CAST(floor(floor((event_id % 50 + 0.5) * 1048576 + 0.5) * least(1.0, (event_id % 130) / 100) + 0.5) AS BIGINT) AS bytes_done,
    CASE WHEN event_id % 3 <> 0 THEN '1.5MiB/s' END AS speed, CASE WHEN event_id % 3 <> 0 THEN CAST(60 * (event_id % 7) + event_id % 60 AS DOUBLE) END AS eta FROM events""")
def progress_lines(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    tail = F.when(i % 3 == 0, F.lit(" at Unknown B/s ETA Unknown")).otherwise(F.format_string(" at 1.5MiB/s ETA %02d:%02d", i % 7, i % 60))
    line = F.concat(F.lit("PROGRESS  "), (i % 130).cast("string"), F.lit(".0% of  "), (i % 50).cast("string"), F.lit(".5MiB"), tail)
    return e.select("event_id", P.progress_line(line).alias("p")).select("event_id", "p.percent", "p.bytes_total", "p.bytes_done", "p.speed", "p.eta")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ERROR: bad ' || CAST(event_id AS VARCHAR) WHEN 1 THEN 'plain ' || event_type WHEN 2 THEN '' ELSE 'tool said no' END AS error FROM events""")
def error_lines(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    text = F.when(i % 4 == 0, F.concat(F.lit("error: first\nERROR:   bad "), i.cast("string"), F.lit("\nother"))).when(i % 4 == 1, F.concat(F.lit("x\n plain "), F.col("event_type"), F.lit("\nUsage: y"))).when(i % 4 == 2, F.lit(" \n")).otherwise(F.lit("tool said no\nusage: z"))
    return e.select("event_id", P.error_line(text).alias("error"))


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place,
    CASE event_id % 6 WHEN 1 THEN 'info' WHEN 2 THEN 'warn' WHEN 3 THEN 'error' WHEN 4 THEN 'debug' WHEN 5 THEN CASE WHEN event_type IN ('info', 'warn', 'error', 'debug') THEN event_type ELSE 'unknown' END ELSE 'unknown' END AS level,
    CASE WHEN event_id % 6 = 0 THEN event_type || ' at ' || CAST(user_id AS VARCHAR) ELSE event_type END AS event FROM events""")
def log_lines(spark, d):
    """A log for each user, its last line first."""
    i, kind = F.col("event_id"), F.col("event_type")
    level = F.when(i % 6 == 5, kind).otherwise(F.element_at(F.array(*map(F.lit, P.LEVELS)), F.greatest(F.lit(1), i % 6).cast("int")))
    line = F.when(i % 6 == 0, F.concat(kind, F.lit(" at "), F.col("user_id").cast("string"))).otherwise(F.to_json(F.struct(level.alias("level"), kind.alias("event"))))
    lines = table(spark, d, "events").select("user_id", "event_id", P.log_line(line).alias("l"))
    return sequences.newest_first(lines, "user_id", "event_id").select("user_id", "event_id", "place", "l.level", "l.event")


@query("""SELECT event_id, CASE event_id % 4 WHEN 2 THEN '["path:' || left(sha256('/Users/u' || CAST(user_id AS VARCHAR) || '/a.mp4'), 12) || '",1,"' || event_type || '"]'
    WHEN 3 THEN '"path:' || left(sha256('/Users/u' || CAST(user_id AS VARCHAR) || '/a.mp4'), 12) || '"' ELSE '{"event":"' || event_type || '","fileName":"hash:' || left(sha256('f' || CAST(user_id AS VARCHAR)), 12) || '","note":"at path:' || left(sha256('/home/u/' || CAST(user_id AS VARCHAR)), 12) || ' ok"}' END AS line FROM events""")
def log_redact(spark, d):
    """Lines that are JSON objects, arrays and strings."""
    u, i = F.col("user_id").cast("string"), F.col("event_id")
    file = F.concat(F.lit('"/Users/u'), u, F.lit('/a.mp4"'))
    line = F.when(i % 4 == 2, F.concat(F.lit("["), file, F.lit(', 1, "'), F.col("event_type"), F.lit('"]'))).when(i % 4 == 3, file)
    line = line.otherwise(F.to_json(F.struct(F.col("event_type").alias("event"), F.concat(F.lit("f"), u).alias("fileName"), F.concat(F.lit("at /home/u/"), u, F.lit(" ok")).alias("note"))))
    return table(spark, d, "events").select("event_id", P.redact(line).alias("line"))


@query("""SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN 2 ELSE -1 END AS n, CASE WHEN event_id % 4 IN (0, 1) THEN event_type END AS first FROM events""")
def json_arrays(spark, d):
    e, i, t = table(spark, d, "events"), F.col("event_id"), F.col("event_type")
    good = F.concat(F.lit('["'), t, F.lit('", "b"]'))
    raw = F.when(i % 4 == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(i % 4 == 1, F.concat(F.lit("Here: "), good, F.lit(" done"))).when(i % 4 == 2, F.lit("[1, 2]")).otherwise(F.lit("none"))
    return e.select("event_id", P.string_array(raw).alias("a")).select("event_id", F.when(F.col("a").isNotNull(), F.size("a")).otherwise(-1).alias("n"), F.get("a", F.lit(0)).alias("first"))


@query("""SELECT event_id, 'About ' || event_type AS summary, 'b1,b2' AS bullets, (60 * (event_id % 60)) * 1000 AS start_ms, 'Part' AS title, 'why' AS description FROM events""")
def insight_replies(spark, d):
    md = F.concat(F.lit("## Summary\nAbout "), F.col("event_type"), F.lit("\n- b1\n- b2\n\n## Chapters\n- ["), F.format_string("%02d:00", F.col("event_id") % 60), F.lit("] Part — why\nnoise\n"))
    x = table(spark, d, "events").select("event_id", P.insights(md).alias("i"))
    return x.select("event_id", "i.summary", F.array_join("i.bullets", ",").alias("bullets"), F.explode("i.chapters").alias("c")).select("event_id", "summary", "bullets", "c.*")


@query("""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE greatest(0, least(100, 60 + CASE event_id % 3 WHEN 0 THEN 20 WHEN 1 THEN -20 ELSE 0 END + least(20, CAST(floor(coalesce(t, 0) + 0.5) AS INTEGER)) - least(20, ms // 10000))) END::INTEGER AS score, t AS tps
    FROM (SELECT *, CASE WHEN user_id > 0 AND ms > 0 THEN round(user_id / (ms / 1000), 2) END AS t FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS ms FROM events))""")
def benchmark_score(spark, d):
    i, ms = F.col("event_id"), F.round(F.col("value") * 100).cast("long")
    valid = F.when(i % 3 == 0, F.lit(True)).when(i % 3 == 1, F.lit(False))
    x = table(spark, d, "events").withColumn("ms", ms).withColumn("tps", P.tokens_per_second(F.col("user_id"), F.col("ms")))
    return x.select("event_id", P.benchmark_score(i % 9 != 0, F.col("ms"), valid, F.col("tps")).alias("score"), "tps")


@query()
def context_windows(spark, d):
    return transcripts.context_windows(table(spark, d, "documents"), "doc_id", "text", context=1600, final_out=800, map_out=400, margin=100, prompt=100)


@query()
def split_cues(spark, d):
    return transcripts.split_cues(adapters.cues(spark, d), adapters.speaker_timeline(spark, d))


@query("""WITH x AS (SELECT *, coalesce(start_ms - lag(end_ms) OVER w >= 2000, false) AS silent, (start_ms - lag(end_ms) OVER w) / 1000 AS gap, lag(speaker) OVER w AS prev FROM {cues} WINDOW w AS (PARTITION BY media ORDER BY cue_idx)),
    y AS (SELECT *, speaker IS DISTINCT FROM prev AS header, silent OR speaker IS DISTINCT FROM prev AS opens FROM x),
    r AS (SELECT media, cue_idx, 0 AS o, 'silence' AS kind, NULL AS speaker, gap AS silence_s, false AS first_of_run FROM y WHERE silent
      UNION ALL SELECT media, cue_idx, 1, 'header', speaker, NULL, false FROM y WHERE header UNION ALL SELECT media, cue_idx, 2, 'cue', speaker, NULL, opens FROM y)
    SELECT media, cue_idx, CAST(row_number() OVER (PARTITION BY media, cue_idx ORDER BY o) - 1 AS INTEGER) AS pos, kind, speaker, silence_s, first_of_run FROM r""")
def list_rows(spark, d):
    return transcripts.list_rows(adapters.cues(spark, d), 2000)


@query("SELECT media, cue_idx, text, 'r:' || text AS reply FROM {cues}")
def model_ladder(spark, d):
    """Over every cue: the reply is one that Python and DuckDB compute alike, so no text is left out and batches are of all cues."""
    return transcripts.complete_batches(adapters.cues(spark, d), _reply)


@query("""SELECT media, cue_idx, 'cue-' || lpad(CAST(row_number() OVER (PARTITION BY media ORDER BY cue_idx) AS VARCHAR), 5, '0') AS source_id, left(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 240) AS snippet FROM {cues}""")
def source_map(spark, d):
    return transcripts.sources(adapters.cues(spark, d))


@query("""SELECT media, cue_idx, start_ms, least(start_ms + 20000, last_end) AS end_ms FROM (SELECT *, row_number() OVER (PARTITION BY media ORDER BY cue_idx) AS rn, last_value(end_ms) OVER (PARTITION BY media ORDER BY cue_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_end FROM {cues}) WHERE rn <= 5""")
def creator_clips(spark, d):
    return transcripts.clips(adapters.cues(spark, d), 5, 20_000)


@query("""WITH o AS (SELECT c.media, c.cue_idx, t.speaker, row_number() OVER (PARTITION BY c.media, c.cue_idx ORDER BY least(c.end_ms, t.end_ms) - greatest(c.start_ms, t.start_ms) DESC, t.pos) AS rn
      FROM {cues} c JOIN {speaker_timeline} t ON c.media = t.media AND greatest(c.start_ms, t.start_ms) < least(c.end_ms, t.end_ms))
    SELECT c.media, c.cue_idx, c.start_ms, c.end_ms, CASE WHEN o.speaker IS NOT NULL THEN o.speaker || ': ' || c.text ELSE c.text END AS text FROM {cues} c LEFT JOIN o ON o.media = c.media AND o.cue_idx = c.cue_idx AND rn = 1""")
def labelled_export(spark, d):
    c = adapters.cues(spark, d)
    return transcripts.labelled(c, intervals.most_overlap(c, adapters.speaker_timeline(spark, d)))


@query("""SELECT media, CAST(sum(end_ms - start_ms) AS BIGINT) AS covered_ms, CAST(floor(sum(end_ms - start_ms) / 30 * 100 / (SELECT count(*) FROM events e WHERE e.user_id = media) + 0.5) AS BIGINT) AS pct FROM (
    SELECT media, min(frame_idx) * 30 AS start_ms, (max(frame_idx) + 1) * 30 AS end_ms FROM (SELECT *, frame_idx - row_number() OVER (PARTITION BY media ORDER BY frame_idx) AS g FROM
      (SELECT *, coalesce(last_value(CASE WHEN p >= 0.5 THEN 1 WHEN p < 0.35 THEN 0 END IGNORE NULLS) OVER (PARTITION BY media ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS st FROM {frames}) WHERE st = 1) GROUP BY media, g) GROUP BY media""")
def speech_coverage(spark, d):
    f = adapters.frames(spark, d)
    n = f.groupBy("media").agg(F.count("*").alias("n"))
    per = sequences.hysteresis(f).groupBy("media").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("covered_ms"))
    return per.join(n, "media").select("media", "covered_ms", F.floor(F.col("covered_ms") / 30 * 100 / F.col("n") + 0.5).alias("pct"))
