"""Queries over the driver's tables, by name, with the DuckDB SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueloom.functions import parsing as P
from cueloom.functions import text as T
from cueloom.operators import intervals, sequences, speakers
from cueloom.plans import queue
from cueloom.sources import adapters, subtitles
from cueloom.sources.adapters import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The fixed "now" of recency tests: 1 July 1998, and what counts as recent.
AS_OF, RECENT = 899_251_200_000, 30 * 86_400_000


def query(sql: str | None = None):
    """Registers a query under its function's name; {name} in sql stands for a domain relation."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            text = sql
            for name, sub in adapters.SQL.items():
                text = text.replace("{" + name + "}", sub)
            SQL[f.__name__] = text
        return f

    return add


_LAST = "(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn FROM {of})"


# ---- queues, batches, library


@query(f"""
    SELECT t.id, t.kind, CAST(list_position(['transcribe', 'translate', 'insight', 'polish', 'diarize'], t.kind) - 1 AS INTEGER) AS kind_ord, t.status,
           CASE t.status WHEN 'running' THEN 0 WHEN 'queued' THEN 1 ELSE 2 END AS rank, t.created_at,
           CASE WHEN t.kind <> 'transcribe' THEN progress_pct WHEN total_chunks > 0 THEN CAST(floor(done_chunks / total_chunks * 100 + 0.5) AS INTEGER) ELSE 0 END AS pct,
           coalesce(v.display_name, v.original_name, substr(t.video_sha, 1, 12)) AS name
    FROM {{tasks}} t LEFT JOIN {{videos}} v ON t.video_sha = v.sha256
    WHERE t.status IN ('queued', 'running') OR t.created_at > {AS_OF - RECENT}""")
def queue_snapshot(spark, d):
    return queue.snapshot(adapters.tasks(spark, d), adapters.videos(spark, d), adapters.KINDS, AS_OF, RECENT)


@query("""
    WITH t AS (SELECT *, CASE WHEN kind = 'translate' THEN priority ELSE 0 END AS sort_priority FROM {tasks}
               WHERE kind IN ('translate', 'insight', 'polish') AND status = 'queued')
    SELECT video_sha, id, kind, created_at, sort_priority FROM t
    WHERE video_sha IN (SELECT sha256 FROM {videos} WHERE has_transcript = 1)
    ORDER BY sort_priority DESC, created_at, id LIMIT 25""")
def next_task(spark, d):
    ready = adapters.videos(spark, d).where("has_transcript = 1").select(F.col("sha256").alias("video_sha"))
    return queue.next_tasks(adapters.tasks(spark, d), ready, 25)


@query("""SELECT video_sha, id, kind, status, created_at FROM
    (SELECT *, row_number() OVER (PARTITION BY video_sha ORDER BY created_at DESC, id DESC) AS rn FROM {tasks}) WHERE rn = 1""")
def latest_task_per_media(spark, d):
    return queue.latest(adapters.tasks(spark, d).select("video_sha", "id", "kind", "status", "created_at"), "video_sha")


_ROLL = """SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'completed') AS done, count(*) FILTER (status = 'failed') AS failed,
    count(*) FILTER (status = 'canceled') AS canceled, count(*) FILTER (status IN ('queued', 'running')) AS active FROM {batch_items} GROUP BY batch_id"""


@query(f"""SELECT *, CASE WHEN canceled = total THEN 'canceled' WHEN active = 0 AND failed > 0 THEN 'failed'
    WHEN active = 0 AND done = total THEN 'completed' ELSE 'running' END AS status FROM ({_ROLL})""")
def batch_rollup(spark, d):
    return queue.batch_rollup(adapters.batch_items(spark, d))


@query("""SELECT o_orderkey AS batch_id, o_orderpriority AS preset, coalesce(n, 0) AS items, coalesce(transcribed, 0) AS transcribed_items
    FROM orders LEFT JOIN (SELECT batch_id, count(*) AS n, count(*) FILTER (status IN ('completed', 'failed')) AS transcribed FROM {batch_items} GROUP BY batch_id) b
    ON o_orderkey = b.batch_id""")
def batch_jobs_list(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("batch_id"), F.col("o_orderpriority").alias("preset"))
    per = adapters.batch_items(spark, d).groupBy("batch_id").agg(F.count("*").alias("items"), F.count_if(F.col("status").isin("completed", "failed")).alias("transcribed_items"))
    return jobs.join(per, "batch_id", "left").na.fill(0, ["items", "transcribed_items"])


@query("""SELECT sha256(CAST(c_custkey AS VARCHAR)) AS video_sha,
    array_to_string(list_sort(list_filter(list(DISTINCT o_orderpriority[3:]), lambda x: x <> 'LOW')), ',') AS langs, bool_or(o_orderpriority[3:] = 'LOW') AS polished
    FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def library_langs(spark, d):
    o = table(spark, d, "orders").select(adapters.sha_of("o_custkey").alias("video_sha"), F.substring("o_orderpriority", 3, 100).alias("lang"))
    per = o.groupBy("video_sha").agg(F.array_sort(F.collect_set("lang")).alias("all"))
    return per.select("video_sha", F.array_join(F.filter("all", lambda x: x != "LOW"), ",").alias("langs"), F.array_contains("all", "LOW").alias("polished"))


@query("""SELECT count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, CAST(sum(CASE WHEN deleted_at IS NULL THEN size_bytes ELSE 0 END) AS BIGINT) AS live_bytes,
    count(*) FILTER (deleted_at IS NULL) AS live, count(*) FILTER (coalesce(deleted_at, 0) = 0) AS live_or_zero,
    least(1.0, round(sum(size_bytes) / (10 * 1024.0 ^ 3), 6)) AS used_ratio FROM {videos}""")
def library_totals(spark, d):
    v, live = adapters.videos(spark, d), F.col("deleted_at").isNull()
    size = F.sum("size_bytes")
    return v.agg(F.count("*").alias("n"), size.alias("total_bytes"), F.sum(F.when(live, F.col("size_bytes")).otherwise(0)).alias("live_bytes"), F.count_if(live).alias("live"), F.count_if(F.coalesce("deleted_at", F.lit(0)) == 0).alias("live_or_zero"), F.least(F.lit(1.0), F.round(size / (10 * 1024.0**3), 6)).alias("used_ratio"))


@query("SELECT coalesce(model, 'auto') AS engine, count(*) AS n FROM {tasks} WHERE kind = 'transcribe' AND status = 'running' GROUP BY 1 ORDER BY n DESC, engine")
def engine_counts(spark, d):
    t = adapters.tasks(spark, d).where("kind = 'transcribe' and status = 'running'")
    return t.groupBy(F.coalesce("model", F.lit("auto")).alias("engine")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "engine")


@query("SELECT count(*) FILTER (kind IN ('translate', 'insight', 'polish') AND status = 'running') AS running_llm, coalesce(max(priority), 0) AS top_priority, count(*) AS n FROM {tasks}")
def running_llm(spark, d):
    return adapters.tasks(spark, d).agg(F.count_if(F.col("kind").isin("translate", "insight", "polish") & (F.col("status") == "running")).alias("running_llm"), F.coalesce(F.max("priority"), F.lit(0)).alias("top_priority"), F.count("*").alias("n"))


@query("SELECT t.video_sha, CAST(sum(c.n_cues) AS BIGINT) AS cues, count(*) AS chunks FROM {tasks} t JOIN {chunks} c ON t.id = c.task_id WHERE t.status = 'running' GROUP BY 1")
def running_cues(spark, d):
    t = adapters.tasks(spark, d).where("status = 'running'").select(F.col("id").alias("task_id"), "video_sha")
    return adapters.chunks(spark, d).join(t, "task_id").groupBy("video_sha").agg(F.sum("n_cues").alias("cues"), F.count("*").alias("chunks"))


@query("SELECT sha256, EXISTS (SELECT 1 FROM {tasks} t WHERE t.video_sha = v.sha256 AND kind = 'transcribe' AND status = 'completed') AS has_completed FROM {videos} v")
def semi_ready(spark, d):
    done = adapters.tasks(spark, d).where("kind = 'transcribe' and status = 'completed'").select(F.col("video_sha").alias("sha256"), F.lit(True).alias("has_completed")).distinct()
    return adapters.videos(spark, d).select("sha256").join(done, "sha256", "left").na.fill(False)


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_orphans(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""SELECT o_custkey AS media, array_to_string(list_filter(['transcribe', 'translate', 'insight', 'polish', 'diarize'], lambda x: NOT list_contains(done, x)), ',') AS missing
    FROM (SELECT o_custkey, list(DISTINCT ['transcribe', 'translate', 'insight', 'polish', 'diarize'][o_orderkey % 5 + 1]) AS done FROM orders GROUP BY 1) WHERE len(done) < 5""")
def missing_steps(spark, d):
    kind = F.element_at(F.array(*map(F.lit, adapters.KINDS)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    done = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("video_sha")).agg(F.collect_set(kind).alias("done"))
    return queue.missing_steps(done, list(adapters.KINDS)).select(F.col("video_sha").alias("media"), F.array_join("missing", ",").alias("missing"))


_LATEST = "(SELECT video_sha, status FROM (SELECT *, row_number() OVER (PARTITION BY video_sha ORDER BY created_at DESC, id DESC) AS rn FROM {{tasks}} WHERE kind = '{kind}') WHERE rn = 1)"


@query(f"""WITH v AS (SELECT sha256 AS video_sha, deleted_at IS NULL AS has_file, has_transcript = 1 AS has_transcript, last_opened_at % 2 = 0 AS has_insights FROM {{videos}}),
    j AS (SELECT v.*, t.status AS t, CASE i.status WHEN 'failed' THEN 'error' ELSE i.status END AS i FROM v LEFT JOIN {_LATEST.format(kind="transcribe")} t USING (video_sha) LEFT JOIN {_LATEST.format(kind="insight")} i USING (video_sha))
    SELECT video_sha, CASE WHEN NOT has_file THEN 'media_missing' WHEN NOT has_transcript THEN CASE WHEN t IN ('queued', 'running') THEN 'transcribe_pending' WHEN t = 'failed' THEN 'transcribe_failed' ELSE 'transcribe_needed' END
        WHEN NOT has_insights THEN CASE WHEN i IN ('queued', 'running') THEN 'insights_pending' WHEN i = 'error' THEN 'insights_failed' ELSE 'insights_needed' END ELSE 'bundle_ready' END AS phase,
      CASE WHEN NOT has_file THEN 'import_media' WHEN NOT has_transcript THEN CASE WHEN t IN ('queued', 'running') THEN 'wait_for_transcribe' WHEN t = 'failed' THEN 'retry_transcribe' ELSE 'start_transcribe' END
        WHEN NOT has_insights THEN CASE WHEN i IN ('queued', 'running') THEN 'wait_for_insights' WHEN i = 'error' THEN 'retry_insights' ELSE 'start_insights' END ELSE 'export_bundle' END AS next_action FROM j""".replace("{{", "{").replace("}}", "}"))
def media_phase(spark, d):
    v = adapters.videos(spark, d).select(F.col("sha256").alias("video_sha"), F.col("deleted_at").isNull().alias("has_file"), (F.col("has_transcript") == 1).alias("has_transcript"), (F.col("last_opened_at") % 2 == 0).alias("has_insights"))
    t = adapters.tasks(spark, d)
    return queue.media_phase(v, t.withColumn("status", F.when((F.col("kind") == "insight") & (F.col("status") == "failed"), "error").otherwise(F.col("status"))))


@query("""WITH l AS (SELECT sha256 AS video_sha, CAST(last_opened_at % 4 AS INTEGER) AS n_langs, last_opened_at % 3 = 0 AS has_insights FROM {videos}),
    s AS (SELECT video_sha, bool_or(kind = 'transcribe' AND status = 'running') AS tr, bool_or(kind = 'transcribe' AND status = 'queued') AS tq, bool_or(kind = 'transcribe' AND status = 'failed') AS tf,
      bool_or(kind = 'translate' AND status = 'running') AS lr, bool_or(kind = 'translate' AND status = 'queued') AS lq, bool_or(kind = 'translate' AND status = 'failed') AS lf,
      bool_or(kind = 'insight' AND status IN ('queued', 'running')) AS ir, bool_or(kind = 'insight' AND status IN ('error', 'failed')) AS xf FROM {tasks} GROUP BY 1)
    SELECT video_sha, CASE WHEN tr THEN 'running' WHEN tq THEN 'queued' WHEN n_langs > 0 THEN 'done' WHEN tf THEN 'failed' ELSE 'none' END AS transcribe,
      CASE WHEN lr THEN 'running' WHEN lq THEN 'queued' WHEN lf THEN 'failed' ELSE 'none' END AS translate, greatest(0, n_langs - 1) AS translated,
      CASE WHEN ir THEN 'running' WHEN xf THEN 'failed' WHEN has_insights THEN 'done' ELSE 'none' END AS insight FROM l LEFT JOIN s USING (video_sha)""")
def file_status(spark, d):
    lib = adapters.videos(spark, d).select(F.col("sha256").alias("video_sha"), (F.col("last_opened_at") % 4).cast("int").alias("n_langs"), (F.col("last_opened_at") % 3 == 0).alias("has_insights"))
    return queue.file_status(adapters.tasks(spark, d), lib)


@query("""SELECT coalesce(a.id, b.id) AS id, coalesce(b.status, a.status) AS status, coalesce(b.model, a.model) AS model, coalesce(a.priority, 0) AS priority FROM {tasks} a
    FULL JOIN (SELECT CASE status WHEN 'failed' THEN id ELSE -1 - id END AS id, 'queued' AS status, model FROM {tasks} WHERE status = 'failed' OR (status = 'completed' AND kind = 'transcribe')) b ON a.id = b.id""")
def upsert_merge(spark, d):
    """Into all tasks: failed ones are queued again, and each finished transcript puts in a task that follows it (id -1 - id)."""
    t = adapters.tasks(spark, d).select("id", "kind", "status", "model", "priority")
    rows = t.where("status = 'failed' or (status = 'completed' and kind = 'transcribe')").select(F.when(F.col("status") == "failed", F.col("id")).otherwise(-1 - F.col("id")).alias("id"), F.lit("queued").alias("status"), "model")
    return queue.upsert(t.drop("kind"), rows, ["id"]).withColumn("priority", F.coalesce("priority", F.lit(0)))


@query("""SELECT id, CASE status WHEN 'running' THEN 'queued' ELSE status END AS web, CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS desktop FROM {tasks}""")
def recover_states(spark, d):
    t = adapters.tasks(spark, d)
    return queue.recover(t, "web").select("id", F.col("status").alias("web")).join(queue.recover(t, "desktop").select("id", F.col("status").alias("desktop")), "id")


@query("""SELECT DISTINCT source_url AS url FROM {videos} WHERE source_url IS NOT NULL AND source_url NOT IN (SELECT source_url FROM {videos} WHERE source_url IS NOT NULL AND deleted_at IS NULL AND last_opened_at % 2 = 0)
    AND source_url NOT IN (SELECT 'https://media.example.com/v/' || CAST(i AS VARCHAR) FROM range(5) r(i))""")
def new_imports(spark, d):
    v = adapters.videos(spark, d)
    stored = v.where("source_url is not null and deleted_at is null and last_opened_at % 2 = 0").select(F.col("source_url").alias("url"))
    flight = spark.range(5).select(F.concat(F.lit("https://media.example.com/v/"), F.col("id").cast("string")).alias("url"))
    return queue.new_imports(v.select(F.col("source_url").alias("url")), flight, stored)


@query("""SELECT id, batch_id, shown FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS batch_id, CAST(least(99, max(CAST(l_quantity * 2 AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity * 2 AS BIGINT))) AS BIGINT) AS shown FROM lineitem)""")
def progress_shown(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("at"), (F.col("l_quantity") * 2).cast("long").alias("pct"))
    return queue.progress(e).select((F.col("task") * 10 + F.col("at")).alias("id"), F.col("task").alias("batch_id"), "shown")


@query("SELECT t.id FROM {tasks} t WHERE t.video_sha NOT IN (SELECT sha256 FROM {videos} WHERE deleted_at > 0)")
def cascade_delete(spark, d):
    gone = adapters.videos(spark, d).where("deleted_at > 0").select(F.col("sha256").alias("video_sha"))
    return queue.cascade_delete({"tasks": (adapters.tasks(spark, d), "video_sha")}, gone)["tasks"].select("id")


# ---- sequences


_STATE = """SELECT *, coalesce(last_value(CASE WHEN p >= 0.5 THEN 1 WHEN p < 0.35 THEN 0 END IGNORE NULLS) OVER (PARTITION BY media ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS st FROM {frames}"""
_VAD = f"""SELECT media, min(frame_idx) * 30 AS start_ms, (max(frame_idx) + 1) * 30 AS end_ms FROM
    (SELECT *, frame_idx - row_number() OVER (PARTITION BY media ORDER BY frame_idx) AS g FROM ({_STATE}) WHERE st = 1) GROUP BY media, g"""
_REFINED = """SELECT media, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM
    (SELECT *, sum(far) OVER (PARTITION BY media ORDER BY start_ms) AS g FROM
      (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY media ORDER BY start_ms) < 120 THEN 0 ELSE 1 END AS far FROM ({vad})))
    GROUP BY media, g HAVING max(end_ms) - min(start_ms) >= 90""".replace("{vad}", _VAD)
_CUT = """SELECT media, a AS start_ms, least(end_ms, a + 500) AS end_ms FROM (SELECT *, unnest(range(start_ms, end_ms, 500)) AS a FROM ({r}))""".replace("{r}", _REFINED)


@query(_VAD)
def vad_segments(spark, d):
    return sequences.hysteresis(adapters.frames(spark, d))


def _refined(spark, d):
    return sequences.merge_gaps(sequences.hysteresis(adapters.frames(spark, d)), 120, 90)


@query(_REFINED)
def vad_refined(spark, d):
    return _refined(spark, d)


@query(_CUT)
def chunk_plan(spark, d):
    return sequences.split_at_cap(_refined(spark, d), 500)


@query("""SELECT media, i, i * 30000 AS start_ms, CAST(floor(least((i + 1) * 30, s) * 1000 + 0.5) AS BIGINT) AS end_ms FROM
    (SELECT p_partkey AS media, p_retailprice / 10 AS s, unnest(range(0, CAST(greatest(1, ceil(p_retailprice / 10 / 30)) AS BIGINT))) AS i FROM part WHERE p_retailprice > 0)""")
def duration_plan(spark, d):
    return sequences.plan_by_duration(table(spark, d, "part").select(F.col("p_partkey").alias("media"), (F.col("p_retailprice") / 10).alias("duration_s")), 30)


_PACKED = """WITH RECURSIVE p AS (SELECT media, start_ms, end_ms - start_ms AS dur, row_number() OVER (PARTITION BY media ORDER BY start_ms) AS rn FROM ({cut})),
    f(media, rn, chunk, req, start_ms, dur) AS (
      SELECT media, rn, 0, CAST(0 AS BIGINT), start_ms, dur FROM p WHERE rn = 1
      UNION ALL SELECT p.media, p.rn, CASE WHEN f.req + f.dur + p.dur > 500 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.req + f.dur + p.dur > 500 THEN 0 ELSE f.req + f.dur END, p.start_ms, p.dur
      FROM f JOIN p ON p.media = f.media AND p.rn = f.rn + 1)""".replace("{cut}", _CUT)


@query(_PACKED + " SELECT media, chunk, req AS req_start_ms, start_ms AS abs_start_ms, dur AS dur_ms FROM f")
def packed_plan(spark, d):
    return sequences.pack(_refined(spark, d), 500)


@query(_PACKED + """, c AS (SELECT media, chunk, t AS cue_idx, t * 70 AS start_ms, t * 70 + 90 AS end_ms FROM (SELECT DISTINCT media, chunk FROM f), range(6) r(t)),
    s AS (SELECT c.*, f.start_ms + c.start_ms - f.req AS a, f.start_ms + f.dur AS pe FROM c JOIN f ON f.media = c.media AND f.chunk = c.chunk AND c.start_ms >= f.req AND c.start_ms < f.req + f.dur),
    e AS (SELECT s.media, s.chunk, s.cue_idx, s.a, s.pe, max(CASE WHEN s.end_ms > f.req AND s.end_ms <= f.req + f.dur THEN f.start_ms + s.end_ms - f.req END) AS b FROM s JOIN f ON f.media = s.media AND f.chunk = s.chunk GROUP BY ALL)
    SELECT media, chunk, cue_idx, a AS start_ms, least(coalesce(b, pe), pe + 2000) AS end_ms FROM e WHERE least(coalesce(b, pe), pe + 2000) > a""")
def remapped_cues(spark, d):
    pieces = sequences.pack(_refined(spark, d), 500)
    cues = pieces.select("media", "chunk").distinct().withColumn("cue_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    return sequences.remap(cues.withColumn("start_ms", F.col("cue_idx") * 70).withColumn("end_ms", F.col("cue_idx") * 70 + 90), pieces)


_RISKY = """(SELECT media, cue_idx, CASE WHEN media % 7 = 0 AND cue_idx % 5 = 2 THEN start_ms - 500000 ELSE start_ms END AS start_ms, end_ms, CASE WHEN media % 5 = 0 AND cue_idx < 3 THEN ' again' || ['', chr(9), chr(10)][cue_idx + 1] ELSE text END AS text FROM {cues})"""


@query("""SELECT media, CASE WHEN bool_or(coalesce(trim(text, chr(32) || chr(9) || chr(10)) = trim(t1, chr(32) || chr(9) || chr(10)) AND trim(text, chr(32) || chr(9) || chr(10)) = trim(t2, chr(32) || chr(9) || chr(10)), false)) THEN 'repeat' WHEN bool_or(coalesce(start_ms < s1, false)) THEN 'reverse-ts'
    WHEN max(end_ms) - min(start_ms) >= 10000 AND count(*) / ((max(end_ms) - min(start_ms)) / 1000) > 1.5 THEN 'density' END AS reason FROM
    (SELECT *, lag(text, 1) OVER w AS t1, lag(text, 2) OVER w AS t2, lag(start_ms) OVER w AS s1 FROM {risky} WINDOW w AS (PARTITION BY media ORDER BY cue_idx)) GROUP BY media""".replace("{risky}", _RISKY))
def hallucination(spark, d):
    c, m, i = adapters.cues(spark, d), F.col("media"), F.col("cue_idx")
    risky = c.withColumn("start_ms", F.when((m % 7 == 0) & (i % 5 == 2), F.col("start_ms") - 500_000).otherwise(F.col("start_ms"))).withColumn("text", F.when((m % 5 == 0) & (i < 3), F.concat(F.lit(" again"), F.get(F.array(F.lit(""), F.lit("\t"), F.lit("\n")), i.cast("int")))).otherwise(F.col("text")))
    return sequences.hallucination(risky, F.max("end_ms") - F.min("start_ms"))


@query("""SELECT l_orderkey AS key, coalesce(min(CASE WHEN l_returnflag = 'N' THEN l_linenumber - 1 END), 0) AS attempt, CASE WHEN bool_or(l_returnflag = 'N') THEN 'ok' ELSE 'suspect' END AS quality,
    coalesce(min(CASE WHEN l_returnflag = 'N' THEN l_linenumber - 1 END), 2) AS retry_count FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1""")
def retry_accept(spark, d):
    li = table(spark, d, "lineitem").where("l_linenumber <= 3")
    return sequences.accept_attempt(li.select(F.col("l_orderkey").alias("key"), (F.col("l_linenumber") - 1).alias("attempt"), (F.col("l_returnflag") == "N").alias("clean")))


@query("""SELECT media, cue_idx, prev AS start_ms, start_ms AS end_ms FROM (SELECT *, lag(end_ms) OVER (PARTITION BY media ORDER BY cue_idx) AS prev FROM {cues}) WHERE start_ms - prev >= 2000""")
def silent_gaps(spark, d):
    return sequences.silent_gaps(adapters.cues(spark, d), 2000)


@query("""SELECT media, CAST(g AS BIGINT) AS grp, any_value(speaker) AS speaker, min(cue_idx) AS first_cue, count(*) AS n_cues, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM
    (SELECT *, sum(ch) OVER (PARTITION BY media ORDER BY cue_idx) AS g FROM (SELECT *, CASE WHEN speaker IS NOT DISTINCT FROM lag(speaker) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS ch FROM {cues} WINDOW w AS (PARTITION BY media ORDER BY cue_idx)))
    GROUP BY media, g""")
def speaker_groups(spark, d):
    return sequences.speaker_groups(adapters.cues(spark, d))


@query("""WITH t AS (SELECT *, sum(ch) OVER (PARTITION BY media ORDER BY start_ms, seg) AS turn FROM (SELECT *, CASE WHEN raw_speaker = lag(raw_speaker) OVER (PARTITION BY media ORDER BY start_ms, seg) THEN 0 ELSE 1 END AS ch FROM {raw_segments})),
    p AS (SELECT *, sum(far) OVER (PARTITION BY media, turn ORDER BY start_ms, seg) AS part FROM (SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY media, turn ORDER BY start_ms, seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100 THEN 0 ELSE 1 END AS far FROM t))
    SELECT media, CAST(turn AS BIGINT) AS turn, any_value(raw_speaker) AS raw_speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM p GROUP BY media, turn, part""")
def remerge(spark, d):
    return sequences.remerge_speaker(adapters.raw_segments(spark, d))


@query("""WITH n AS (SELECT media, count(*) AS n FROM {frames} GROUP BY 1), b AS (SELECT n.media, CAST(r.b AS INTEGER) AS bucket FROM n, range(20) r(b)),
    k AS (SELECT f.media, CAST(floor(frame_idx * 20 / n) AS INTEGER) AS bucket, max(abs(p)) AS peak FROM {frames} f JOIN n ON f.media = n.media GROUP BY 1, 2),
    z AS (SELECT b.media, b.bucket, coalesce(peak, 0) AS peak FROM b LEFT JOIN k ON b.media = k.media AND b.bucket = k.bucket)
    SELECT *, CASE WHEN max(peak) OVER (PARTITION BY media) > 0 THEN peak / max(peak) OVER (PARTITION BY media) ELSE peak END AS norm FROM z""")
def waveform_peaks(spark, d):
    return sequences.peaks(adapters.frames(spark, d).select("media", F.col("frame_idx").alias("i"), F.col("p").alias("x")), 20)


@query("SELECT event_id, event_type FROM events WHERE value > 1 ORDER BY ts DESC, event_id DESC LIMIT 100")
def tail_lines(spark, d):
    return sequences.tail(table(spark, d, "events").where("value > 1"), 100, "ts", "event_id").select("event_id", "event_type")


@query("""SELECT task_id, chunk_idx, n_cues FROM {chunks} WHERE chunk_idx > 2""")
def cursor_poll(spark, d):
    return adapters.chunks(spark, d).where("chunk_idx > 2").select("task_id", "chunk_idx", "n_cues")


@query("""SELECT event_id, user_id, CAST(floor((rn - 1) / 25) AS INTEGER) AS batch FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    WHERE user_id % 2 = 1 OR floor((rn - 1) / 25) < floor(n / 25)""")
def micro_batches(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id")
    return sequences.fixed_batches(e, 25, F.col("user_id") % 2 == 0, "user_id", "event_id")


@query("""SELECT user_id, event_id, coalesce(c, '') AS context FROM (SELECT user_id, event_id, row_number() OVER w AS rn, string_agg(event_type, '|') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS c
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE rn % 25 = 1""")
def rolling_context(spark, d):
    return sequences.rolling_context(table(spark, d, "events").select("user_id", "event_id", "event_type"), 25, 5, "user_id", "event_id", "event_type")


# ---- intervals and speakers


_OVER = """SELECT c.media, c.cue_idx, t.pos, t.speaker AS r_speaker, greatest(c.start_ms, t.start_ms) AS clip_start, least(c.end_ms, t.end_ms) AS clip_end
    FROM {cues} c JOIN {speaker_timeline} t ON c.media = t.media AND greatest(c.start_ms, t.start_ms) < least(c.end_ms, t.end_ms)"""


@query(_OVER)
def overlap_clip(spark, d):
    return intervals.overlap_join(adapters.cues(spark, d).select("media", "cue_idx", "start_ms", "end_ms"), adapters.speaker_timeline(spark, d)).select("media", "cue_idx", F.col("r_pos").alias("pos"), "r_speaker", "clip_start", "clip_end")


@query(f"""WITH o AS ({_OVER}), s AS (SELECT media, cue_idx, r_speaker, sum(clip_end - clip_start) AS ms, min(pos) AS pos FROM o GROUP BY ALL),
    a AS (SELECT c.media, c.cue_idx, c.end_ms - c.start_ms AS len, sum(ms) AS all_ms, max(ms) AS top, arg_max(r_speaker, ms * 100000 - pos) AS sp, count(*) FILTER (ms / (c.end_ms - c.start_ms) >= 0.25) AS q
          FROM {{cues}} c LEFT JOIN s ON s.media = c.media AND s.cue_idx = c.cue_idx GROUP BY 1, 2, 3)
    SELECT media, cue_idx, CASE WHEN len <= 0 OR all_ms IS NULL OR all_ms / len < 0.3 THEN 'none' WHEN top / len >= 0.7 THEN 'single' WHEN q >= 2 THEN 'split' ELSE 'single' END AS kind,
      CASE WHEN NOT (len <= 0 OR all_ms IS NULL OR all_ms / len < 0.3) THEN sp END AS speaker, CASE WHEN NOT (len <= 0 OR all_ms IS NULL OR all_ms / len < 0.3) THEN round(top / len, 6) END AS coverage FROM a""")
def cue_speaker(spark, d):
    return intervals.resolve_speakers(adapters.cues(spark, d), adapters.speaker_timeline(spark, d))


@query(f"""WITH o AS ({_OVER}), r AS (SELECT *, row_number() OVER (PARTITION BY media, cue_idx ORDER BY clip_end - clip_start DESC, pos) AS rn FROM o)
    SELECT c.media, c.cue_idx, r.r_speaker AS speaker FROM {{cues}} c LEFT JOIN r ON r.media = c.media AND r.cue_idx = c.cue_idx AND rn = 1""")
def cue_speaker_max(spark, d):
    return intervals.most_overlap(adapters.cues(spark, d), adapters.speaker_timeline(spark, d))


# points on the whole timeline of each media
_POINTS = "(SELECT media, i AS pos, i * 7777 AS at_ms FROM (SELECT media, unnest(range(0, CAST(max(end_ms) // 7777 + 1 AS BIGINT))) AS i FROM {cues} GROUP BY media))"


def _points(spark, d):
    last = adapters.cues(spark, d).groupBy("media").agg(F.max("end_ms").alias("last_end"))
    return last.select("media", F.explode(F.expr("sequence(0L, last_end, 7777L)")).alias("at_ms")).select("media", F.expr("at_ms div 7777").alias("pos"), "at_ms")


@query(f"""SELECT p.media, p.pos, CASE WHEN p.at_ms < c.end_ms THEN c.cue_idx ELSE -1 END AS cue_idx FROM {_POINTS} p LEFT JOIN
    (SELECT p.media, p.pos, max(cue_idx) AS m FROM {_POINTS} p JOIN {{cues}} c ON c.media = p.media AND c.start_ms <= p.at_ms GROUP BY 1, 2) x ON x.media = p.media AND x.pos = p.pos
    LEFT JOIN {{cues}} c ON c.media = p.media AND c.cue_idx = x.m""")
def active_cue(spark, d):
    return intervals.active_cue(_points(spark, d), adapters.cues(spark, d))


_NEAR = f"""SELECT * FROM (SELECT p.media, p.pos, p.at_ms, c.cue_idx, c.start_ms AS cue_ms, row_number() OVER (PARTITION BY p.media, p.pos ORDER BY abs(c.start_ms - p.at_ms), c.start_ms, c.cue_idx) AS rn
    FROM {_POINTS} p JOIN {{cues}} c ON c.media = p.media) WHERE rn = 1"""


@query(f"SELECT media, pos, at_ms, cue_idx, cue_ms FROM ({_NEAR})")
def nearest_source(spark, d):
    return intervals.nearest_cue(_points(spark, d), adapters.cues(spark, d))


@query(f"""SELECT media, pos, cue_ms AS start_ms, title FROM (SELECT n.media, n.pos, n.cue_ms, 'chapter ' || CAST(n.pos AS VARCHAR) AS title, row_number() OVER (PARTITION BY n.media, n.cue_ms ORDER BY n.pos) AS k
    FROM ({_NEAR}) n JOIN (SELECT media, arg_max(end_ms, cue_idx) AS e FROM {{cues}} GROUP BY 1) l ON l.media = n.media AND n.at_ms <= l.e) WHERE k = 1""")
def chapter_snap(spark, d):
    chapters = _points(spark, d).select("media", "pos", F.col("at_ms").alias("start_ms"), F.concat(F.lit("chapter "), F.col("pos").cast("string")).alias("title"))
    return intervals.snap_chapters(chapters, adapters.cues(spark, d))


@query("""SELECT label, pos, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings) GROUP BY 1, 2""")
def centroids(spark, d):
    c = speakers.mean_vectors(table(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


_CONS = """WITH e AS (SELECT label, list(x ORDER BY pos) AS v FROM (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT media, raw_speaker, sum(greatest(0, end_ms - start_ms)) / 1000 AS duration_s FROM {raw_segments} GROUP BY 1, 2),
    k AS (SELECT s.*, e.v, sum(duration_s) OVER (PARTITION BY media) AS total FROM s JOIN e ON e.label = s.raw_speaker),
    r AS (SELECT *, row_number() OVER (PARTITION BY media ORDER BY duration_s DESC, raw_speaker) - 1 AS rk, duration_s >= 8 AND duration_s / greatest(total, 1e-9) >= 0.2 AS fits FROM k),
    m AS (SELECT *, fits OR (NOT bool_or(fits) OVER (PARTITION BY media) AND rk = 0) AS major FROM r),
    l AS (SELECT *, 'speaker_' || chr(CAST(65 + row_number() OVER (PARTITION BY media ORDER BY rk) - 1 AS INTEGER)) AS speaker_id FROM m WHERE major),
    o AS (SELECT a.media, a.raw_speaker, a.duration_s, l.speaker_id, list_cosine_similarity(a.v, l.v) AS score, row_number() OVER (PARTITION BY a.media, a.raw_speaker ORDER BY list_cosine_similarity(a.v, l.v) DESC, l.rk) AS k
          FROM m a JOIN l ON l.media = a.media WHERE NOT a.major),
    f AS (SELECT media, raw_speaker, duration_s, speaker_id FROM l UNION ALL SELECT media, raw_speaker, duration_s, CASE WHEN score >= 0.2 THEN speaker_id ELSE 'unknown' END FROM o WHERE k = 1)"""


def _consolidated(spark, d):
    c = speakers.mean_vectors(table(spark, d, "embeddings"), "label", "embedding").withColumnRenamed("label", "raw_speaker")
    segments = adapters.raw_segments(spark, d)
    return speakers.consolidate(segments, segments.select("media", "raw_speaker").distinct().join(c, "raw_speaker"), share=0.2, merge_at=0.2)


@query(_CONS + " SELECT media, raw_speaker, round(duration_s, 3) AS duration_s, speaker_id FROM f")
def consolidate(spark, d):
    return _consolidated(spark, d).withColumn("duration_s", F.round("duration_s", 3))


@query(_CONS + """ SELECT media, speaker_id, round(sum(duration_s), 3) AS duration_s, round(sum(duration_s) / sum(sum(duration_s)) OVER (PARTITION BY media), 6) AS ratio FROM f GROUP BY 1, 2""")
def final_speakers(spark, d):
    return speakers.final_speakers(_consolidated(spark, d))


@query("""SELECT media, raw_speaker, seg, start_ms, end_ms FROM (SELECT *, row_number() OVER (PARTITION BY media, raw_speaker ORDER BY end_ms - start_ms DESC, start_ms, seg) AS rn FROM {raw_segments} WHERE end_ms - start_ms >= 2000) WHERE rn <= 3""")
def rep_segments(spark, d):
    return speakers.representative_segments(adapters.raw_segments(spark, d), 3, 2.0)


# ---- text


@query(r"""SELECT doc_id, greatest(1, ceil(k + w / 3 + (n - k - w - s) + s / 8), ceil(n / 2))::BIGINT AS tokens FROM (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]', '', 'g')) AS k,
    length(regexp_replace(text, '[^A-Za-z0-9_]', '', 'g')) AS w, length(regexp_replace(text, '[^\t-\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]', '', 'g')) AS s FROM documents WHERE text IS NOT NULL)""")
def token_estimate(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("""SELECT source, arg_min(lang, (-n) * 1000000000 + first) AS lang FROM (SELECT source, lang, count(*) AS n, min(doc_id) AS first FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def language_vote(spark, d):
    n = table(spark, d, "documents").where("lang is not null").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return n.groupBy("source").agg(F.max_by("lang", F.struct("n", -F.col("first"))).alias("lang"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' END AS script_lang FROM documents""")
def dominant_script(spark, d):
    return table(spark, d, "documents").select("doc_id", T.dominant_language(F.col("text")).alias("script_lang"))


@query()
def casing(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sentence_case(F.col("text")).alias("text"))


_CLOCK = "CASE WHEN {h} < 100 THEN lpad(CAST({h} AS VARCHAR), 2, '0') ELSE CAST({h} AS VARCHAR) END || ':' || lpad(CAST(({x} % 3600000) // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({x} % 60000) // 1000 AS VARCHAR), 2, '0') || '{m}' || lpad(CAST({x} % 1000 AS VARCHAR), 3, '0')"


def _clock(x: str, mark: str) -> str:
    return "(" + _CLOCK.format(h=f"({x} // 3600000)", x=x, m=mark) + ")"


@query(f"""SELECT media, 'WEBVTT' || chr(10) || chr(10) || string_agg({_clock("start_ms", ".")} || ' --> ' || {_clock("end_ms", ".")} || chr(10) || text || chr(10), chr(10) ORDER BY cue_idx) AS content FROM {{cues}} GROUP BY 1""")
def vtt_export(spark, d):
    return subtitles.to_vtt(adapters.cues(spark, d))


@query(f"""SELECT media, string_agg(CAST(rn AS VARCHAR) || chr(10) || {_clock("start_ms", ",")} || ' --> ' || {_clock("end_ms", ",")} || chr(10) || text || chr(10), chr(10) ORDER BY cue_idx) || chr(10) AS content
    FROM (SELECT *, row_number() OVER (PARTITION BY media ORDER BY cue_idx) AS rn FROM {{cues}}) GROUP BY 1""")
def srt_export(spark, d):
    return subtitles.to_srt(adapters.cues(spark, d))


@query("SELECT media, string_agg(text, chr(10) ORDER BY cue_idx) || chr(10) AS content FROM {cues} GROUP BY 1")
def txt_export(spark, d):
    return subtitles.to_txt(adapters.cues(spark, d))


@query("SELECT media, start_ms, end_ms, text FROM {cues} WHERE text <> ''")
def vtt_roundtrip(spark, d):
    return subtitles.parse_vtt(subtitles.to_vtt(adapters.cues(spark, d))).drop("at")


@query("SELECT media, start_ms, end_ms, trim(text) AS text FROM {cues} WHERE trim(text) <> ''")
def srt_roundtrip(spark, d):
    return subtitles.parse_srt(subtitles.to_srt(adapters.cues(spark, d))).select("media", "start_ms", "end_ms", "text")


@query("""SELECT c.media, c.cue_idx, c.start_ms, c.end_ms, c.text || chr(10) || '> ' || c.text AS text, c.media % 3 <> 0 AS ok
    FROM {cues} c JOIN (SELECT media, count(*) AS n FROM {cues} GROUP BY 1) k ON k.media = c.media""")
def bilingual(spark, d):
    c = adapters.cues(spark, d)
    other = c.withColumn("text", F.concat(F.lit("> "), F.col("text"))).withColumn("end_ms", F.when(F.col("media") % 3 == 0, F.col("end_ms") + 1).otherwise(F.col("end_ms")))
    return subtitles.bilingual(c, other)


@query("SELECT media, bool_or(end_ms <= start_ms OR coalesce(start_ms < prev, false)) AS invalid FROM (SELECT *, lag(start_ms) OVER (PARTITION BY media ORDER BY cue_idx) AS prev FROM {cues}) GROUP BY 1")
def srt_validity(spark, d):
    return subtitles.time_problems(adapters.cues(spark, d))


@query("""SELECT sha256(CAST(event_id AS VARCHAR)) AS id, sha256('{"event_type":"' || event_type || '","user_id":' || CAST(user_id AS VARCHAR) || '}') AS fingerprint FROM events""")
def fingerprint(spark, d):
    return table(spark, d, "events").select(adapters.sha_of("event_id").alias("id"), F.sha2(F.to_json(F.struct("event_type", "user_id")).cast("binary"), 256).alias("fingerprint"))


@query("""SELECT media, cue_idx, 'cue-' || lpad(CAST(row_number() OVER (PARTITION BY media ORDER BY cue_idx) AS VARCHAR), 5, '0') AS source_id,
    lower(lpad(printf('%x', list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(list_filter(string_split(left(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 240), ''), lambda c: c <> ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: CAST((CAST(xor(h, c) AS HUGEINT) * 16777619) % 4294967296 AS BIGINT))), 8, '0')) AS hash FROM {cues}""")
def fnv_snippet(spark, d):
    c = adapters.cues(spark, d)
    n = F.row_number().over(Window.partitionBy("media").orderBy("cue_idx")).cast("string")
    return c.select("media", "cue_idx", F.concat(F.lit("cue-"), F.lpad(n, 5, "0")).alias("source_id"), T.fnv1a(F.substring(T.collapse_space(F.col("text")), 1, 240)).alias("hash"))


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '([^/]*)$', 1) AS name FROM pages""")
def url_names(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(u, r"^[a-z]+://([^/?#]+)", 1).alias("host"), F.element_at(F.split(F.regexp_extract(u, r"^[a-z]+://[^/?#]+([^?#]*)", 1), "/"), -1).alias("name"))


@query("""SELECT p_partkey, CAST(floor(round(p_retailprice, 1) * [1, 1024, 1048576, 1073741824][p_partkey % 4 + 1] + 0.5) AS BIGINT) AS bytes FROM part""")
def size_parse(spark, d):
    p = table(spark, d, "part")
    unit = F.element_at(F.array(*map(F.lit, ("B", "KiB", "MiB", "GiB"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return p.select("p_partkey", P.size_bytes(F.concat(F.round("p_retailprice", 1).cast("string"), unit)).alias("bytes"))


@query("SELECT media, cue_idx FROM {cues} WHERE contains(lower(text), 'tion')")
def cue_search(spark, d):
    return adapters.cues(spark, d).where(F.contains(F.lower("text"), F.lit("tion"))).select("media", "cue_idx")


@query("""SELECT quality, toxic, count(*) AS n, CAST(least(round(sum(quality * 60 + (1 - toxic) * 40) / count(*), 4), CASE WHEN toxic = 1 THEN 79 ELSE 100 END) AS DOUBLE) AS score FROM labels GROUP BY 1, 2""")
def rubric_score(spark, d):
    x = table(spark, d, "labels")
    score = F.round(F.sum(F.col("quality") * 60 + (1 - F.col("toxic")) * 40) / F.count("*"), 4)
    return x.groupBy("quality", "toxic").agg(F.count("*").alias("n"), score.alias("s")).select("quality", "toxic", "n", F.least("s", F.when(F.col("toxic") == 1, 79.0).otherwise(100.0)).alias("score"))
