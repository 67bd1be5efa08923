"""Queries over state transitions and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.functions import text as T
from cueloom.plans import queue, state
from cueloom.sources import adapters
from cueloom.sources.adapters import table

from .queries import query


@query("""WITH w AS (SELECT left(sha256(CAST(i AS VARCHAR)), CAST(6 + i % 5 AS INTEGER)) AS prefix FROM range(1, 400) r(i)), v AS (SELECT sha256 AS s FROM {videos} WHERE coalesce(deleted_at, 0) = 0),
    n AS (SELECT w.prefix, count(s) AS n, min(s) AS s FROM (SELECT DISTINCT prefix FROM w) w LEFT JOIN v ON starts_with(v.s, w.prefix) GROUP BY 1)
    SELECT prefix, CASE n WHEN 0 THEN 'missing' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS state, CASE n WHEN 1 THEN s END AS sha256 FROM n""")
def resolve_prefix(spark, d):
    i = F.col("id")
    wanted = spark.range(1, 400).select(F.expr("left(sha2(cast(cast(id as string) as binary), 256), cast(6 + id % 5 as int))").alias("prefix"), i)
    return state.resolve_prefix(adapters.videos(spark, d), wanted)


@query()
def highlight(spark, d):
    return state.highlight(table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), "text"), "key", "text", "the")


@query("""SELECT sha256, regexp_full_match(sha256, '[0-9a-f]{64}') AS sha_ok, regexp_full_match(coalesce(display_name, ''), '[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*') AS lang_ok FROM {videos}""")
def validators(spark, d):
    return adapters.videos(spark, d).select("sha256", state.valid_sha("sha256").alias("sha_ok"), state.valid_lang("display_name").alias("lang_ok"))


@query("""WITH j AS (SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'completed') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'canceled') AS canceled, count(*) FILTER (status IN ('queued', 'running')) AS active FROM {batch_items} GROUP BY 1),
    s AS (SELECT *, CASE WHEN canceled = total THEN 'canceled' WHEN active = 0 AND failed > 0 THEN 'failed' WHEN active = 0 AND done = total THEN 'completed' ELSE 'running' END AS status FROM j)
    SELECT s.batch_id, s.status, CAST(floor((done + failed) / total * 100 + 0.5) AS INTEGER) AS pct FROM s JOIN {tasks} t ON t.id = s.batch_id WHERE s.status IN ('queued', 'running') OR failed > 0 OR 899251200000 - t.created_at < 86400000""")
def visible_batches(spark, d):
    jobs = queue.batch_rollup(adapters.batch_items(spark, d)).join(adapters.tasks(spark, d).select(F.col("id").alias("batch_id"), "created_at"), "batch_id")
    return state.visible_batches(jobs, 899_251_200_000)


@query("SELECT sha256, coalesce(original_name, 'media-' || CAST(last_opened_at % 10 AS VARCHAR)) AS original_name FROM {videos}")
def backfill_names(spark, d):
    v = adapters.videos(spark, d).select("sha256", "original_name", "last_opened_at")
    new = v.select("sha256", F.concat(F.lit("media-"), (F.col("last_opened_at") % 10).cast("string")).alias("original_name"))
    return state.set_if_null(v, new, "sha256", "original_name").select("sha256", "original_name")


@query("""WITH w AS (SELECT DISTINCT video_sha AS sha256 FROM {tasks}), h AS (SELECT DISTINCT video_sha AS sha256, kind FROM {tasks} WHERE status = 'completed'),
    s AS (SELECT w.sha256, k FROM w, unnest(['transcribe', 'translate', 'insight']) t(k))
    SELECT s.sha256, array_to_string(list_sort(list(s.k)), ',') AS steps FROM s LEFT JOIN h ON h.sha256 = s.sha256 AND h.kind = s.k WHERE h.kind IS NULL GROUP BY 1""")
def batch_creation(spark, d):
    """For the media of all tasks."""
    t = adapters.tasks(spark, d)
    done = t.where("status = 'completed'").select(F.col("video_sha").alias("sha256"), F.col("kind").alias("step"))
    items = state.create_batch(t.select(F.col("video_sha").alias("sha256")), adapters.videos(spark, d), done, ["transcribe", "translate", "insight"])
    return items.select("sha256", F.array_join(F.array_sort("steps"), ",").alias("steps"))


@query("""WITH r AS (SELECT batch_id, CASE status WHEN 'failed' THEN 'queued' ELSE status END AS status FROM {batch_items}), n AS (SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'completed') AS done, count(*) FILTER (status = 'canceled') AS canceled, count(*) FILTER (status IN ('queued', 'running')) AS active FROM r GROUP BY 1)
    SELECT batch_id, CASE WHEN canceled = total THEN 'canceled' WHEN active = 0 AND done = total THEN 'completed' ELSE 'running' END AS status, active FROM n""")
def retry_failed(spark, d):
    return queue.batch_rollup(state.retry_failed(adapters.batch_items(spark, d))).select("batch_id", "status", "active")


@query("SELECT id, CASE WHEN status = 'completed' AND video_sha NOT IN (SELECT sha256 FROM {videos} WHERE has_transcript = 1) THEN 'queued' ELSE status END AS status FROM {tasks}")
def self_heal(spark, d):
    kinds = F.explode(F.array(*map(F.lit, adapters.KINDS))).alias("kind")
    there = adapters.videos(spark, d).where("has_transcript = 1").select(F.col("sha256").alias("video_sha"), kinds)
    return state.self_heal(adapters.tasks(spark, d), there).select("id", "status")


@query("""SELECT o_orderkey AS batch_id, coalesce(max(l_returnflag) FILTER (l_linenumber = 1), 'pending') AS transcribe, coalesce(struct_extract(max({'a': l_linenumber, 's': l_returnflag}) FILTER (l_linenumber > 1), 's'), 'pending') AS translate
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def step_map(spark, d):
    start = F.create_map(F.lit("transcribe"), F.lit("pending"), F.lit("translate"), F.lit("pending"))
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("batch_id"), start.alias("steps"))
    steps = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.when(F.col("l_linenumber") == 1, "transcribe").otherwise("translate").alias("step"), F.col("l_returnflag").alias("state"), F.col("l_linenumber").alias("at"))
    out = state.set_step(items, steps, ["batch_id"])
    return out.select("batch_id", F.col("steps")["transcribe"].alias("transcribe"), F.col("steps")["translate"].alias("translate"))


@query("""SELECT sha256 AS video_sha, 'speaker_A' AS speaker_id, CASE WHEN last_opened_at % 2 = 0 THEN 'Host ' || left(sha256, 4) ELSE display_name END AS display_name FROM {videos}""")
def rename_speakers(spark, d):
    v = adapters.videos(spark, d)
    s = v.select(F.col("sha256").alias("video_sha"), F.lit("speaker_A").alias("speaker_id"), "display_name")
    names = v.where("last_opened_at % 2 = 0").select(F.col("sha256").alias("video_sha"), F.lit("speaker_A").alias("speaker_id"), F.concat(F.lit("Host "), F.substring("sha256", 1, 4)).alias("display_name"))
    return state.rename_speakers(s, names)


@query("SELECT task_id, chunk_idx, CASE WHEN task_id NOT IN (SELECT id FROM {tasks} WHERE video_sha IN (SELECT sha256 FROM {videos} WHERE deleted_at > 0)) THEN quality END AS timeline FROM {chunks}")
def diarize_reset(spark, d):
    gone = adapters.videos(spark, d).where("deleted_at > 0").select(F.col("sha256").alias("video_sha"))
    c = adapters.chunks(spark, d).select("task_id", "chunk_idx", F.col("quality").alias("timeline"))
    return state.reset_timelines(c, adapters.tasks(spark, d), gone)


@query("SELECT video_sha, id AS artifact FROM (SELECT *, row_number() OVER (PARTITION BY video_sha ORDER BY created_at DESC, id DESC) AS rn FROM {tasks} WHERE kind = 'insight') WHERE rn = 1")
def latest_artifacts(spark, d):
    t = adapters.tasks(spark, d).where("kind = 'insight'")
    bodies = t.select(F.col("video_sha").alias("media"), F.col("id").alias("fingerprint"), "created_at")
    pointers = queue.latest(bodies.select("media", "created_at", F.col("fingerprint").alias("id")), "media").select("media", F.col("id").alias("fingerprint"))
    return state.valid_artifacts(bodies, pointers).select(F.col("media").alias("video_sha"), F.col("fingerprint").alias("artifact"))


@query("SELECT task_id, CAST(max(chunk_idx) + 1 AS INTEGER) AS next_idx FROM {chunks} GROUP BY 1")
def resume_index(spark, d):
    return state.resume_index(adapters.chunks(spark, d))


@query("""SELECT sha256 AS video_sha FROM {videos} WHERE has_transcript = 1 UNION SELECT t.video_sha FROM {tasks} t JOIN {chunks} c ON c.task_id = t.id WHERE t.status = 'running' GROUP BY 1 HAVING sum(c.n_cues) >= 25""")
def ready_media(spark, d):
    t = adapters.tasks(spark, d).where("status = 'running'").select(F.col("id").alias("task_id"), "video_sha")
    live = adapters.chunks(spark, d).join(t, "task_id").groupBy("video_sha").agg(F.sum("n_cues").alias("cues"))
    return state.ready_media(adapters.videos(spark, d).where("has_transcript = 1").select(F.col("sha256").alias("video_sha")), live)


@query("""WITH l AS (SELECT video_sha, status FROM (SELECT *, row_number() OVER (PARTITION BY video_sha ORDER BY created_at DESC, id DESC) AS rn FROM {tasks} WHERE kind = 'transcribe') WHERE rn = 1)
    SELECT id, CASE WHEN kind <> 'transcribe' AND t.status IN ('queued', 'running') AND l.status = 'failed' THEN 'canceled' ELSE t.status END AS status FROM {tasks} t LEFT JOIN l USING (video_sha)""")
def cancel_dependents(spark, d):
    return state.cancel_dependents(adapters.tasks(spark, d)).select("id", "status")


@query("""WITH x AS (SELECT batch_id, item, s, ['transcribe', 'translate', 'insight'][s + 1] AS stage FROM (SELECT DISTINCT batch_id, item FROM {batch_items}), range(3) r(s))
    SELECT batch_id, item, stage, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY item, s) AS INTEGER) AS by_file, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY least(s, 1), item, s) AS INTEGER) AS fast_first FROM x""")
def batch_order(spark, d):
    items, stages = adapters.batch_items(spark, d).select("batch_id", "item").distinct(), ["transcribe", "translate", "insight"]
    a = state.batch_order(items, stages, "complete_each_file").withColumnRenamed("turn", "by_file")
    return a.join(state.batch_order(items, stages, "fast_first").withColumnRenamed("turn", "fast_first"), ["batch_id", "item", "stage"])


@query("SELECT speaker, CAST(sum(end_ms - start_ms) AS BIGINT) AS ms, round(sum(end_ms - start_ms) / sum(sum(end_ms - start_ms)) OVER (), 6) AS ratio FROM {cues} WHERE speaker IS NOT NULL GROUP BY 1")
def speaker_stats(spark, d):
    per = adapters.cues(spark, d).where("speaker is not null").groupBy("speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("ms").alias("all_ms")))).select("speaker", "ms", F.round(F.col("ms") / F.col("all_ms"), 6).alias("ratio"))


@query(r"""SELECT doc_id, len(regexp_extract_all('see cue-' || lpad(CAST(doc_id % 99999 AS VARCHAR), 5, '0') || ' and [00:01:02-00:03:04] ' || coalesce(lang, ''), 'cue-\d{5}|\[\d{2}:\d{2}:\d{2}(?:-\d{2}:\d{2}:\d{2})?\]')) AS n,
    'cue-' || lpad(CAST(doc_id % 99999 AS VARCHAR), 5, '0') AS first FROM documents""")
def citations(spark, d):
    t = F.concat(F.lit("see cue-"), F.lpad((F.col("doc_id") % 99999).cast("string"), 5, "0"), F.lit(" and [00:01:02-00:03:04] "), F.coalesce("lang", F.lit("")))
    found = F.regexp_extract_all(t, F.lit(r"cue-\d{5}|\[\d{2}:\d{2}:\d{2}(?:-\d{2}:\d{2}:\d{2})?\]"), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.get(found, F.lit(0)).alias("first"))


@query("""SELECT event_id, 'before' || CASE WHEN event_id % 3 = 0 THEN ' after' ELSE '' END AS shown FROM events""")
def think_strip(spark, d):
    t = F.when(F.col("event_id") % 3 == 0, F.lit("before<think>a\nb</think> after")).otherwise(F.lit("before <think>never closed"))
    return table(spark, d, "events").select("event_id", T.strip_think(t).alias("shown"))


@query("""SELECT page_id, sha256(coalesce(html, '')) AS sha, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS bytes FROM pages WHERE octet_length(encode(coalesce(html, ''))) <= 2147483648""")
def hash_import(spark, d):
    h = F.coalesce("html", F.lit(""))
    return table(spark, d, "pages").select("page_id", F.sha2(h.cast("binary"), 256).alias("sha"), F.octet_length(h).cast("long").alias("bytes")).where(F.col("bytes") <= 2 << 30)


@query(r"""SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS dir, count(*) AS files, CAST(sum(octet_length(encode(coalesce(html, '')))) AS BIGINT) AS bytes FROM pages GROUP BY 1""")
def dir_sizes(spark, d):
    p = table(spark, d, "pages")
    return p.groupBy(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("dir")).agg(F.count("*").alias("files"), F.sum(F.octet_length(F.coalesce("html", F.lit(""))).cast("long")).alias("bytes"))
