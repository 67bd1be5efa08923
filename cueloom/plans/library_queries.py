"""Queries of library.py and of some text functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.functions import text as T
from cueloom.plans import library
from cueloom.plans.queries import query
from cueloom.sources import adapters, subtitles
from cueloom.sources.adapters import table


@query("""WITH l AS (SELECT video_sha, arg_max(id, (created_at, id)) AS id, arg_max(status, (created_at, id)) AS status FROM {tasks} WHERE kind = 'transcribe' GROUP BY 1)
    SELECT v.sha256 AS video_sha, coalesce(l.id, -1) AS id, CASE WHEN l.id IS NULL OR l.status IN ('failed', 'canceled') THEN 'queued' ELSE l.status END AS status,
        CASE WHEN l.id IS NULL THEN 'created' WHEN l.status IN ('failed', 'canceled') THEN 'revived' ELSE 'kept' END AS action
    FROM {videos} v LEFT JOIN l ON l.video_sha = v.sha256""")
def ensure_tasks(spark, d):
    return library.ensure_tasks(adapters.tasks(spark, d).where("kind = 'transcribe'"), adapters.videos(spark, d).select(F.col("sha256").alias("video_sha"))).withColumn("id", F.coalesce("id", F.lit(-1)))


@query("""WITH i AS (SELECT batch_id, item, status, CASE WHEN item % 3 = 0 THEN 5 END AS started_at, CAST(NULL AS INTEGER) AS completed_at, CASE WHEN status = 'failed' THEN 'old' END AS error_msg,
        CASE item WHEN 1 THEN 'completed' WHEN 2 THEN 'running' WHEN 3 THEN 'failed' WHEN 4 THEN 'queued' END AS n, CASE item WHEN 3 THEN 'new' END AS e FROM {batch_items}),
    c AS (SELECT *, n IS NOT NULL AND status <> 'canceled' AS changed FROM i)
    SELECT batch_id, item, CASE WHEN changed THEN n ELSE status END AS status, coalesce(CASE WHEN changed AND started_at IS NULL AND n <> 'queued' THEN 99 ELSE started_at END, -1) AS started_at,
        coalesce(CASE WHEN changed AND n IN ('completed', 'failed') THEN 99 ELSE completed_at END, -1) AS completed_at, CASE WHEN changed AND e IS NOT NULL THEN e ELSE error_msg END AS error_msg, changed FROM c""")
def mark_items(spark, d):
    i = adapters.batch_items(spark, d).select("batch_id", "item", "status", F.when(F.col("item") % 3 == 0, 5).alias("started_at"), F.lit(None).cast("int").alias("completed_at"), F.when(F.col("status") == "failed", "old").alias("error_msg"))
    new = F.element_at(F.array(*map(F.lit, ("completed", "running", "failed", "queued"))), F.col("item").cast("int"))
    changes = i.where("item <= 4").select("batch_id", "item", new.alias("new_status"), F.when(F.col("item") == 3, "new").alias("new_error")).distinct()
    return library.mark_items(i, changes, ["batch_id", "item"], 99).withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("started_at", "completed_at")})


@query("""SELECT event_id, user_id % 7 IN (0, 1, 2, 3, 4, 5) AND event_id % 5 IN (0, 1, 2) AND event_id % 3 <> 2 AS ok,
        CASE WHEN user_id % 7 IN (0, 1, 2, 3, 4, 5) AND event_id % 5 IN (0, 1, 2) AND event_id % 3 <> 2 THEN CASE event_id % 5 WHEN 0 THEN 'de,pt-BR' WHEN 1 THEN '' ELSE 'en' END END AS langs FROM events""")
def batch_options(spark, d):
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    body = F.format_string(
        '{"whisperModel": "%s", "targetLangs": %s, "insights": true, "diarize": false%s}', pick(F.col("user_id"), *library.MODELS, "huge"),
        pick(F.col("event_id"), '["de", "pt-BR", "de"]', "[]", '["en"]', '["EN"]', '[1, "en"]'), pick(F.col("event_id"), "", ', "diarizeTopK": 2, "insightLanguage": "en"', ', "executionStrategy": "later"'),
    )
    x = table(spark, d, "events").select("event_id", library.batch_options(body).alias("o"))
    return x.select("event_id", F.col("o").isNotNull().alias("ok"), F.array_join("o.targetLangs", ",").alias("langs"))


@query("""WITH p AS (SELECT p_partkey, sha256(CAST(p_partkey AS VARCHAR)) AS s, p_partkey % 4 AS k FROM part)
    SELECT p_partkey, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE -1 END AS n_shas, k < 2 AS langs_ok FROM p""")
def sha_and_lang_lists(spark, d):
    s, k = adapters.sha_of("p_partkey"), F.col("p_partkey") % 4
    shas = F.when(k == 0, F.array(s, s)).when(k == 1, F.array(s, F.sha2(s.cast("binary"), 256), s)).when(k == 2, F.array(s, F.upper(s))).otherwise(F.array().cast("array<string>"))
    langs = F.when(k == 0, F.array(F.lit("en"))).when(k == 1, F.array(F.lit("en"), F.lit("zh_Hans-1"))).when(k == 2, F.array(F.lit("en"), F.lit("en"))).otherwise(F.array(F.lit("e n")))
    found = library.distinct_shas(shas)
    return table(spark, d, "part").select("p_partkey", F.when(found.isNotNull(), F.size(found)).otherwise(-1).alias("n_shas"), library.export_langs(langs).isNotNull().alias("langs_ok"))


@query("""SELECT o_orderkey, sha256('{"a":' || CAST(o_custkey AS VARCHAR) || ',"list":[{"x":1,"y":"' || o_orderstatus || '"}],"spec":{"Beta":' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END
        || CASE WHEN o_orderkey % 3 = 0 THEN ',"id":"m"' ELSE '' END || '}}') AS fingerprint FROM orders""")
def fingerprints(spark, d):
    spec = F.struct(F.when(F.col("o_orderkey") % 3 == 0, "m").alias("id"), (F.col("o_orderkey") % 2 == 0).alias("Beta"))
    value = F.struct(spec.alias("spec"), F.array(F.struct(F.col("o_orderstatus").alias("y"), F.lit(1).alias("x"))).alias("list"), F.col("o_custkey").alias("a"), F.lit("why").alias("policyReason"))
    return library.fingerprint(table(spark, d, "orders").select("o_orderkey", value.alias("v")), "v", ("policyReason",)).select("o_orderkey", "fingerprint")


@query("""SELECT event_id, CASE WHEN event_id % 8 = 7 THEN NULL WHEN event_id % 8 = 3 THEN '' ELSE 'About ' || event_type END AS summary,
        CASE WHEN event_id % 8 = 7 THEN NULL WHEN event_id % 8 = 3 THEN '' WHEN event_id % 4 = 0 THEN 'b0,b1,b2,b3' ELSE repeat('x', 217) || '...' END AS bullets,
        CASE WHEN event_id % 8 = 7 THEN NULL WHEN event_id % 8 = 3 THEN '' ELSE 'One:' || CAST(event_id AS VARCHAR) || ',Two:0' END AS chapters FROM events""")
def partial_insights(spark, d):
    bullets = F.when(F.col("event_id") % 4 == 0, '["b0", "b1", 5, " b2 ", "", "b3", "b4"]').otherwise('["' + "x" * 300 + '"]')
    body = F.concat(F.lit('{"summary": " About\\n '), F.col("event_type"), F.lit('", "summaryBullets": '), bullets, F.lit(', "chapters": [{"startMs": '), F.col("event_id").cast("string"), F.lit('.75, "title": "One"}, {"startMs": "1", "title": "no"}, {"startMs": 3, "title": " "}, {"startMs": -3, "title": "Two", "description": 4}]}'))
    array = F.concat(F.lit('["'), F.col("event_type"), F.lit('"]'))
    raw = F.when(F.col("event_id") % 8 == 3, array).when(F.col("event_id") % 8 == 7, F.col("event_type")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    x = table(spark, d, "events").select("event_id", library.partial_insight(raw).alias("p"))
    chapters = F.transform("p.chapters", lambda c: F.concat(c["title"], F.lit(":"), c["start_ms"].cast("string")))
    return x.select("event_id", "p.summary", F.array_join("p.bullets", ",").alias("bullets"), F.array_join(chapters, ",").alias("chapters"))


@query("""SELECT sha256, row_number() OVER (ORDER BY last_opened_at DESC, sha256) AS place FROM {videos} WHERE coalesce(deleted_at, 0) = 0 ORDER BY last_opened_at DESC, sha256 LIMIT 50""")
def recently_opened(spark, d):
    from cueloom.plans.queue import newest

    return newest(adapters.videos(spark, d).where(F.coalesce("deleted_at", F.lit(0)) == 0), "last_opened_at", "sha256", 50).select("sha256", "place")


@query("""SELECT i.batch_id, i.item, i.status, coalesce(v.display_name, v.original_name) AS name FROM {batch_items} i LEFT JOIN {videos} v ON v.sha256 = i.video_sha""")
def batch_with_media(spark, d):
    v = adapters.videos(spark, d).select(F.col("sha256").alias("video_sha"), F.coalesce("display_name", "original_name").alias("name"))
    return adapters.batch_items(spark, d).join(v, "video_sha", "left").select("batch_id", "item", "status", "name")


@query("""SELECT task_id, count(*) FILTER (quality = 'suspect') AS suspects FROM {chunks} GROUP BY 1""")
def suspect_counts(spark, d):
    return adapters.chunks(spark, d).groupBy("task_id").agg(F.count_if(F.col("quality") == "suspect").alias("suspects"))


@query("""SELECT id, kind FROM {tasks} WHERE kind = 'insight' AND status = 'running' UNION ALL SELECT id, kind FROM {tasks} WHERE kind = 'polish' AND status = 'running'""")
def running_ids(spark, d):
    t = adapters.tasks(spark, d).where("status = 'running'").select("id", "kind")
    return t.where("kind = 'insight'").unionByName(t.where("kind = 'polish'"))


@query("""SELECT l_orderkey, arg_max(l_linenumber, (v, -l_linenumber)) AS url, CAST(max(v) AS BIGINT) AS bytes_per_second FROM (SELECT *, CAST(l_quantity AS BIGINT) % 7 AS v FROM lineitem) WHERE v > 0 GROUP BY 1""")
def fastest_url(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), F.col("l_linenumber").alias("url"), (F.col("l_quantity").cast("long") % 7).alias("bytes_per_second"))
    return library.fastest(li, "l_orderkey")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'media-' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8) WHEN c_custkey % 5 = 1 THEN 'a_b_c' ELSE replace(c_name, '#', '#') || '.v1' END AS stem,
        CASE WHEN c_custkey = 0 THEN '0:05' WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) || ':00:05' WHEN c_custkey % 3 = 1 THEN '1:01' ELSE '' END AS length FROM customer""")
def file_names(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, F.lit(" .mp4")).when(k % 5 == 1, F.lit('\ta/\\b:"c.mkv')).otherwise(F.concat("c_name", F.lit(".v1.mp4")))
    seconds = F.when(k % 3 == 0, k * 3600.0 + 5.25).when(k % 3 == 1, 61.9)
    return table(spark, d, "customer").select("c_custkey", T.safe_name(name, adapters.sha_of("c_custkey")).alias("stem"), T.duration_text(seconds).alias("length"))


@query("""SELECT doc_id, regexp_matches(coalesce(text, ''), '(^|["''\\s])(/Users/|/tmp/|[A-Za-z]:\\\\)[^"''\\s]+') AS raw_path FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || ' "/tmp/x' WHEN 1 THEN text || 'a/tmp/x' WHEN 2 THEN 'C:\\x' ELSE text END AS text FROM documents)""")
def raw_paths(spark, d):
    k = F.col("doc_id") % 4
    said = F.when(k == 0, F.concat("text", F.lit(' "/tmp/x'))).when(k == 1, F.concat("text", F.lit("a/tmp/x"))).when(k == 2, F.lit("C:\\x")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.coalesce(T.has_raw_path(said), F.lit(False)).alias("raw_path"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'yue' END AS lang, CASE event_id % 4 WHEN 0 THEN 'SENSE_VOICE_NOT_CONFIGURED' WHEN 1 THEN 'WHISPER_NOT_CONFIGURED' ELSE 'FATAL_UNKNOWN' END AS code, event_id % 4 = 2 AS model_error FROM events""")
def tool_messages(spark, d):
    i = F.col("event_id")
    said = F.when(i % 3 == 0, "x: auto-detected language: EN (p = 0.9)").when(i % 3 == 1, "auto-detected language:yue").otherwise("auto-detected language: none")
    said = F.when(i % 3 == 2, F.lit("detected language: en")).otherwise(said)
    error = F.when(i % 4 == 0, "e: SENSE_VOICE_NOT_INSTALLED").when(i % 4 == 1, "Model not downloaded: x").when(i % 4 == 2, "failed to load model").otherwise("other")
    return table(spark, d, "events").select("event_id", T.detected_language(said).alias("lang"), library.task_error(error).alias("code"), library.is_model_error(error).alias("model_error"))


@query("""SELECT media, cue_idx, start_ms, end_ms FROM {cues} WHERE cue_idx % 3 <> 2""")
def strict_times(spark, d):
    """Every third cue has a point for a comma, which the strict form rejects."""
    c = adapters.cues(spark, d)
    times = F.concat(T.clock(F.col("start_ms"), ","), F.lit(" --> "), T.clock(F.col("end_ms"), ","))
    line = F.when(F.col("cue_idx") % 3 == 2, F.translate(times, ",", ".")).otherwise(F.concat(F.lit("\t"), times, F.lit(" \r")))
    files = c.groupBy("media").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_idx", line.alias("line")))), lambda s: s["line"]), "\nx\n").alias("content"))
    return subtitles.strict_srt_times(files).select("media", F.expr("at div 2").alias("cue_idx"), "start_ms", "end_ms")


@query("""SELECT sha256, CASE WHEN size_bytes >= 1000000000 THEN printf('%.2f GB', round(((size_bytes + 5000000) // 10000000) / 100, 2)) WHEN size_bytes >= 1000000 THEN printf('%.1f MB', round(((size_bytes + 50000) // 100000) / 10, 1))
    WHEN size_bytes >= 1000 THEN printf('%.1f KB', round(((size_bytes + 50) // 100) / 10, 1)) ELSE size_bytes || ' B' END AS size FROM {videos}""")
def size_texts(spark, d):
    return adapters.videos(spark, d).select("sha256", T.bytes_text(F.col("size_bytes")).alias("size"))


@query("""SELECT media, string_agg(lpad(CAST(start_ms // 3600000 AS VARCHAR), 2, '0') || lpad(CAST(start_ms // 60000 % 60 AS VARCHAR), 2, '0') || ' ' || regexp_replace(text, '\\s*\\n\\s*', ' ', 'g'), '|' ORDER BY cue_idx) AS content FROM {cues} WHERE text <> '' GROUP BY 1""")
def export_vtt(spark, d):
    """Written as WebVTT and read again: texts with their hours and minutes."""
    c = adapters.cues(spark, d).where("text <> ''").withColumn("text", F.regexp_replace("text", r"\s*\n\s*", " "))
    back = subtitles.parse_vtt(library.export(c.select("media", "cue_idx", "start_ms", "end_ms", "text"), "vtt"))
    row = F.concat(T.two_digits(F.floor(F.col("start_ms") / 3_600_000)), T.two_digits(F.floor(F.col("start_ms") % 3_600_000 / 60_000)), F.lit(" "), F.col("text"))
    return back.groupBy("media").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", row.alias("row")))), lambda s: s["row"]), "|").alias("content"))
