"""State transitions and small lookups of the library: prefixes, batches, artifacts, speakers, cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.plans.queue import ACTIVE


def resolve_prefix(videos: DataFrame, wanted: DataFrame, least: int = 6) -> DataFrame:
    """wanted (prefix) -> the live media whose sha begins so: found, ambiguous or missing.

    Both sides meet on the first `least` characters, which every prefix must have.
    """
    live = videos.where(F.coalesce("deleted_at", F.lit(0)) == 0).select("sha256", F.substring("sha256", 1, least).alias("head"))
    asked = wanted.where(F.length("prefix") >= least).withColumn("head", F.substring("prefix", 1, least))
    met = asked.join(live, "head").where(F.startswith("sha256", "prefix")).groupBy("prefix").agg(F.count("*").alias("n"), F.min("sha256").alias("sha256"))
    out = wanted.select("prefix").distinct().join(met, "prefix", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    state = F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "found").otherwise("ambiguous")
    return out.select("prefix", state.alias("state"), F.when(F.col("n") == 1, F.col("sha256")).alias("sha256"))


def highlight(rows: DataFrame, key: str, text: str, needle: str) -> DataFrame:
    """Each text as runs that are the needle, as it is written but in any case, or are between needles."""
    pattern = r"(?iu)\Q" + needle.replace(r"\E", r"\E\\E\Q") + r"\E"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    run = lambda t, m: F.struct(t.alias("t"), F.lit(m).alias("is_match"))
    runs = F.flatten(F.transform(F.arrays_zip(pieces.alias("p"), found.alias("m")), lambda x: F.array(run(x["p"], False), run(x["m"], True))))
    kept = F.filter(runs, lambda r: r["t"].isNotNull() & (r["t"] != ""))
    return rows.select(key, F.posexplode(kept).alias("pos", "r")).select(key, "pos", "r.*")


def valid_sha(col: str) -> Column:
    return F.coalesce(F.col(col).rlike("^[0-9a-f]{64}$"), F.lit(False))


def valid_lang(col: str) -> Column:
    return F.coalesce(F.col(col).rlike("^[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*$"), F.lit(False))


def visible_batches(jobs: DataFrame, now_ms: int, day_ms: int = 86_400_000) -> DataFrame:
    """jobs (batch_id, status, done, failed, total, created_at) that are active, have failures or are young, with their progress."""
    shown = F.col("status").isin(*ACTIVE) | (F.col("failed") > 0) | (now_ms - F.col("created_at") < day_ms)
    pct = F.when(F.col("total") > 0, F.floor((F.col("done") + F.col("failed")) / F.col("total") * 100 + 0.5)).otherwise(0)
    return jobs.where(shown).select("batch_id", "status", pct.cast("int").alias("pct"))


def set_if_null(target: DataFrame, rows: DataFrame, key: str, col: str) -> DataFrame:
    return target.join(rows.select(key, F.col(col).alias("__new")), key, "left").withColumn(col, F.coalesce(col, "__new")).drop("__new")


def create_batch(wanted: DataFrame, videos: DataFrame, done: DataFrame, steps: list[str]) -> DataFrame:
    """wanted (sha256) -> items (sha256, steps) of the media that lack some of the steps; one unknown media voids all.

    The void is a join on a one-row count, so nothing is decided on the driver.
    """
    asked = wanted.select("sha256").distinct()
    unknown = asked.join(videos.select("sha256"), "sha256", "left_anti").agg((F.count("*") == 0).alias("all_known"))
    have = done.groupBy("sha256").agg(F.collect_set("step").alias("have"))
    need = F.array_except(F.array(*map(F.lit, steps)), F.coalesce("have", F.array().cast("array<string>")))
    return asked.join(have, "sha256", "left").select("sha256", need.alias("steps")).where(F.size("steps") > 0).join(F.broadcast(unknown), F.col("all_known")).drop("all_known")


def retry_failed(items: DataFrame) -> DataFrame:
    """Failed items are queued again and their errors forgotten."""
    failed = F.col("status") == "failed"
    return items.withColumn("status", F.when(failed, "queued").otherwise(F.col("status")))


def self_heal(tasks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Tasks that are done but whose artifact (video_sha, kind) is gone are queued again."""
    there = artifacts.select("video_sha", "kind", F.lit(True).alias("there")).distinct()
    lost = F.col("status").isin("completed", "done") & F.col("there").isNull()
    return tasks.join(there, ["video_sha", "kind"], "left").withColumn("status", F.when(lost, "queued").otherwise(F.col("status"))).drop("there")


def set_step(items: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """items with a map `steps`, in which steps (keys, step, state) are put, the last by `at` where one has several."""
    last = steps.groupBy(*keys, "step").agg(F.max(F.struct("at", "state"))["state"].alias("state"))
    new = last.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("step", "state"))).alias("__new"))
    kept = F.map_filter("steps", lambda k, v: ~F.coalesce(F.map_contains_key("__new", k), F.lit(False)))
    return items.join(new, keys, "left").withColumn("steps", F.when(F.col("__new").isNull(), F.col("steps")).otherwise(F.map_concat(kept, "__new"))).drop("__new")


def rename_speakers(speakers: DataFrame, names: DataFrame) -> DataFrame:
    new = names.select("video_sha", "speaker_id", F.col("display_name").alias("__name"))
    return speakers.join(new, ["video_sha", "speaker_id"], "full_outer").withColumn("display_name", F.coalesce("__name", "display_name")).drop("__name")


def reset_timelines(chunks: DataFrame, tasks: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunks (task_id, timeline) of the media in gone (video_sha) lose their timelines."""
    hit = tasks.join(gone, "video_sha", "left_semi").select(F.col("id").alias("task_id"), F.lit(True).alias("hit"))
    return chunks.join(hit, "task_id", "left").withColumn("timeline", F.when(F.col("hit").isNull(), F.col("timeline"))).drop("hit")


def valid_artifacts(artifacts: DataFrame, pointers: DataFrame) -> DataFrame:
    """Artifacts (media, fingerprint, body) that the pointer of their media names; a pointer to nothing gives nothing."""
    return artifacts.join(pointers.select("media", "fingerprint"), ["media", "fingerprint"], "left_semi")


def resume_index(chunks: DataFrame) -> DataFrame:
    """Where each task goes on: after its last chunk."""
    return chunks.groupBy("task_id").agg((F.max("chunk_idx") + 1).alias("next_idx"))


def ready_media(originals: DataFrame, live_cues: DataFrame, least: int = 25) -> DataFrame:
    """Media with an original transcript, or with a live source of `least` cues."""
    return originals.select("video_sha").unionByName(live_cues.where(F.col("cues") >= least).select("video_sha")).distinct()


def cancel_dependents(tasks: DataFrame) -> DataFrame:
    """Queued and running tasks of media whose last transcription failed are cancelled."""
    last = tasks.where("kind = 'transcribe'").groupBy("video_sha").agg(F.max_by("status", F.struct("created_at", "id")).alias("source"))
    stop = (F.col("kind") != "transcribe") & F.col("status").isin(*ACTIVE) & F.coalesce(F.col("source") == "failed", F.lit(False))
    return tasks.join(last, "video_sha", "left").withColumn("status", F.when(stop, "canceled").otherwise(F.col("status"))).drop("source")


def batch_order(items: DataFrame, stages: list[str], strategy: str) -> DataFrame:
    """When each stage of each item runs: file by file, or all first stages before the others."""
    x = items.select("batch_id", "item", F.posexplode(F.array(*map(F.lit, stages))).alias("stage_no", "stage"))
    by = ("item", "stage_no") if strategy == "complete_each_file" else (F.least("stage_no", F.lit(1)), "item", "stage_no")
    return x.withColumn("turn", F.row_number().over(Window.partitionBy("batch_id").orderBy(*by))).drop("stage_no")


def error_class(message: Column) -> Column:
    m = F.lower(message)
    has = lambda *w: F.greatest(*(F.contains(m, F.lit(x)) for x in (*w, w[0])))
    return F.when(message.isNull(), "none").when(has("model", "config"), "config").when(has("timeout", "timed out"), "timeout").otherwise("other")
