"""Task queues, batches and libraries: snapshots, next tasks, rollups and state transitions.

State changes are new DataFrames: Parquet has no UPDATE, so each transition returns the whole table
as it is afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions.text import percent

ACTIVE = ("queued", "running")


def rank(status: Column) -> Column:
    return F.when(status == "running", 0).when(status == "queued", 1).otherwise(2)


def display_name(display: Column, original: Column, sha: Column) -> Column:
    return F.coalesce(display, original, F.substring(sha, 1, 12))


def snapshot(tasks: DataFrame, videos: DataFrame, kinds: tuple, as_of_ms: int, recent_ms: int) -> DataFrame:
    """Active or recent tasks of all kinds with their media's names, in one shape; kind_ord keeps the order of kinds."""
    names = videos.select(F.col("sha256").alias("video_sha"), display_name(F.col("display_name"), F.col("original_name"), F.col("sha256")).alias("name"))
    shown = tasks.where(F.col("status").isin(*ACTIVE) | (F.col("created_at") > as_of_ms - recent_ms))
    parts = []
    for i, kind in enumerate(kinds):
        part = shown.where(F.col("kind") == kind).select("id", "kind", F.lit(i).alias("kind_ord"), "video_sha", "status", "created_at", "done_chunks", "total_chunks", "progress_pct")
        done = percent(F.col("done_chunks"), F.col("total_chunks")) if kind == "transcribe" else F.col("progress_pct")
        parts.append(part.withColumn("pct", done).drop("done_chunks", "total_chunks", "progress_pct"))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    out = both.join(names, "video_sha", "left")
    return out.select("id", "kind", "kind_ord", "status", rank(F.col("status")).alias("rank"), "created_at", "pct", F.coalesce("name", F.substring("video_sha", 1, 12)).alias("name"))


def ordered(items: DataFrame) -> DataFrame:
    return items.orderBy("rank", F.desc("created_at"), "kind_ord", "id")


def next_tasks(tasks: DataFrame, ready: DataFrame, n: int, exclude_insight: bool = False) -> DataFrame:
    """The first n tasks to run: queued, their media ready, by priority and then age; insights and polishing have no priority."""
    parts = [tasks.where((F.col("kind") == k) & (F.col("status") == "queued")).select("id", "kind", "video_sha", "created_at", (F.col("priority") if k == "translate" else F.lit(0)).alias("sort_priority")) for k in ("translate", "insight", "polish") if not (exclude_insight and k == "insight")]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.join(ready, "video_sha", "left_semi").orderBy(F.desc("sort_priority"), "created_at", "id").limit(n)


def latest(rows: DataFrame, key: str, at: str = "created_at", tie: str = "id") -> DataFrame:
    """The latest row of each key, by one aggregation instead of a sort."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(at, tie, *(c for c in rest if c not in (at, tie)))).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def batch_rollup(items: DataFrame, canceled_jobs: DataFrame | None = None) -> DataFrame:
    """Counts of each batch's items and its status. Cancelled jobs stay so; some cancelled and the rest completed counts as running."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    per = items.groupBy("batch_id").agg(F.count("*").alias("total"), n("completed").alias("done"), n("failed").alias("failed"), n("canceled").alias("canceled"), n(*ACTIVE).alias("active"))
    status = F.when(F.col("canceled") == F.col("total"), "canceled").when((F.col("active") == 0) & (F.col("failed") > 0), "failed").when((F.col("active") == 0) & (F.col("done") == F.col("total")), "completed").otherwise("running")
    per = per.withColumn("status", status)
    if canceled_jobs is not None:
        per = per.join(canceled_jobs.select("batch_id", F.lit(True).alias("stopped")), "batch_id", "left").withColumn("status", F.when(F.col("stopped"), "canceled").otherwise(F.col("status"))).drop("stopped")
    return per


def upsert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """target with rows put in by key: a value that rows leave null keeps what was there."""
    new = rows.select(*keys, *(F.col(c).alias(f"n_{c}") for c in rows.columns if c not in keys), F.lit(True).alias("is_new"))
    both = target.withColumn("is_old", F.lit(True)).join(new, keys, "full_outer")
    return both.select(*keys, *(F.coalesce(F.col(f"n_{c}"), F.col(c)).alias(c) if c in rows.columns else F.col(c) for c in target.columns if c not in keys))


def insert_or_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(rows.dropDuplicates(keys).join(target, keys, "left_anti"), allowMissingColumns=True)


def recover(tasks: DataFrame, mode: str) -> DataFrame:
    """Tasks after a restart: running ones are queued again (web), or they and queued ones failed (desktop)."""
    s = F.col("status")
    to = F.when(s == "running", "queued") if mode == "web" else F.when(s.isin(*ACTIVE), "failed")
    return tasks.withColumn("status", F.coalesce(to, s))


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table (with the name of its media column) without the rows of the media in gone (video_sha)."""
    return {name: t.join(gone.select(F.col("video_sha").alias(key)).distinct(), key, "left_anti") for name, (t, key) in tables.items()}


def file_status(tasks: DataFrame, library: DataFrame) -> DataFrame:
    """library (video_sha, n_langs, has_insights) with the state of transcripts, translations and insights."""
    has = lambda kind, *s: F.coalesce(F.bool_or((F.col("kind") == kind) & F.col("status").isin(*s)), F.lit(False))
    per = tasks.groupBy("video_sha").agg(
        has("transcribe", "running").alias("t_run"), has("transcribe", "queued").alias("t_wait"), has("transcribe", "failed").alias("t_fail"), has("insight", *ACTIVE).alias("i_run"), has("insight", "error", "failed").alias("i_fail"),
        has("translate", "running").alias("l_run"), has("translate", "queued").alias("l_wait"), has("translate", "failed").alias("l_fail"),
    )
    x = library.join(per, "video_sha", "left").na.fill(False)
    return x.select(
        "video_sha",
        F.when(F.col("t_run"), "running").when(F.col("t_wait"), "queued").when(F.col("n_langs") > 0, "done").when(F.col("t_fail"), "failed").otherwise("none").alias("transcribe"),
        F.when(F.col("l_run"), "running").when(F.col("l_wait"), "queued").when(F.col("l_fail"), "failed").otherwise("none").alias("translate"),
        F.greatest(F.lit(0), F.col("n_langs") - 1).alias("translated"),
        F.when(F.col("i_run"), "running").when(F.col("i_fail"), "failed").when(F.col("has_insights"), "done").otherwise("none").alias("insight"),
    )


def media_phase(videos: DataFrame, tasks: DataFrame) -> DataFrame:
    """Phase and next action of each media: videos (video_sha, has_file, has_transcript, has_insights)."""
    last = lambda kind: latest(tasks.where(F.col("kind") == kind).select("video_sha", "created_at", "id", "status"), "video_sha").select("video_sha", F.col("status").alias(kind))
    x = videos.join(last("transcribe"), "video_sha", "left").join(last("insight"), "video_sha", "left")
    t, i = F.col("transcribe"), F.col("insight")
    cases = [
        (~F.col("has_file"), "media_missing", "import_media"),
        (~F.col("has_transcript") & t.isin(*ACTIVE), "transcribe_pending", "wait_for_transcribe"),
        (~F.col("has_transcript") & (t == "failed"), "transcribe_failed", "retry_transcribe"),
        (~F.col("has_transcript"), "transcribe_needed", "start_transcribe"),
        (~F.col("has_insights") & i.isin(*ACTIVE), "insights_pending", "wait_for_insights"),
        (~F.col("has_insights") & (i == "error"), "insights_failed", "retry_insights"),
        (~F.col("has_insights"), "insights_needed", "start_insights"),
    ]
    phase = action = F
    for test, p, a in cases:
        phase, action = phase.when(test, p), action.when(test, a)
    return x.select("video_sha", phase.otherwise("bundle_ready").alias("phase"), action.otherwise("export_bundle").alias("next_action"))


def missing_steps(media: DataFrame, steps: list[str]) -> DataFrame:
    """media (video_sha, done array<string>) with the steps that aren't done; media with none are left out."""
    out = media.select("video_sha", F.array_except(F.array(*map(F.lit, steps)), "done").alias("missing"))
    return out.where(F.size("missing") > 0)


def new_imports(wanted: DataFrame, in_flight: DataFrame, stored: DataFrame) -> DataFrame:
    """URLs (url) to fetch: each once, and none that is in flight or stored."""
    return wanted.where("url is not null").dropDuplicates(["url"]).join(in_flight, "url", "left_anti").join(stored, "url", "left_anti")


def progress(events: DataFrame) -> DataFrame:
    """events (task, at, pct): what was shown at each, never less than before and 99 at most."""
    w = Window.partitionBy("task").orderBy("at", "pct").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("shown", F.least(F.lit(99), F.max("pct").over(w)))


def newest(rows: DataFrame, at: str, tie: str, n: int) -> DataFrame:
    """The n rows that come first by `at`, latest first, with their place from 1: a bounded top-n, not a sort of all."""
    w = Window.orderBy(F.desc(at), tie)
    return rows.orderBy(F.desc(at), tie).limit(n).withColumn("place", F.row_number().over(w).cast("long"))
