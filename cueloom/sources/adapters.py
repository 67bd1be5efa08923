"""Domain relations over the driver's tables: deterministic projections, and the same in DuckDB SQL.

Each function takes (spark, sf_dir). `SQL` holds, by the same names, the text of a DuckDB subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(col: str) -> Column:
    """Epoch milliseconds of a timestamp without time zone, taken as UTC."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(col))


def sha_of(col: str) -> Column:
    return F.sha2(F.col(col).cast("string").cast("binary"), 256)


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(
        sha_of("c_custkey").alias("sha256"),
        F.when(k % 5 != 0, F.col("c_name")).alias("display_name"),
        F.when(k % 7 != 0, F.concat("c_name", F.lit(".mp4"))).alias("original_name"),
        F.floor(F.abs("c_acctbal") * 1000).cast("long").alias("size_bytes"),
        (k * 1000 + k % 13).alias("last_opened_at"),
        F.when(k % 11 == 0, k).when(k % 11 == 1, F.lit(0)).cast("long").alias("deleted_at"),
        (k % 3 == 0).cast("int").alias("has_transcript"),
        F.when(k % 4 == 0, F.concat(F.lit("https://media.example.com/v/"), (k % 50).cast("string"))).alias("source_url"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five kinds of task; an order is one task."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (k % 5 + 1).cast("int"))
    state = F.element_at(F.array(*map(F.lit, STATES)), (F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 0).otherwise(1) + k % 2 + 1).cast("int"))
    return o.select(
        k.alias("id"), kind.alias("kind"), sha_of("o_custkey").alias("video_sha"), state.alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        millis("o_orderdate").alias("created_at"), F.when(k % 10 != 0, k % 40).cast("long").alias("total_chunks"), F.least(k % 23, k % 40).cast("long").alias("done_chunks"),
        F.when(k % 3 != 0, F.concat(F.lit("model-"), (k % 4).cast("string"))).alias("model"), (k % 101).cast("int").alias("progress_pct"),
    )


#: The kinds of task, and statuses (of all kinds but insights, which say done and error).
KINDS = ("transcribe", "translate", "insight", "polish", "diarize")
STATES = ("queued", "running", "running", "completed", "failed")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    before = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rowsBetween(Window.unboundedPreceding, -1)
    ms = (F.col("l_quantity") * 1000).cast("long")
    return li.select(
        F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("chunk_idx"), F.coalesce(F.sum(ms).over(before), F.lit(0)).cast("long").alias("start_ms"), ms.alias("dur_ms"),
        F.when(F.col("l_returnflag") == "R", "suspect").otherwise("ok").alias("quality"), (F.col("l_partkey") % 30).cast("long").alias("n_cues"),
    ).withColumn("end_ms", F.col("start_ms") + F.col("dur_ms")).drop("dur_ms")


def batch_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of batches: a batch is an order, and its job's status is open or canceled."""
    li = table(spark, sf_dir, "lineitem")
    state = F.when(F.col("l_linestatus") == "F", F.when(F.col("l_returnflag") == "R", "failed").otherwise("completed")).when(F.col("l_orderkey") % 7 == 0, "canceled").when(F.col("l_linenumber") % 2 == 0, "queued").otherwise("completed")
    return li.select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("item"), sha_of("l_partkey").alias("video_sha"), state.alias("status"))


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media"), F.col("turn").alias("cue_idx"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("speaker"))
    before = Window.partitionBy("media").orderBy("cue_idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)) * 50 + F.col("cue_idx") * F.col("cue_idx") * 400
    return c.select("media", "cue_idx", start.cast("long").alias("start_ms"), (start + F.length("text") * 50).cast("long").alias("end_ms"), "text", "speaker")


def speaker_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues' speakers, later by 30 % of each cue: so a cue meets its own and the one before."""
    c = cues(spark, sf_dir)
    late = F.floor((F.col("end_ms") - F.col("start_ms")) * 3 / 10).cast("long")
    return c.select("media", F.col("cue_idx").alias("pos"), (F.col("start_ms") + late).alias("start_ms"), (F.col("end_ms") + late).alias("end_ms"), "speaker")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("media"), (F.row_number().over(w) - 1).cast("long").alias("frame_idx"), F.least(F.lit(1.0), F.col("value") / 100).alias("p"))


def raw_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = millis("ts")
    kind = F.element_at(F.map_from_arrays(F.array(*map(F.lit, ("click", "view", "purchase", "signup"))), F.array(*map(F.lit, range(4)))), F.col("event_type"))
    return e.select(F.col("user_id").alias("media"), F.col("event_id").alias("seg"), start.alias("start_ms"), (start + F.round(F.col("value") * 1000)).cast("long").alias("end_ms"), F.coalesce(kind, F.lit(4)).cast("int").alias("raw_speaker"))


SQL = {
    "videos": """(SELECT sha256(CAST(c_custkey AS VARCHAR)) AS sha256, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS display_name,
        CASE WHEN c_custkey % 7 <> 0 THEN c_name || '.mp4' END AS original_name, CAST(floor(abs(c_acctbal) * 1000) AS BIGINT) AS size_bytes,
        c_custkey * 1000 + c_custkey % 13 AS last_opened_at, CASE c_custkey % 11 WHEN 0 THEN c_custkey WHEN 1 THEN 0 END AS deleted_at,
        CAST(c_custkey % 3 = 0 AS INTEGER) AS has_transcript,
        CASE WHEN c_custkey % 4 = 0 THEN 'https://media.example.com/v/' || CAST(c_custkey % 50 AS VARCHAR) END AS source_url FROM customer)""",
    "tasks": """(SELECT o_orderkey AS id, ['transcribe', 'translate', 'insight', 'polish', 'diarize'][o_orderkey % 5 + 1] AS kind,
        sha256(CAST(o_custkey AS VARCHAR)) AS video_sha,
        ['queued', 'running', 'running', 'completed', 'failed'][CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 0 ELSE 1 END + o_orderkey % 2 + 1] AS status,
        CAST(o_orderpriority[1] AS INTEGER) AS priority, epoch_ms(o_orderdate) AS created_at,
        CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey % 40 END AS total_chunks, least(o_orderkey % 23, o_orderkey % 40) AS done_chunks,
        CASE WHEN o_orderkey % 3 <> 0 THEN 'model-' || CAST(o_orderkey % 4 AS VARCHAR) END AS model, CAST(o_orderkey % 101 AS INTEGER) AS progress_pct FROM orders)""",
    "chunks": """(SELECT l_orderkey AS task_id, l_linenumber AS chunk_idx,
        CAST(coalesce(sum(CAST(l_quantity * 1000 AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms,
        CAST(coalesce(sum(CAST(l_quantity * 1000 AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + CAST(l_quantity * 1000 AS BIGINT) AS end_ms,
        CASE WHEN l_returnflag = 'R' THEN 'suspect' ELSE 'ok' END AS quality, l_partkey % 30 AS n_cues FROM lineitem)""",
    "batch_items": """(SELECT l_orderkey AS batch_id, l_linenumber AS item, sha256(CAST(l_partkey AS VARCHAR)) AS video_sha,
        CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'completed' END WHEN l_orderkey % 7 = 0 THEN 'canceled'
             WHEN l_linenumber % 2 = 0 THEN 'queued' ELSE 'completed' END AS status FROM lineitem)""",
    "cues": """(SELECT media, cue_idx, s AS start_ms, s + 50 * length(text) AS end_ms, text, speaker FROM
        (SELECT conv_id AS media, turn AS cue_idx, coalesce(text, '') AS text, role AS speaker,
         CAST(coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) * 50 + turn * turn * 400 AS s
         FROM conversations))""",
    "frames": """(SELECT user_id AS media, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, least(1.0, value / 100) AS p FROM events)""",
    "raw_segments": """(SELECT user_id AS media, event_id AS seg, (epoch_us(ts) // 1000) AS start_ms, (epoch_us(ts) // 1000) + CAST(round(value * 1000) AS BIGINT) AS end_ms,
        CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS INTEGER) AS raw_speaker FROM events)""",
}
SQL["speaker_timeline"] = f"""(SELECT media, cue_idx AS pos, start_ms + CAST(floor((end_ms - start_ms) * 3 / 10) AS BIGINT) AS start_ms,
        end_ms + CAST(floor((end_ms - start_ms) * 3 / 10) AS BIGINT) AS end_ms, speaker FROM {SQL["cues"]})"""
