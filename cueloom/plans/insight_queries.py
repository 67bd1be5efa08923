"""Queries of summaries by map-reduce and of the chunk cursor as a stream."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cueloom import storage
from cueloom.operators import map_reduce, transcripts
from cueloom.plans.queries import query
from cueloom.sources import adapters
from cueloom.sources.adapters import table
from cueloom.streaming import streams


def tally(windows: list[str]) -> list[str]:
    """A stand-in for a model: length, digits, first and last character of each window; one with an @ gets a reply that isn't JSON."""
    out = []
    for t in windows:
        said = {"summary": f"{len(t)} {sum(c in '0123456789' for c in t)}", "summaryBullets": [f"{ord(t[0]) if t else 0}", f"{ord(t[-1]) if t else 0}"]}
        out.append("No." if "@" in t else json.dumps(said))
    return out


def add_up(groups: list[str]) -> list[str]:
    """The same for partials that follow one another: counts add up, the outer characters stay."""
    out = []
    for g in map(json.loads, groups):
        n = [sum(c) for c in zip(*(map(int, p["summary"].split()) for p in g), strict=True)]
        out.append("```json\n" + json.dumps({"summary": f"{n[0]} {n[1]}", "summaryBullets": [g[0]["bullets"][0], g[-1]["bullets"][-1]]}) + "\n```")
    return out


@query(r"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN instr(t, '@') > 0 THEN 'PARTIAL_INSIGHT_PARSE_FAILED' END AS error,
        CASE WHEN instr(t, '@') = 0 THEN length(t) || ' ' || length(regexp_replace(t, '[^0-9]', '', 'g')) END AS summary,
        CASE WHEN instr(t, '@') > 0 THEN NULL WHEN t = '' THEN '0,0' ELSE unicode(t[1]) || ',' || unicode(t[-1]) END AS ends
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def insight_map_reduce(spark, d):
    """Every text cut into context windows, each put to the stand-in model, and the partials reduced in order."""
    w = transcripts.context_windows(table(spark, d, "documents"), "doc_id", "text", context=1600, final_out=800, map_out=400, margin=100, prompt=100)
    r = map_reduce.map_reduce(w.select("key", "idx", "text"), tally, add_up, fan_in=4)
    return r.select(F.col("key").alias("doc_id"), "error", "insight.summary", F.array_join("insight.bullets", ",").alias("ends"))


@query("""SELECT task_id, chunk_idx, max(n_cues) AS n_cues FROM {chunks} WHERE chunk_idx > 2 GROUP BY 1, 2""")
def cursor_stream(spark, d):
    """All chunks (rows of one number are one chunk) put down twice and read as a stream: each one past the cursor comes out once."""
    folder = storage.shared_dir(spark)
    rows = adapters.chunks(spark, d).groupBy("task_id", "chunk_idx").agg(F.max("n_cues").alias("n_cues"))
    rows.write.parquet(folder + "/in")
    spark.read.schema(rows.schema).parquet(folder + "/in").write.mode("append").parquet(folder + "/in")
    live = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(folder + "/in")
    started = streams.cursor(live, after=2, buckets=4096).writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/at").outputMode("append").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(rows.schema).parquet(folder + "/out")
