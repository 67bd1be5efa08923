"""Map-reduce against a sequential fold, the chunk cursor across restarts, packing of one long medium."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from cueloom.operators import map_reduce, sequences, transcripts
from cueloom.plans.insight_queries import add_up, tally
from cueloom.streaming import streams

from .conftest import SMALL


def folded(windows):
    """One text's windows in turn, two partials at a time."""
    out = None
    for w in windows:
        said = json.loads(tally([w])[0])
        new = {"summary": said["summary"], "bullets": said["summaryBullets"]}
        if out is not None:
            reply = json.loads(add_up([json.dumps([out, new])])[0].strip("`").removeprefix("json"))
            new = {"summary": reply["summary"], "bullets": reply["summaryBullets"]}
        out = new
    return out


def test_tree_equals_a_sequential_fold(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    w = transcripts.context_windows(docs, "doc_id", "text", context=400, final_out=100, map_out=100, margin=50, prompt=50)
    texts: dict = {}
    for r in sorted(w.collect(), key=lambda r: r.idx):
        texts.setdefault(r.key, []).append(r.text)
    assert max(map(len, texts.values())) > 27  # four levels of three
    got = {r.key: r for r in map_reduce.map_reduce(w.select("key", "idx", "text"), tally, add_up, 3).collect()}
    assert got.keys() == texts.keys()
    for k, parts in texts.items():
        bad = sum("@" in p for p in parts)
        assert got[k].windows == len(parts) and got[k].failed == bad
        if bad:
            assert got[k].error == map_reduce.PARSE_FAILED and got[k].insight is None
        else:
            assert {"summary": got[k].insight.summary, "bullets": got[k].insight.bullets} == folded(parts)


def test_failing_models_leave_rows(spark):
    def shaky(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("no memory")
        return tally(texts)

    rows = [("a", 0, "x1"), ("a", 1, "boom"), ("a", 2, "@"), ("b", 0, None), ("c", 0, "y"), ("c", 1, "z2"), (None, 0, "n")]
    w = spark.createDataFrame(rows, "key string, idx int, text string").coalesce(1)
    got = {r.key: r for r in map_reduce.map_reduce(w, shaky, add_up, 2).collect()}
    assert (got["a"].failed, got["a"].insight, got["a"].error) == (2, None, "MODEL_FAILED: RuntimeError")
    assert got["b"].insight.summary == "0 0" and got["b"].error is None
    assert got["c"].insight.summary == "3 1" and got["c"].insight.bullets == [str(ord("y")), str(ord("2"))]
    assert got[None].insight.summary == "1 0"

    def never(texts):
        raise ValueError

    got = {r.key: r for r in map_reduce.map_reduce(w, shaky, never, 2).collect()}
    assert got["c"].error == "MODEL_FAILED: ValueError" and got["c"].insight is None and got["b"].error is None
    assert map_reduce.map_reduce(w.limit(0), tally, add_up).count() == 0
    with pytest.raises(ValueError):
        map_reduce.map_reduce(w, tally, add_up, 1)


def test_cursor_across_restarts(spark, tmp_path):
    """Late and repeated chunks, a restart between batches, and state of one row a task where nothing is missing."""
    schema = "task_id long, chunk_idx long, cues string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))

    def put(*rows):
        spark.createDataFrame([(t, i, f"{t}-{i}") for t, i in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def poll():
        live = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = streams.cursor(live).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.task_id, r.chunk_idx) for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect())

    put((1, 0), (1, 1), (1, 1), (1, 3), (2, 0))
    assert poll() == [(1, 0), (1, 1), (1, 3), (2, 0)]
    put((1, 1), (1, 3), (2, 0), (1, 4))  # a replay, and one new chunk
    assert poll() == [(1, 0), (1, 1), (1, 3), (1, 4), (2, 0)]
    put((1, 2), (2, 1), (2, None), (3, 5))  # the late one
    want = [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 0), (2, 1), (3, 5)]
    assert poll() == want
    put(*want)
    assert poll() == want
    held = spark.read.format("statestore").option("stateVarName", "beyond").load(str(tmp_path / "at")).collect()
    assert [(r.key.task_id, r.user_map_key.idx) for r in held] == [(3, 5)]  # of five chunks of task 1 nothing is kept


def test_cursor_by_buckets(spark, tmp_path):
    """Tasks that share rows of state, with late, repeated and replayed chunks, restarts, and chunks without a task."""
    schema = "task_id long, chunk_idx int, cues string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))
    rng = random.Random(3)
    tasks = [None, 0, 2**60, 2**60 + 1, *range(1, 60)]
    chunks = [(t, i, f"{t}-{i}") for t in tasks for i in range(rng.randint(1, 9))]
    rng.shuffle(chunks)
    third = len(chunks) // 3
    for part in (chunks[: 2 * third], chunks[third:], [*chunks, *chunks, (5, None, ""), (5, 1, "5-1")]):
        spark.createDataFrame(part, schema).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        live = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = streams.cursor(live, after=1, buckets=4).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination()
        seen = chunks[: 2 * third] if len(part) == 2 * third and part[0] == chunks[0] else chunks
        got = [tuple(r) for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()]
        assert sorted(got, key=repr) == sorted((c for c in seen if c[1] > 1), key=repr)
    held = [r.value.groupState for r in spark.read.format("statestore").load(str(tmp_path / "at")).collect()]
    ends: dict = {t: max(i for u, i, _ in chunks if u == t) for t in tasks}
    assert len(held) <= 4 and sum(len(h.late) for h in held) == 0  # a row a bucket: once all came, a number a task
    assert {t: m for h in held for t, m in zip(h.known, h.at, strict=True)} == {t: m for t, m in ends.items() if m > 1}


@pytest.mark.parametrize("buckets", [None, 1, 64])
def test_cursor_forgets_idle_tasks(spark, tmp_path, buckets):
    schema = "task_id long, chunk_idx long"
    for name, idle, want in (("short", 1, [(1, 0), (1, 0), (2, 0)]), ("long", 3_600_000, [(1, 0), (2, 0)])):
        path = tmp_path / name
        spark.createDataFrame([], schema).write.parquet(str(path / "in"))
        live = spark.readStream.schema(schema).parquet(str(path / "in"))
        q = streams.cursor(live, idle_ms=idle, buckets=buckets).writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "at")).trigger(processingTime="1 second").start()
        try:
            for n, row in enumerate(((1, 0), (2, 0), (1, 0)), 1):
                spark.createDataFrame([row], schema).write.mode("append").parquet(str(path / "in"))
                end = time.time() + 60  # batches for timers never cease, so processAllAvailable wouldn't return
                while q.isActive and time.time() < end and sum(p.numInputRows for p in q.recentProgress) < n:
                    time.sleep(0.2)
        finally:
            q.stop()
        assert sorted(map(tuple, spark.read.schema(schema).parquet(str(path / "out")).collect())) == want


def packed(durations, cap):
    chunk = used = 0
    out = []
    for d in durations:
        if used and used + d > cap:
            chunk, used = chunk + 1, 0
        out.append((chunk, used))
        used += d
    return out


def test_packing_of_one_long_medium(spark):
    """A medium of 300,000 pieces, over many batches, beside short ones and one without a name."""
    rng = random.Random(5)
    durations = [rng.randint(1, 700) for _ in range(2000)]
    n = 300_000
    listed = F.array(*map(F.lit, durations))
    long = spark.range(n).select(F.lit("long").alias("media"), (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + F.get(listed, (F.col("id") % 2000).cast("int"))).alias("end_ms"))
    short = spark.createDataFrame([("a", 5, 505), ("a", 600, 601), ("b", 0, 1200), (None, 0, 499), (None, 500, 502), ("c", 3, 3)], "media string, start_ms long, end_ms long")
    rows = sequences.pack(long.unionByName(short), 500).collect()
    pieces = [min(500, d - at) for i in range(n) for d in (durations[i % 2000],) for at in range(0, d, 500)]
    got = sorted((r for r in rows if r.media == "long"), key=lambda r: r.abs_start_ms)
    assert [r.dur_ms for r in got] == pieces
    assert [(r.chunk, r.req_start_ms) for r in got] == packed(pieces, 500)
    rest = sorted(((r.media or "", r.abs_start_ms, r.chunk, r.req_start_ms, r.dur_ms) for r in rows if r.media != "long"))
    assert rest == [("", 0, 0, 0, 499), ("", 500, 1, 0, 2), ("a", 5, 0, 0, 500), ("a", 600, 1, 0, 1), ("b", 0, 0, 0, 500), ("b", 500, 1, 0, 500), ("b", 1000, 2, 0, 200)]
