"""Scans by blocks give what one scan gives, wherever borders fall, and no task takes a whole medium."""

import random

import pytest
from pyspark.sql import functions as F

from cueloom.operators import blocks, sequences


def spans_of(p, enter=0.5, leave=0.35):
    out, since, last = [], None, None
    for i, x in p:
        if since is None and x is not None and x >= enter:
            since = i
        elif since is not None and x is not None and x < leave:
            out.append((since * 30, (last + 1) * 30))
            since = None
        last = i
    return out + ([(since * 30, (last + 1) * 30)] if since is not None else [])


def merged(segments, gap, least):
    out = []
    for a, b in segments:
        if out and a - out[-1][1] < gap:
            out[-1][1] = b
        else:
            out.append([a, b])
    return sorted((a, b) for a, b in out if b - a >= least)


def grouped(speakers):
    out = []
    for i, s in enumerate(speakers):
        if out and out[-1][0] == s:
            out[-1][2] += 1
        else:
            out.append([s, i, 1])
    return [(n + 1, s, i, c) for n, (s, i, c) in enumerate(out)]


@pytest.mark.parametrize("width", [1, 7, 64, 100_000])
def test_blocks_equal_one_scan(spark, width):
    rng = random.Random(width)
    want_spans, want_merged, want_groups, want_gaps, rows, segments, cues = {}, {}, {}, {}, [], [], []
    for m in ("a", "b", None, "c"):
        p, x = [], 0.4
        for i in range(0, 300):
            x = rng.choice([x, x, x, rng.random(), None])
            if rng.random() < 0.95 and not (m == "b" and 40 < i < 120):  # gaps, and empty blocks
                p.append((i, x))
        rows += [(m, i, x) for i, x in p]
        want_spans[m] = spans_of(p)
        at, s = 0, []
        for _ in range(120):
            at += rng.choice([1, 2, 5, 40])
            s.append((at, at := at + rng.randint(1, 9)))
        segments += [(m, a, b) for a, b in s]
        want_merged[m] = merged(s, 5, 8)
        who = [rng.choice(["x", "y", None]) if rng.random() < 0.3 else "x" for _ in s]
        cues += [(m, i, a, b, w) for i, ((a, b), w) in enumerate(zip(s, who, strict=True))]
        want_groups[m] = grouped(who)
        want_gaps[m] = [(i, s[i - 1][1], s[i][0]) for i in range(1, len(s)) if s[i][0] - s[i - 1][1] >= 5]

    def by_medium(df, *columns):
        out = {m: [] for m in ("a", "b", None, "c")}
        for r in df.collect():
            out[r.media].append(tuple(r[c] for c in columns))
        return {m: sorted(x, key=str) for m, x in out.items()}

    same = lambda want: {m: sorted(x, key=str) for m, x in want.items()}
    frames = spark.createDataFrame(rows, "media string, frame_idx long, p double")
    assert by_medium(sequences.hysteresis(frames, block=width), "start_ms", "end_ms") == same(want_spans)
    got = sequences.merge_gaps(spark.createDataFrame(segments, "media string, start_ms long, end_ms long"), 5, 8, width)
    assert by_medium(got, "start_ms", "end_ms") == same(want_merged)
    c = spark.createDataFrame(cues, "media string, cue_idx long, start_ms long, end_ms long, speaker string")
    assert by_medium(sequences.speaker_groups(c, width), "grp", "speaker", "first_cue", "n_cues") == same(want_groups)
    assert by_medium(sequences.silent_gaps(c, 5, width), "cue_idx", "start_ms", "end_ms") == same(want_gaps)


def test_one_medium_with_all_rows_is_spread(spark):
    """Of 200,000 frames of one medium no task scans more than some blocks, and runs longer than a block are whole."""
    n = 200_000
    frames = spark.range(n).select(F.lit("m").alias("media"), F.col("id").alias("frame_idx"), F.when(F.col("id") % 5000 < 4990, 0.9).otherwise(0.1).alias("p"))
    got = sorted((r.start_ms, r.end_ms) for r in sequences.hysteresis(frames, block=1000).collect())
    assert got == [(i * 5000 * 30, (i * 5000 + 4990) * 30) for i in range(n // 5000)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        x = blocks.with_entries(frames, "media", "frame_idx", 1000, "p").withColumn("rn", F.row_number().over(blocks.in_block("media", "frame_idx")))
        sizes = [r["count"] for r in x.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(sizes) == n + 200 and max(sizes) < n * 0.6
