"""Boundary cases of the sequence, interval and text operators."""

from itertools import permutations

from pyspark.sql import functions as F

from cueloom.functions import parsing as P
from cueloom.functions import text as T
from cueloom.operators import intervals, sequences, speakers
from cueloom.plans import queue
from cueloom.sources import subtitles


def frames(spark, *p):
    return spark.createDataFrame([("m", i, x) for i, x in enumerate(p)], "media string, frame_idx long, p double")


def spans(df, a="start_ms", b="end_ms"):
    return sorted((r[a], r[b]) for r in df.collect())


def test_hysteresis(spark):
    assert spans(sequences.hysteresis(frames(spark, 0.1, 0.1, 0.8, 0.7, 0.1, 0.1))) == [(60, 120)]
    assert spans(sequences.hysteresis(frames(spark, 0.1, 0.8, 0.6, 0.4, 0.7, 0.1))) == [(30, 150)]
    assert spans(sequences.hysteresis(frames(spark, 0.1, 0.1, 0.8, 0.8))) == [(60, 120)]
    assert spans(sequences.hysteresis(frames(spark, 0.1, 0.2, 0.3, 0.4))) == []
    try:
        sequences.hysteresis(frames(spark, 0.1), 0.3, 0.5)
        raise AssertionError("no error")
    except ValueError:
        pass


def segments(spark, *s):
    return spark.createDataFrame([("m", a, b) for a, b in s], "media string, start_ms long, end_ms long")


def test_merge_gaps(spark):
    assert spans(sequences.merge_gaps(segments(spark, (0, 500), (700, 1000)), 300, 250)) == [(0, 1000)]
    assert spans(sequences.merge_gaps(segments(spark, (0, 500), (800, 1000)), 300, 250)) == [(0, 500)]
    assert spans(sequences.merge_gaps(segments(spark, (0, 100), (200, 300)), 300, 250)) == [(0, 300)]


def test_pack_and_remap(spark):
    s = segments(spark, (10_000, 15_000), (40_000, 45_000))
    pieces = sequences.pack(s, 30_000)
    assert sorted((r.req_start_ms, r.abs_start_ms, r.dur_ms) for r in pieces.collect()) == [(0, 10_000, 5000), (5000, 40_000, 5000)]
    cases = {0: (6000, 8000), 1: (1000, 6000), 2: (4900, 9500), 3: (10_500, 11_000), 4: (-500, 200), 5: (100, 100)}
    cues = spark.createDataFrame([("m", 0, i, a, b) for i, (a, b) in cases.items()], "media string, chunk int, cue_idx int, start_ms long, end_ms long")
    got = {r.cue_idx: (r.start_ms, r.end_ms) for r in sequences.remap(cues, pieces).collect()}
    assert got == {0: (41_000, 43_000), 1: (11_000, 17_000), 2: (14_900, 17_000)}


def cues(spark, *c):
    return spark.createDataFrame([("m", i, a, b, t, None) for i, (a, b, t) in enumerate(c)], "media string, cue_idx long, start_ms long, end_ms long, text string, speaker string")


def reason(spark, c, ms):
    return sequences.hallucination(c, F.lit(ms)).first()["reason"]


def test_hallucination(spark):
    assert reason(spark, cues(spark, (0, 1, "a"), (1, 2, " a "), (2, 3, "a")), 5000) == "repeat"
    assert reason(spark, cues(spark, (0, 1, "a"), (1, 2, "a")), 5000) is None
    assert reason(spark, cues(spark, (5, 6, "a"), (1, 2, "b")), 5000) == "reverse-ts"
    assert reason(spark, cues(spark, *((i, i + 1, str(i)) for i in range(50))), 30_000) == "density"
    assert reason(spark, cues(spark, *((i, i + 1, str(i)) for i in range(100))), 5000) is None


def timeline(spark, *t):
    return spark.createDataFrame([("m", i, a, b, s) for i, (a, b, s) in enumerate(t)], "media string, pos long, start_ms long, end_ms long, speaker string")


def test_cue_speaker(spark):
    cue = cues(spark, (0, 100, "x"))
    one = lambda *t: tuple(intervals.resolve_speakers(cue, timeline(spark, *t)).select("kind", "speaker", "coverage").first())
    assert one((0, 80, "A"), (80, 90, "B")) == ("single", "A", 0.8)
    assert one((0, 50, "A"), (50, 70, "B")) == ("single", "A", 0.5)
    assert one((0, 10, "A"), (50, 60, "B")) == ("none", None, None)
    assert one((0, 40, "A"), (60, 100, "A")) == ("single", "A", 0.8)
    assert one((0, 50, "B"), (50, 100, "A")) == ("split", "B", 0.5)
    assert one() == ("none", None, None)


def test_snap_chapters(spark):
    c = cues(spark, (0, 3000, "a"), (3500, 9000, "b"), (10_000, 12_000, "c"))
    ch = spark.createDataFrame([("m", 0, 100, "p"), ("m", 1, 3300, "q"), ("m", 2, 3400, "r"), ("m", 3, 9800, "s"), ("m", 4, 12_001, "t")], "media string, pos long, start_ms long, title string")
    assert sorted((r.start_ms, r.title) for r in intervals.snap_chapters(ch, c).collect()) == [(0, "p"), (3500, "q"), (10_000, "s")]


def test_overlap_join_meets_once_across_bins(spark):
    a = segments(spark, (0, 500_000))
    b = segments(spark, (1000, 400_000))
    assert spans(intervals.overlap_join(a, b), "clip_start", "clip_end") == [(1000, 400_000)]


def test_parse_subtitles(spark):
    vtt = "WEBVTT\r\n\r\n1\r\n00:00:01.000 --> 00:00:02.500\r\nhello\r\nworld\r\n\r\n00:03.000 --> 00:04.000\nno\n\n00:00:05.000 --> 00:00:06.000\n\n00:00:07.000 --> 00:00:08.000\n00:00:09.000 --> 00:00:10.000\n \n"
    got = subtitles.parse_vtt(spark.createDataFrame([("m", vtt)], "media string, content string")).orderBy("at")
    assert [(r.start_ms, r.end_ms, r.text) for r in got.collect()] == [(1000, 2500, "hello\nworld"), (7000, 8000, "00:00:09.000 --> 00:00:10.000")]
    srt = "1\n00:00:01,000 --> 00:00:02,000\n<i>Hi</i>\n\nDialogue: 0,0:00:01.50,0:00:04.00,Default,,0,0,0,,{\\b1}One\\NTwo\n"
    got = subtitles.parse_srt(spark.createDataFrame([("m", srt)], "media string, content string")).orderBy("at")
    assert [(r.start_ms, r.end_ms, r.text) for r in got.collect()] == [(1000, 2000, "Hi"), (1500, 4000, "One\nTwo")]


def test_text_functions(spark):
    one = lambda c, x=None: spark.createDataFrame([(x,)], "t string").select(c).first()[0]
    assert one(T.clock(F.lit(360_001_002), ",")) == "100:00:01,002"
    assert one(T.clock_ms(F.col("t")), "01:02:03.9") == 3_723_000 and one(T.clock_ms(F.col("t")), "x") is None
    assert one(T.token_estimate(F.col("t")), "") == 1 and one(T.token_estimate(F.col("t")), "日本語") == 3
    assert one(T.dominant_language(F.col("t")), "漢字 kana あ") == "ja" and one(T.dominant_language(F.col("t")), "123") is None
    assert one(T.sentence_case(F.col("t")), "HELLO THERE. GOOD DAY") == "Hello there. Good day"
    assert one(T.sentence_case(F.col("t")), "Hello there") == "Hello there"
    assert one(T.strip_think(F.col("t")), "a<think>x</think>b<think>c") == "ab"
    assert one(T.fnv1a(F.col("t")), "hello") == "4f9f2cab"
    assert one(P.size_bytes(F.col("t")), "1.5MiB") == 1_572_864 and one(P.size_bytes(F.col("t")), "NA") is None
    assert one(T.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0


def test_batch_rollup_keeps_cancelled_jobs(spark):
    items = spark.createDataFrame([(1, "completed"), (1, "canceled"), (2, "failed"), (3, "completed"), (4, "queued")], "batch_id long, status string")
    stopped = spark.createDataFrame([(4,)], "batch_id long")
    assert {r.batch_id: r.status for r in queue.batch_rollup(items, stopped).collect()} == {1: "running", 2: "failed", 3: "completed", 4: "canceled"}


def test_highlight(spark):
    from cueloom.plans import state

    got = state.highlight(spark.createDataFrame([("k", "The other THEME"), ("n", None), ("e", "")], "key string, text string"), "key", "text", "the").orderBy("key", "pos").collect()
    assert [(r.key, r.t, r.is_match) for r in got] == [("k", "The", True), ("k", " o", False), ("k", "the", True), ("k", "r ", False), ("k", "THE", True), ("k", "ME", False)]


def test_consolidation_of_a_share_at_the_limit(spark):
    """Just a fifth of a media's time: the same answer whatever the order of its speakers."""
    ms = (674_670, 506_460, 370_060, 585_160, 789_450)
    assert 5 * ms[3] == sum(ms)
    rows = [(m, s, 0, n) for m, order in enumerate(permutations(ms)) for s, n in enumerate(order)]
    segments = spark.createDataFrame(rows, "media long, raw_speaker int, start_ms long, end_ms long").coalesce(1)
    centroids = segments.select("media", "raw_speaker", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: (i == F.col("raw_speaker")).cast("double")).alias("centroid"))
    got = speakers.consolidate(segments, centroids, share=0.2).collect()
    assert len(got) == len(rows)
    share = 585.16 / (sum(ms) / 1000)
    assert {r.speaker_id for r in got if r.duration_s == 585.16} == {"speaker_C" if share >= 0.2 else "unknown"}
