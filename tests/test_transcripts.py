"""Windows, split cues, the model ladder, replies, WAV files and streams."""

import itertools
import math
import random
import re
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cueloom.functions import parsing as P
from cueloom.operators import sequences
from cueloom.operators import transcripts as T
from cueloom.plans import library
from cueloom.sources import audio
from cueloom.streaming import streams


def tokens(t):
    return T.estimate(t)


@pytest.mark.parametrize("most", [1, 3, 7, 40])
def test_windows_cover_the_text(most):
    def greedy(text):
        """Unit after unit, a unit being a line or a part of one that fits."""
        units = []
        for line in re.findall(r"[^\n]*\n|[^\n]+", text):
            while tokens(line) > most and len(line) > 1:
                k = max([k for k in range(1, len(line) + 1) if tokens(line[:k]) <= most], default=1)
                units.append(line[:k])
                line = line[k:]
            units += [line] * bool(line)
        out = [""]
        for u in units:
            if out[-1] and tokens(out[-1] + u) > most:
                out.append("")
            out[-1] += u
        return out

    rng = random.Random(most)
    for _ in range(60):
        t = "".join(rng.choice("ab \n日,") for _ in range(rng.randint(0, 120)))
        w = T.windows(t, most)
        assert "".join(w) == t and all(tokens(x) <= most or len(x) == 1 for x in w)
        assert w == greedy(t)


def test_estimate():
    assert tokens("") == 1 and tokens("日本語") == 3 and tokens("abcdef") == 3 and tokens("a, b") == max(math.ceil(2 / 3 + 1 + 1 / 8), 2)


def naive_parts(text, start, end, clips):
    """The stated rules, with plain loops over (start, end, speaker) of one cue."""
    turns = []
    for a, b, who in clips:
        if turns and turns[-1][2] == who and a - turns[-1][1] <= 100:
            turns[-1] = (turns[-1][0], max(b, turns[-1][1]), who)
        else:
            turns.append((a, b, who))
    n = len(turns)
    if n < 2 or len(text) < n:
        return []
    cuts, begins, ends = [0], [start], []
    for (_, e, _), (s, _, _) in itertools.pairwise(turns):
        if s > e:
            s = e = math.floor((e + s) / 2 + 0.5)
        begins.append(s)
        ends.append(e)
        low, high = cuts[-1] + 1, len(text) - 1
        t = max(low, min(high, math.floor((e - start) / (end - start) * len(text) + 0.5)))
        marks = [p for p in range(low, high + 1) if abs(p - t) <= 8 and text[p - 1] in T.MARKS]
        cuts.append(min(marks, key=lambda p: (abs(p - t), p)) if marks else t)
    if cuts[-1] >= len(text):
        return []
    cuts.append(len(text))
    out = [(turns[i][2], begins[i], [*ends, end][i], text[cuts[i] : cuts[i + 1]].strip()) for i in range(n)]
    out = [p for p in out if p[3]]
    return out if len(out) > 1 else []


def test_split_cues_and_their_lines(spark):
    rng = random.Random(6)
    cues, timeline = [], []
    for m in range(60):
        at = 0
        for i in range(rng.randint(1, 4)):
            n = rng.choice([400, 1000, 3000])
            cues.append((m, i, at, at + n, "".join(rng.choice("ab .,。 日😀") for _ in range(rng.choice([1, 2, 5, 40])))))
            at += n + rng.choice([0, 50])
        t = pos = 0
        while t < at:
            n = rng.choice([80, 200, 500, 900])
            timeline.append((m, pos, t, t + n, rng.choice("XYZ")))
            t, pos = t + n + rng.choice([-60, 0, 0, 90, 150]), pos + 1
    c = spark.createDataFrame(cues, "media long, cue_idx long, start_ms long, end_ms long, text string")
    l = spark.createDataFrame(timeline, "media long, pos long, start_ms long, end_ms long, speaker string")
    names = spark.createDataFrame([(m, "X", "Xavier") for m in range(60)], "media long, speaker string, name string")
    want, lines = {}, {}
    for m, i, a, b, text in cues:
        clips = sorted((max(a, s), min(b, e), p, w) for mm, p, s, e, w in timeline if mm == m and min(b, e) > max(a, s))
        clips = [(s, e, w) for s, e, _, w in sorted(clips, key=lambda x: (x[0], x[2]))]
        want[m, i] = naive_parts(text, a, b, clips)
        share, first = Counter(), {}
        for s, e, w in clips:
            share[w] += e - s
        for mm, p, s, e, w in timeline:
            if mm == m and min(b, e) > max(a, s):
                first[w] = min(first.get(w, 1 << 30), p)
        lead = max(share, key=lambda w: (share[w], -first[w]), default=None)
        name = lambda w: "Xavier" if w == "X" else w
        split = lead and share[lead] / (b - a) < 0.7 and sum(v / (b - a) >= 0.25 for v in share.values()) >= 2 and want[m, i]
        lines[m, i] = text if sum(share.values()) / (b - a) < 0.3 else "\n".join(f"{name(w)}: {t}" for w, _, _, t in want[m, i]) if split else f"{name(lead)}: {text}"
    got: dict = {}
    for r in T.split_cues(c, l).orderBy("media", "cue_idx", "part").collect():
        got.setdefault((r.media, r.cue_idx), []).append((r.speaker, r.start_ms, r.end_ms, r.text))
    assert got == {k: v for k, v in want.items() if v} and len(got) > 20
    assert {(r.media, r.cue_idx): r.text for r in T.speaker_lines(c, l, names).collect()} == lines


def test_turns_that_begin_with_the_cue_keep_the_timelines_order(spark):
    cue = spark.createDataFrame([(1, 0, 100, 200, "abcdefghij")], "media long, cue_idx long, start_ms long, end_ms long, text string")
    line = spark.createDataFrame([(1, 0, 0, 160, "A"), (1, 1, 90, 140, "B")], "media long, pos long, start_ms long, end_ms long, speaker string")
    assert [(r.speaker, r.text) for r in T.split_cues(cue, line).orderBy("part").collect()] == [("A", "abcdef"), ("B", "ghij")]


def test_repeats_and_snippets_ignore_white_space_of_any_kind(spark):
    cues = spark.createDataFrame([(m, i, 1000 * i, 1000 * i + 900, t) for m, texts in enumerate((("a", "a\t", "\na"), ("a", "b\t", "\na"))) for i, t in enumerate(texts)], "media long, cue_idx long, start_ms long, end_ms long, text string")
    assert {r.media: r.reason for r in sequences.hallucination(cues, F.lit(60_000)).collect()} == {0: "repeat", 1: None}
    assert {r.snippet for r in T.sources(cues).collect()} == {"a", "b"}


def test_log_lines_and_redaction(spark):
    one = lambda c, x: spark.createDataFrame([(x,)], "t string").select(c(F.col("t")).alias("x")).first()["x"]
    assert [one(P.log_line, f'{{"level":"{l}","event":"e"}}').level for l in ("info", "warn", "error", "debug", "fatal", "INFO")] == ["info", "warn", "error", "debug", "unknown", "unknown"]
    assert tuple(one(P.log_line, "plain")) == (None, "unknown", "plain") and one(P.log_line, '{"event":"e"}').level == "unknown"
    for line in ('["/Users/me/secret.mp4", 1, {"a": null}]', '"/Users/me/secret.mp4"', '{"msg":"/Users/me/secret.mp4"}', "at /Users/me/secret.mp4"):
        assert "secret" not in one(P.redact, line) and "path:" in one(P.redact, line)
        assert one(lambda c: P.redact(c, debug=True), line) == line
    assert [P.redacted(x) for x in ("5", "null", '""', "[]")] == ["5", "null", '""', "[]"]
    assert one(P.redact, None) is None


def test_partial_insight_of_an_array_is_an_empty_one(spark):
    one = lambda x: spark.createDataFrame([(x,)], "t string").select(library.partial_insight(F.col("t")).alias("x")).first()["x"]
    assert tuple(one('["a"]')) == ("", [], []) and tuple(one("```json\n[]\n```")) == ("", [], [])
    assert [one(x) for x in ('"a"', "1", "null", "no", "", None)] == [None] * 6


def test_ladder():
    calls = []

    def model(texts):
        calls.append(len(texts))
        return None if "bad" in texts else [t.upper() for t in texts]

    texts = [f"t{i}" for i in range(30)]
    texts[3] = "bad"
    out, kept = T.ladder(texts, model)
    assert out == [t if t == "bad" else t.upper() for t in texts] and kept == 1
    assert calls == [25, 15, *[1] * 15, 10, 5]


def test_replies(spark):
    one = lambda c, x: spark.createDataFrame([(x,)], "t string").select(c(F.col("t")).alias("x")).first()["x"]
    assert one(P.string_array, '```json\n["a", "b"]\n```') == ["a", "b"] and one(P.string_array, "[]") == []
    assert [one(P.string_array, x) for x in ('["a", 1]', "[1]", "no", '["a"', None)] == [None] * 5
    assert one(P.insights, "") is None and one(P.insights, "just prose").summary == "just prose"
    got = one(P.insights, "## Chapters\n- 1:02:03 - 1:04:00: Start\n* [05:06] End - the end\n")
    assert [tuple(c) for c in got.chapters] == [(3_723_000, "Start", ""), (306_000, "End", "the end")]
    assert one(P.eta_seconds, "01:02:03") == 3723 and one(P.eta_seconds, "7") == 7 and one(P.eta_seconds, "NA") is None
    assert one(P.size_bytes, "7.46MiB") == round(7.46 * 1024**2) and one(P.size_bytes, "x") is None
    assert P.redacted('{"path":"/x","ts":1,"msg":"see /tmp/a b"}').startswith('{"path":"hash:') and "/tmp/a" not in P.redacted("see /tmp/a b")


def wav(n, rate=16_000):
    return audio.wav(struct.pack(f"<{n}h", *range(n)), {"format": 1, "channels": 1, "rate": rate, "align": 2, "bits": 16})


def test_wav(spark):
    files = spark.createDataFrame([("a", bytearray(wav(1600))), ("b", bytearray(b"no wav"))], "path string, content binary")
    rows = {r.path: r for r in files.select("path", audio.wav_header("content").alias("h"), audio.slice_wav("content", F.lit(0.01), F.lit(0.02)).alias("s"), audio.concat_wav("content", F.array(F.array(F.lit(0.0), F.lit(0.01)), F.array(F.lit(0.05), F.lit(0.05)), F.array(F.lit(0.02), F.lit(0.03)))).alias("c")).collect()}
    assert rows["a"].h.rate == 16_000 and rows["a"].h.size == 3200 and rows["b"].h.rate is None and rows["b"].s is None and rows["b"].c is None
    assert struct.unpack_from("<h", rows["a"].s, 44)[0] == 160 and len(rows["a"].s) == 44 + 320
    assert struct.unpack_from("<h", rows["a"].c, 44 + 320)[0] == 320 and len(rows["a"].c) == 44 + 640
    x = audio.samples(files).agg(F.count("*").alias("n"), F.max("x").alias("top")).first()
    assert x.n == 1600 and x.top == 1599 / 32768


def test_think_filter_does_not_depend_on_chunks():
    rng = random.Random(4)
    text = "a <b> <think>x</think>y<think>z</think> end <thi"
    for _ in range(50):
        held, inside, out, at = "", False, "", 0
        while at < len(text):
            n = rng.randint(1, 6)
            shown, held, inside = streams.visible(held, inside, text[at : at + n])
            out, at = out + shown, at + n
        assert out + ("" if inside else held) == "a <b> y end <thi"


def test_full_batches_stream(spark, tmp_path):
    rows = [("m", i, f"t{i}", False) for i in range(60)] + [("n", i, f"t{i}", False) for i in range(10)]
    schema = "media string, cue_idx long, text string, done boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = streams.full_batches(src).writeStream.format("memory").queryName("batches").outputMode("append").start()
    q.processAllAvailable()
    assert sorted((r.media, r.batch, r.n) for r in spark.table("batches").collect()) == [("m", 0, 25), ("m", 1, 25)]
    spark.createDataFrame([("m", 60, "", True)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    assert sorted((r.media, r.batch, r.n) for r in spark.table("batches").collect()) == [("m", 0, 25), ("m", 1, 25), ("m", 2, 10)]
