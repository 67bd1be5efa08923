"""Files that tasks write: nothing of a job that failed or was repeated is seen, parts are checked when they are read."""

import os
import zipfile

import numpy as np
import pytest
from pyspark import TaskContext

from cueloom import storage
from cueloom.sources import audio, bundles, media_files

CUES = "media string, start_ms long, end_ms long, text string"


def failing(rows, at):
    """rows whose reader fails once `at` rows of a task were given out."""

    def run(frames):
        for f in frames:
            yield f.head(at)
            raise RuntimeError("lost")

    return rows.mapInPandas(run, rows.schema)


def cues(spark, *media):
    rows = [(m, i * 1000, i * 1000 + 900, f"{m} {i}") for m in media for i in range(3)]
    return spark.createDataFrame(rows, CUES).repartition(2, "media").sortWithinPartitions("media", "start_ms")


def read(spark, path, source="subtitles"):
    return sorted((r.media, r.start_ms, r.text) for r in spark.read.format(source).load(path).collect())


@pytest.mark.parametrize("kind", ["vtt", "srt", "ass"])
def test_failed_jobs_leave_nothing_to_see(spark, tmp_path, kind):
    media_files.register(spark)
    path = str(tmp_path / "subs")
    put = lambda rows, mode="append": rows.write.format("subtitles").option("kind", kind).mode(mode).save(path)
    put(cues(spark, "a", "b"))
    before = read(spark, path)
    assert before == sorted((m, i * 1000, f"{m} {i}") for m in "ab" for i in range(3))
    with pytest.raises(Exception, match="lost"):
        put(failing(cues(spark, "c", "d"), 2))
    assert read(spark, path) == before
    put(cues(spark, "c"))
    assert read(spark, path) == sorted((m, i * 1000, f"{m} {i}") for m in "abc" for i in range(3))
    with pytest.raises(Exception, match="lost"):
        put(failing(cues(spark, "e"), 1), "overwrite")
    assert len(read(spark, path)) == 9  # what was there stays until the new job is whole
    put(cues(spark, "e"), "overwrite")
    assert {m for m, *_ in read(spark, path)} == {"e"}


def test_parts_of_tasks_that_never_committed(spark, tmp_path):
    """A part left by a killed executor is in no list."""
    media_files.register(spark)
    path = str(tmp_path / "subs")
    first = os.path.join(path, f"part-{7:032x}")  # before any job was committed
    os.makedirs(first)
    with open(os.path.join(first, "y.vtt"), "w") as f:
        f.write("WEBVTT\n\n00:00.000 --> 00:01.000\nhalf")
    assert read(spark, path) == []
    cues(spark, "a").write.format("subtitles").option("kind", "vtt").mode("append").save(path)
    stray = os.path.join(path, "part-0123")
    os.makedirs(stray)
    with open(os.path.join(stray, "z.vtt"), "w") as f:
        f.write("WEBVTT\n\n00:00.000 --> 00:01.000\nhalf")
    assert {m for m, *_ in read(spark, path)} == {"a"}


def test_failed_bundles_and_changed_parts(spark, tmp_path):
    bundles.register(spark)
    path = str(tmp_path / "zips")
    parts = spark.createDataFrame([(m, n, s, f"{m}{n}{s}".encode()) for m in ("a", "b") for n in ("x.txt", "y.txt") for s in range(3)], "media string, name string, seq int, content binary")
    put = lambda rows: rows.write.format("bundle").mode("append").save(path)
    with pytest.raises(Exception, match="lost"):
        put(failing(bundles.sorted_parts(parts), 3))
    assert spark.read.format("bundle").load(path).count() == 0  # a killed task may leave a part, which isn't seen
    put(bundles.sorted_parts(parts))
    got = {(r.media, r.name): bytes(r.content) for r in spark.read.format("bundle").load(path).collect()}
    assert got == {(m, n): "".join(f"{m}{n}{s}" for s in range(3)).encode() for m in ("a", "b") for n in ("x.txt", "y.txt")}
    with pytest.raises(Exception, match="twice"):
        put(parts.coalesce(1).sortWithinPartitions("media", "seq", "name"))
    whole = storage.visible(path)[1][0].path
    with zipfile.ZipFile(whole) as z:
        held = {n: z.read(n) for n in z.namelist()}
    with zipfile.ZipFile(whole, "w") as z:
        for n, content in held.items():
            z.writestr(n, content + (b"!" if n == "y.txt" else b""))
    with pytest.raises(Exception, match="isn't what was written"):
        spark.read.format("bundle").load(path).collect()


def test_a_repeated_task_counts_once(spark, tmp_path):
    """The first attempt of a task fails after it has written, the second one succeeds."""
    media_files.register(spark)
    path = str(tmp_path / "subs")
    mark = str(tmp_path / "tried")

    def run(frames):
        for f in frames:
            yield f
        if TaskContext.get().attemptNumber() == 0 and not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("first attempt")

    rows = cues(spark, "a").coalesce(1)
    try:
        rows.mapInPandas(run, rows.schema).write.format("subtitles").option("kind", "srt").mode("append").save(path)
    except Exception:  # noqa: BLE001  (a local session doesn't repeat tasks: the job is what is repeated)
        rows.mapInPandas(run, rows.schema).write.format("subtitles").option("kind", "srt").mode("append").save(path)
    assert os.path.exists(mark) and len(read(spark, path)) == 3


def test_small_files_and_ranges_share_tasks(spark, tmp_path):
    """Many small files take few tasks, and every sample of short, long, empty and other files comes out once at any split."""
    mono = {"format": 1, "channels": 1, "rate": 1000, "align": 2, "bits": 16}
    sizes = [i % 90 for i in range(400)] + [5_000, 100_000, 70_001]
    want = {f"m{m}": (np.arange(n) * (m + 7) % 65_536 - 32_768).astype("<i2") for m, n in enumerate(sizes)}
    for m, x in want.items():
        (tmp_path / f"{m}.wav").write_bytes(audio.wav(x.tobytes(), mono))
    (tmp_path / "stereo.wav").write_bytes(audio.wav(bytes(40_000), mono | {"channels": 2, "align": 4}))
    (tmp_path / "other.wav").write_bytes(b"no" * 50_000)
    far = want["far"] = np.arange(3_000, dtype="<i2")  # samples beyond the first 64 KB
    whole = audio.wav(far.tobytes(), mono)
    (tmp_path / "far.wav").write_bytes(whole[:36] + b"JUNK" + (70_000).to_bytes(4, "little") + bytes(70_000) + whole[36:])
    for split in (1024, 1 << 16, media_files.SPLIT):
        reader = media_files.WavReader({"path": str(tmp_path), "split": str(split)})
        parts = reader.partitions()
        assert len(parts) <= 2 * media_files.TASKS
        got: dict = {}
        for b in (b for p in parts for b in reader.read(p)):
            assert 0 < len(b) <= media_files.SAMPLES
            for m, i, x in zip(*(b.column(c).to_pylist() for c in ("media", "i", "x")), strict=True):
                assert got.setdefault(m, {}).setdefault(i, x) is x
        assert {m: [v[i] for i in range(len(v))] for m, v in got.items()} == {m: (x / 32768).tolist() for m, x in want.items() if len(x)}
    media_files.register(spark)
    read = spark.read.format("wav").option("split", 1024).load(str(tmp_path))
    assert read.rdd.getNumPartitions() <= 2 * media_files.TASKS and read.count() == sum(map(len, want.values()))
