"""Subtitle text to cues and back, as DataFrame plans.

A cue is the first time line of a run of lines that aren't blank, and the rest of that run. So a file
is split at its blank lines, and parsing needs no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.functions.text import IN_LINE, clock, trimmed

#: Time lines of the two formats.
VTT_TIME = r"^(\d{2}):(\d{2}):(\d{2})\.(\d{3})\s+-->\s+(\d{2}):(\d{2}):(\d{2})\.(\d{3})"
SRT_TIME = r"^(\d{2}):(\d{2}):(\d{2})[,.](\d{3})\s*-->\s*(\d{2}):(\d{2}):(\d{2})[,.](\d{3})"
SRT_STRICT = r"^(\d{2}):(\d{2}):(\d{2}),(\d{3})\s+-->\s+(\d{2}):(\d{2}):(\d{2}),(\d{3})$"
ASS_LINE = r"^Dialogue:\s*\d+,(\d+):(\d{2}):(\d{2})\.(\d{2}),(\d+):(\d{2}):(\d{2})\.(\d{2}),[^,]*,[^,]*,[^,]*,[^,]*,[^,]*,[^,]*,(.*)$"


def _time(line: Column, pattern: str, first: int, fraction: int = 1) -> Column:
    g = lambda i: F.regexp_extract(line, pattern, first + i).cast("long")
    return ((g(0) * 60 + g(1)) * 60 + g(2)) * 1000 + g(3) * fraction


def _blocks(files: DataFrame, pattern: str, loose: bool) -> DataFrame:
    """A row per run of lines that aren't blank: media, at, head (the lines before the first time line), line (that one, or null) and text."""
    # quantifiers that never step back: any number of blank lines is met in one loop
    content = F.regexp_replace(F.regexp_replace("content", "\r\n", "\n"), rf"(?:\n{IN_LINE}*+)++$", "")
    each = files.select("media", F.posexplode(F.split(content, rf"\n(?:{IN_LINE}*+\n)++")).alias("at", "block")).withColumn("lines", F.split("block", "\n"))
    is_time = lambda s: (trimmed(s) if loose else s).rlike(pattern)
    each = each.withColumn("i", F.array_position(F.transform("lines", is_time), F.lit(True)).cast("int"))
    there = F.col("i") > 0
    return each.select(
        "media", "at", F.when(there, F.slice("lines", 1, F.col("i") - 1)).otherwise(F.col("lines")).alias("head"),
        F.when(there, F.get("lines", F.col("i") - 1)).alias("line"), F.when(there, F.slice("lines", F.col("i") + 1, F.size("lines"))).alias("text"),
    )


def parse_vtt(files: DataFrame) -> DataFrame:
    """files (media, content) -> media, at (cue order), start_ms, end_ms, text; cues without text are dropped."""
    b = _blocks(files, VTT_TIME, False).where("line is not null and size(text) > 0")
    return b.select("media", "at", _time(F.col("line"), VTT_TIME, 1).alias("start_ms"), _time(F.col("line"), VTT_TIME, 5).alias("end_ms"), F.array_join("text", "\n").alias("text"))


def parse_srt(files: DataFrame) -> DataFrame:
    """As parse_vtt, for SRT and ASS lines: tags are stripped, and texts trimmed."""
    b, line = _blocks(files, SRT_TIME, True), trimmed(F.col("line"))
    clean = trimmed(F.regexp_replace(F.array_join("text", "\n"), "<[^>]+>", ""))
    srt = b.where("line is not null").select("media", "at", F.lit(1 << 30).alias("sub"), _time(line, SRT_TIME, 1).alias("start_ms"), _time(line, SRT_TIME, 5).alias("end_ms"), clean.alias("text"))
    ass = b.select("media", "at", F.posexplode("head").alias("sub", "line")).where(line.rlike(ASS_LINE))
    said = trimmed(F.regexp_replace(F.regexp_replace(F.regexp_extract(line, ASS_LINE, 9), r"\\N", "\n"), r"\{[^}]*\}", ""))
    ass = ass.select("media", "at", "sub", _time(line, ASS_LINE, 1, 10).alias("start_ms"), _time(line, ASS_LINE, 5, 10).alias("end_ms"), said.alias("text"))
    return srt.unionByName(ass).where("text <> ''")


def _joined(cues: DataFrame, block: Column) -> DataFrame:
    return cues.groupBy("media").agg(F.array_sort(F.collect_list(F.struct("cue_idx", block.alias("block")))).alias("b")).select("media", F.transform("b", lambda s: s["block"]).alias("b"))


def to_vtt(cues: DataFrame) -> DataFrame:
    """media, content: cues (media, cue_idx, start_ms, end_ms, text) as WebVTT."""
    times = F.concat(clock(F.col("start_ms")), F.lit(" --> "), clock(F.col("end_ms")))
    return _joined(cues, F.concat(times, F.lit("\n"), F.col("text"), F.lit("\n"))).select("media", F.concat(F.lit("WEBVTT\n\n"), F.array_join("b", "\n")).alias("content"))


def to_srt(cues: DataFrame) -> DataFrame:
    times = F.concat(clock(F.col("start_ms"), ","), F.lit(" --> "), clock(F.col("end_ms"), ","))
    parts = _joined(cues, F.concat(times, F.lit("\n"), F.col("text"), F.lit("\n")))
    return parts.select("media", F.concat(F.array_join(F.transform("b", lambda s, i: F.concat((i + 1).cast("string"), F.lit("\n"), s)), "\n"), F.lit("\n")).alias("content"))


def to_txt(cues: DataFrame) -> DataFrame:
    return _joined(cues, F.col("text")).select("media", F.concat(F.array_join("b", "\n"), F.lit("\n")).alias("content"))


def bilingual(original: DataFrame, translated: DataFrame) -> DataFrame:
    """Cues with both texts. `ok` is false for every cue of a media whose cues don't match in number or times: such media must not be exported."""
    t = translated.select("media", "cue_idx", F.col("start_ms").alias("t_start"), F.col("end_ms").alias("t_end"), F.col("text").alias("t_text"))
    both = original.join(t, ["media", "cue_idx"], "full_outer")
    same = F.coalesce((F.col("start_ms") == F.col("t_start")) & (F.col("end_ms") == F.col("t_end")), F.lit(False))
    bad = both.groupBy("media").agg(F.bool_and(same).alias("ok"))
    return both.join(bad, "media").select("media", "cue_idx", "start_ms", "end_ms", F.concat_ws("\n", "text", "t_text").alias("text"), "ok")


def strict_srt_times(files: DataFrame) -> DataFrame:
    """media, at, start_ms, end_ms of the lines that are a time line and nothing else but white space at their ends."""
    lines = files.select("media", F.posexplode(F.split(F.regexp_replace("content", "\r\n", "\n"), "\n")).alias("at", "line")).withColumn("line", trimmed(F.col("line")))
    line = F.col("line")
    return lines.where(line.rlike(SRT_STRICT)).select("media", "at", _time(line, SRT_STRICT, 1).alias("start_ms"), _time(line, SRT_STRICT, 5).alias("end_ms"))


def count_vtt_cues(files: DataFrame) -> DataFrame:
    lines = F.split(F.regexp_replace("content", "\r\n", "\n"), "\n")
    return files.select("media", F.size(F.filter(lines, lambda s: s.rlike(VTT_TIME))).alias("n_cues"))


def time_problems(cues: DataFrame) -> DataFrame:
    """Media with a cue that ends before it begins, or begins before the one in front of it."""
    from pyspark.sql import Window

    w = Window.partitionBy("media").orderBy("cue_idx")
    back = F.coalesce(F.col("start_ms") < F.lag("start_ms").over(w), F.lit(False))
    return cues.select("media", ((F.col("end_ms") <= F.col("start_ms")) | back).alias("bad")).groupBy("media").agg(F.bool_or("bad").alias("invalid"))
