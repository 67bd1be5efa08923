"""Parsers of tool output, model replies and log lines, as Column expressions; Python only where a match must be hashed."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cueloom.functions.text import clock_ms, trimmed

#: Fixed value: a progress line.
PROGRESS = r"PROGRESS\s+([\d.]+)%\s+of\s+([\d.]+\w+)"


def size_bytes(text: Column) -> Column:
    """Bytes of "7.46MiB"; null if the text is anything else."""
    pattern = r"(?i)^([\d.]+)\s*([KMGT]i)?B$"
    unit = F.upper(F.substring(F.regexp_extract(text, pattern, 2), 1, 1))
    power = F.when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).otherwise(0)
    return F.when(text.rlike(pattern), F.floor(F.regexp_extract(text, pattern, 1).try_cast("double") * F.pow(F.lit(1024.0), power) + 0.5).cast("long"))


def eta_seconds(text: Column) -> Column:
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("long"))
    timed = F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s * 60 + p)
    return F.when(text.rlike(r"^(\d+:)?\d+:\d+$"), timed.cast("double")).otherwise(text.try_cast("double"))


def progress_line(line: Column) -> Column:
    """percent (0 to 1), bytes_done, bytes_total, speed, eta of a progress line; null for other lines."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.regexp_extract(line, PROGRESS, 1).try_cast("double") / 100))
    total = size_bytes(F.regexp_extract(line, PROGRESS, 2))
    speed, eta = F.regexp_extract(line, r"at\s+([\d.]+\S+/s)\s+ETA", 1), F.regexp_extract(line, r"ETA\s+(\S+)", 1)
    frame = F.struct(share.alias("percent"), F.floor(total * share + 0.5).cast("long").alias("bytes_done"), total.alias("bytes_total"), F.nullif(speed, F.lit("")).alias("speed"), F.when(~eta.isin("", "NA", "Unknown"), eta_seconds(eta)).alias("eta"))
    return F.when(line.rlike(PROGRESS), frame)


def error_line(stderr: Column) -> Column:
    """The last line with an error marker, else the last one that isn't usage, else an empty text."""
    lines = F.filter(F.transform(F.split(stderr, "\n"), lambda s: trimmed(s)), lambda s: s != "")
    mark = r"(?i)^(yt-dlp:\s*error:|ERROR:)\s*(.*)$"
    marked = F.filter(lines, lambda s: s.rlike(mark))
    plain = F.filter(lines, lambda s: ~F.lower(F.substring(s, 1, 6)).eqNullSafe("usage:"))
    last = F.try_element_at(marked, F.lit(-1))
    said = trimmed(F.concat(F.regexp_extract(last, mark, 1), F.lit(" "), trimmed(F.regexp_extract(last, mark, 2))))
    return F.coalesce(F.when(F.size(marked) > 0, said), F.try_element_at(plain, F.lit(-1)), F.lit(""))


#: The levels of a log.
LEVELS = ("info", "warn", "error", "debug")


def log_line(line: Column) -> Column:
    """ts, level and event of a JSON log line; any level but LEVELS is unknown, and a line that isn't JSON has itself as event."""
    j = F.from_json(line, "ts string, level string, event string")
    return F.struct(j["ts"].alias("ts"), F.when(j["level"].isin(*LEVELS), j["level"]).otherwise("unknown").alias("level"), F.coalesce(j["event"], line).alias("event"))


def string_array(reply: Column) -> Column:
    """The strings of a model's JSON array, from the first [ to the last ], fenced or not; null unless all items are strings."""
    s = trimmed(reply)
    s = F.when(F.startswith(s, F.lit("```")), F.regexp_replace(F.regexp_replace(s, r"^```(?:json)?\s*", ""), r"\s*```\s*$", "")).otherwise(s)
    body = F.regexp_extract(s, r"(?s)(\[.*\])", 1)
    parsed = F.try_parse_json(F.nullif(body, F.lit("")))
    ok = F.schema_of_variant(parsed).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(F.from_json(body, "array<string>"), lambda x: x.isNull())
    return F.when(ok, F.from_json(body, "array<string>"))


#: Fixed value: a chapter line of a reply.
CHAPTER = r"^[-*]\s+\[?(\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?)(?:\s*[–\-—→~]\s*\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?)?\]?\s*[:：]?\s*(.+?)(?:\s+[—–-]\s+(.+))?$"


def insights(markdown: Column) -> Column:
    """summary, bullets and chapters (start_ms, title, description) of a reply; null where it has none of them.

    Without a summary heading all in front of the chapters is the summary.
    """
    with_summary = trimmed(F.regexp_extract(markdown, r"(?is)## Summary\s*\n(.*?)(?=\n## |$)", 1))
    head = F.regexp_replace(markdown, r"(?is)## Chapters\s*\n.*$", "")
    lines = F.transform(F.split(F.when(with_summary != "", with_summary).otherwise(trimmed(head)), "\n"), lambda s: trimmed(s))
    first = F.array_position(F.transform(lines, lambda s: F.startswith(s, F.lit("- "))), F.lit(True)).cast("int")
    prose = F.when(first == 0, lines).otherwise(F.slice(lines, 1, F.greatest(first - 1, F.lit(0))))
    summary = F.array_join(F.filter(prose, lambda s: s != ""), " ")
    bullets = F.transform(F.filter(lines, lambda s: F.startswith(s, F.lit("- "))), lambda s: trimmed(F.substring(s, 3, 1 << 30)))
    block = F.transform(F.split(F.regexp_extract(markdown, r"(?is)## Chapters\s*\n(.*)$", 1), "\n"), lambda s: trimmed(s))
    g = lambda s, i: trimmed(F.regexp_extract(s, CHAPTER, i))
    chapters = F.transform(F.filter(block, lambda s: s.rlike(CHAPTER)), lambda s: F.struct(clock_ms(g(s, 1)).alias("start_ms"), g(s, 2).alias("title"), g(s, 3).alias("description")))
    return F.when((summary != "") | (F.size(bullets) > 0) | (F.size(chapters) > 0), F.struct(summary.alias("summary"), bullets.alias("bullets"), chapters.alias("chapters")))


#: Keys whose values are kept, and the start of absolute paths.
KEPT_KEYS = {"sha", "taskId", "requestId", "lang", "event", "level", "ts", "code"}
PATHS = re.compile(r"""(?:[A-Za-z]:\\|~/|/(?:Users|home|var|private|tmp|Volumes|System/Volumes)/)[^\s'",)]+""")
SECRET_PARTS = ("path", "name", "raw", "prompt", "transcript", "modeloutput")


def _short(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()[:12]


def redacted(line: str) -> str:
    """A log line without names, paths or content: what is kept can be joined by its hash.

    Paths in the items of a JSON array are replaced too, and in a line that is any other text, a JSON string among them.
    """
    hide = lambda s: PATHS.sub(lambda m: f"path:{_short(m[0])}", s)
    try:
        obj = json.loads(line)
    except ValueError:
        return hide(line)
    if isinstance(obj, list):
        return json.dumps([hide(v) if isinstance(v, str) else v for v in obj], ensure_ascii=False, separators=(",", ":"))
    if not isinstance(obj, dict):
        return hide(line)
    for k, v in obj.items():
        if k not in KEPT_KEYS and isinstance(v, str) and v:
            secret = k.lower() == "cuetext" or any(p in k.lower() for p in SECRET_PARTS)
            obj[k] = f"hash:{_short(v)}" if secret else hide(v)
    return json.dumps(obj, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(StringType())
def _redact(lines: pd.Series) -> pd.Series:
    return lines.map(lambda s: None if s is None else redacted(s))


def redact(line: Column, debug: bool = False) -> Column:
    """redacted() lines; as they are when debugging."""
    return line if debug else _redact(line)


def tokens_per_second(tokens: Column, ms: Column) -> Column:
    return F.when((tokens > 0) & (ms > 0), F.round(tokens / (ms / 1000), 2))


def benchmark_score(ok: Column, ms: Column, json_valid: Column, tps: Column) -> Column:
    """0 to 100 of a model's run: success, valid JSON, speed, and time taken."""
    valid = F.when(json_valid, 20).when(~json_valid, -20).otherwise(0)
    score = 60 + valid + F.least(F.lit(20), F.floor(F.coalesce(tps, F.lit(0.0)) + 0.5)) - F.least(F.lit(20), F.floor(ms / 10_000))
    return F.when(ok, F.greatest(F.lit(0), F.least(F.lit(100), score))).otherwise(0).cast("int")
