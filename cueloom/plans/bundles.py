"""Bundles of a medium's results, as rows of parts that bundles.BundleWriter streams into archives.

No part is put together in a row: a transcript is a row for its head and one for each cue. What a part needs of
the whole medium (numbers, the last end, the source nearest to a chapter) is joined to its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions.parsing import redact
from cueloom.functions.text import clock, collapse_space, fnv1a
from cueloom.operators.intervals import nearest_cue

#: Recipes, names of parts, limits, and the texts that are the same in every bundle.
GENERIC, CREATOR, MEETING = RECIPES = ("generic-archive-pack", "creator-brief", "meeting-notes")
ARTIFACTS = {"transcript": "transcript.md", "subtitles": "subtitles.srt", "chapters": "chapters.md", "summary": "summary.md", "sources": "sources.json", "deliverable": "deliverable.md"}
MANIFEST = "manifest.json"
SNIPPET_CHARS, CLIPS, CLIP_MS, DECISIONS, AGENDA = 240, 8, 90_000, 6, 5
SHORT_MS = 180_000
TOO_SHORT = "Media is too short for useful cached chapters, or no insight artifact exists yet."
NO_CHAPTERS = "No cached insight chapters found. Generate insights, then export again."
NO_SUMMARY = "# Summary\n\nNo cached AI summary found. Generate insights, then export again.\n"
GENERIC_HEAD = """## Contents

- `manifest.json` - run metadata without raw local paths or transcript text.
- `transcript.md` - timestamped transcript.
- `subtitles.srt` - subtitle export from the same cue source.
- `chapters.md` - cached AI chapters when available.
- `summary.md` - cached AI summary when available.
- `sources.json` - cue-level source map for downstream agents.

## Status

"""
CREATOR_END = """
## Risk Notes

- Treat clip candidates as human review targets, not final editorial judgment.
- Verify any quotes against the timestamped transcript before publishing.
"""
MEETING_ACTIONS = """
## Action Items

- Not inferred by this export. Confirm owner and deadline against cited transcript evidence.

## Discussion Points To Review

"""
MEETING_OPEN = """
## Open Questions

- Not inferred by this export. Add questions only after reviewing cited transcript evidence.

## Follow-Up Agenda

"""
MEETING_END = """
## Risk Notes

- Owners, deadlines, and decisions require human confirmation unless explicit in cited transcript text.
"""


def title(media: Column) -> Column:
    return F.concat(F.lit("media-"), F.left(media, F.lit(12)))


def _piece(name: str, seq: Column, content: Column, where: Column | None = None) -> Column:
    """A row of a part, or null where the condition fails."""
    made = F.struct(F.lit(name).alias("name"), seq.cast("long").alias("seq"), content.alias("content"))
    return made if where is None else F.when(where, made)


def _json_text(c: Column) -> Column:
    """c as JSON text; null as null."""
    s = F.to_json(F.struct(c.alias("x")))
    return F.when(c.isNotNull(), F.substring(s, 6, F.length(s) - 6)).otherwise("null")


def numbered(cues: DataFrame) -> DataFrame:
    """cues with n (from 1) and their source's id."""
    n = F.row_number().over(Window.partitionBy("media").orderBy("cue_idx"))
    return cues.withColumn("n", n).withColumn("source_id", F.concat(F.lit("cue-"), F.when(F.col("n") < 100_000, F.lpad(F.col("n").cast("string"), 5, "0")).otherwise(F.col("n").cast("string"))))


def chapters_of(insights: DataFrame, cues: DataFrame) -> DataFrame:
    """media, of (its place, from 0), start_ms, title, description and source_id: the source nearest to its start, the first of equals. cues: numbered()."""
    c = insights.select("media", F.posexplode("chapters").alias("pos", "c")).select("media", "pos", F.col("c.start_ms").alias("start_ms"), F.col("c.title").alias("title"), F.coalesce("c.description", F.lit("")).alias("description"))
    first = cues.groupBy("media", "start_ms").agg(F.min("n").alias("cue_idx"), F.min_by("source_id", "n").alias("source_id"), F.max("end_ms").alias("end_ms"))
    near = nearest_cue(c.select("media", "pos", F.col("start_ms").alias("at_ms")), first).select("media", "pos", "cue_idx")
    named = near.join(first.select("media", "cue_idx", "source_id"), ["media", "cue_idx"]).drop("cue_idx")
    return c.join(named, ["media", "pos"]).withColumn("of", F.col("pos").cast("long")).drop("pos")


def media_parts(media: DataFrame, cues: DataFrame, insights: DataFrame, recipe: str) -> DataFrame:
    """Parts (media, name, seq, content) of the bundle of each medium that has cues and, but for the generic recipe, insights.

    media: media, ext, size_bytes, duration_s. cues: media, cue_idx, start_ms, end_ms, text. insights: media, summary, bullets
    (array of texts), chapters (array of start_ms, title, description), one row a medium at most.
    """
    if recipe not in RECIPES:
        raise ValueError(f"no such recipe: {recipe}")
    generic = recipe == GENERIC
    cued = cues.join(media.select("media"), "media", "left_semi")
    if not generic:
        cued = cued.join(insights.select("media"), "media", "left_semi")
    cued = numbered(cued)
    whole = cued.groupBy("media").agg(F.count("*").alias("cues"), F.max_by("end_ms", "n").alias("last_end"))
    facts = whole.join(media, "media").join(insights.select("media", "summary", "bullets", F.size("chapters").alias("n_chapters"), F.lit(True).alias("cached")), "media", "left")
    facts = facts.withColumns({"n_chapters": F.greatest(F.coalesce("n_chapters", F.lit(0)), F.lit(0)), "cached": F.coalesce("cached", F.lit(False)), "title": title(F.col("media"))})
    chapters = chapters_of(insights, cued).join(whole, "media")
    of_cue, of_fact, of_chapter, of_bullet = [], [], [], []  # pieces by the table whose rows they are made of, each read once
    one = lambda name, seq, content: of_fact.append(_piece(name, F.lit(seq), content))
    cite = F.concat(F.lit(" ("), F.col("source_id"), F.lit(")"))
    at = F.concat(F.lit("- ["), clock(F.col("start_ms"), None), F.lit("] "))
    said = F.when(F.col("description") != "", F.concat(F.lit(" - "), F.col("description"))).otherwise("")
    line = F.concat(at, F.col("title"), said)
    bullets = facts.select("media", F.posexplode("bullets").alias("pos", "bullet")).withColumn("of", F.col("pos").cast("long"))
    a = ARTIFACTS

    one(a["transcript"], 0, F.concat(F.lit("# Transcript\n\nSource: "), F.col("title"), F.lit("\n\n")))
    of_cue.append(_piece(a["transcript"], F.col("n"), F.concat(at, F.col("text"), F.lit("\n"))))
    times = F.concat(clock(F.col("start_ms"), ","), F.lit(" --> "), clock(F.col("end_ms"), ","))
    of_cue.append(_piece(a["subtitles"], F.col("n"), F.concat(F.col("n").cast("string"), F.lit("\n"), times, F.lit("\n"), F.col("text"), F.lit("\n\n"))))

    none = F.when(F.col("last_end") < SHORT_MS, TOO_SHORT).otherwise(NO_CHAPTERS)
    one(a["chapters"], 0, F.when(F.col("n_chapters") == 0, F.concat(F.lit("# Chapters\n\n"), none, F.lit("\n"))).otherwise("# Chapters\n\n"))
    of_chapter.append(_piece(a["chapters"], F.col("of") + 1, F.concat(line, F.lit("\n"))))

    summary = F.trim(F.coalesce("summary", F.lit("")))
    nothing = (summary == "") & (F.coalesce(F.size("bullets"), F.lit(0)) <= 0)
    one(a["summary"], 0, F.when(nothing, NO_SUMMARY).when(summary != "", F.concat(F.lit("# Summary\n\n"), summary, F.lit("\n\n"))).otherwise("# Summary\n\n"))
    of_bullet.append(_piece(a["summary"], F.col("of") + 1, F.concat(F.lit("- "), F.col("bullet"), F.lit("\n"))))

    text = collapse_space(F.col("text"))
    source = F.to_json(F.struct(
        F.col("source_id").alias("id"), F.lit("primary").alias("fileId"), title(F.col("media")).alias("title"), F.col("start_ms").alias("startMs"), F.col("end_ms").alias("endMs"), clock(F.col("start_ms"), None).alias("timestamp"),
        F.lit(None).cast("string").alias("speaker"), F.left(text, F.lit(SNIPPET_CHARS)).alias("snippet"), fnv1a(text).alias("snippetHash"),
    ), {"ignoreNullFields": "false"})
    head = F.concat(F.lit('{"schemaVersion":1,"videoSha":'), _json_text(F.col("media")), F.lit(',"title":'), _json_text(F.col("title")), F.lit(',"sources":[\n'))
    refs = lambda name: F.to_json(F.struct(F.lit(name).alias("artifact"), F.col("title").alias("section"), F.array("source_id").alias("sourceIds")))
    last = F.lit(1 << 40)
    comma = lambda first: F.when(first, "").otherwise(",\n")
    one(a["sources"], 0, head)
    of_cue.append(_piece(a["sources"], F.col("n"), F.concat(comma(F.col("n") == 1), source)))
    of_fact.append(_piece(a["sources"], last, F.lit('],"outputReferences":[\n')))
    of_chapter.append(_piece(a["sources"], last + 1 + F.col("of"), F.concat(comma(F.col("of") == 0), refs(a["chapters"]))))
    if not generic:
        of_chapter.append(_piece(a["sources"], 2 * last + F.col("of"), F.concat(F.lit(",\n"), refs(a["deliverable"]))))
    of_fact.append(_piece(a["sources"], 3 * last, F.lit("]}\n")))

    manifest = F.to_json(F.struct(
        F.lit(1).alias("schemaVersion"), F.lit("artifact-bundle").alias("kind"), F.lit(recipe).alias("recipe"), F.lit("complete").alias("status"),
        F.struct(F.col("media").alias("sha256"), "title", F.lit(True).alias("sourceNameRedacted"), "ext", F.col("size_bytes").alias("sizeBytes"), F.col("duration_s").alias("durationS")).alias("input"),
        F.struct(*(F.lit(v).alias(k) for k, v in a.items())).alias("artifacts"),
        F.struct("cues", F.col("cues").alias("sources"), F.col("n_chapters").alias("chapters")).alias("counts"),
        F.struct(F.lit("cached").alias("transcriptStatus"), F.when(F.col("cached"), "artifact").alias("insightSource")).alias("sourceState"),
    ), {"ignoreNullFields": "false"})
    one(MANIFEST, 0, F.concat(manifest, F.lit("\n")))

    d, of_media = a["deliverable"], F.concat(F.lit("Media: "), F.col("title"), F.lit("\n\n"))
    absent = lambda text: F.when(F.col("n_chapters") == 0, text).otherwise("")
    no_bullets = F.when(F.coalesce(F.size("bullets"), F.lit(0)) <= 0, "- No cached summary bullets found.\n").otherwise("")
    row = lambda block, content, most=None: _piece(d, block * last + 1 + F.col("of"), F.concat(content, F.lit("\n")), None if most is None else F.col("of") < most)
    part = lambda block, content: of_fact.append(_piece(d, block * last, content))
    if generic:
        counts = F.concat(F.lit("- Cues: "), F.col("cues").cast("string"), F.lit("\n- Sources: "), F.col("cues").cast("string"), F.lit("\n- Cached summary: "), F.when(F.col("cached"), "yes").otherwise("no"), F.lit("\n"))
        one(d, 0, F.concat(F.lit("# Local Archive Pack\n\n"), of_media, F.lit(GENERIC_HEAD), counts))
    elif recipe == CREATOR:
        until = F.least(F.col("start_ms") + CLIP_MS, F.when(F.col("last_end") > 0, F.col("last_end")).otherwise(F.col("start_ms") + CLIP_MS))
        clip = F.concat(F.lit("- ["), clock(F.col("start_ms"), None), F.lit("-"), clock(until, None), F.lit("] "), F.when(F.col("description") != "", F.col("description")).otherwise(F.col("title")), cite)
        one(d, 0, F.concat(F.lit("# Creator Editing Brief\n\n"), of_media, F.lit("## Chapter Outline\n\n"), absent("- No cached chapters found.\n")))
        part(1, F.concat(F.lit("\n## Clip Candidates For Human Review\n\n"), absent("- No clip candidates found from cached AI chapters.\n")))
        part(2, F.lit(CREATOR_END))
        of_chapter += [row(0, F.concat(line, cite)), row(1, clip, CLIPS)]
    else:
        one(d, 0, F.concat(F.lit("# Meeting Notes Evidence Pack\n\n"), of_media, F.lit("## Decisions\n\n"), no_bullets))
        part(1, F.concat(F.lit(MEETING_ACTIONS), absent("- No cached chapters found.\n")))
        part(2, F.concat(F.lit(MEETING_OPEN), absent("- No agenda candidates found.\n")))
        part(3, F.lit(MEETING_END))
        of_bullet.append(row(0, F.concat(F.lit("- Review candidate: "), F.col("bullet")), DECISIONS))
        of_chapter += [row(1, F.concat(line, cite)), row(2, F.concat(F.lit("- Revisit "), F.col("title"), cite), AGENDA)]

    made = [df.select("media", F.explode(F.array(*pieces)).alias("p")).where("p is not null").select("media", "p.*") for df, pieces in ((cued, of_cue), (facts, of_fact), (chapters, of_chapter), (bullets, of_bullet))]
    return reduce(DataFrame.unionByName, made)


#: Fixed value: names of log files, with their date.
LOG_FILE = r"^(\d{4}-\d{2}-\d{2})\.jsonl$"


def log_files(files: DataFrame) -> DataFrame:
    """date, name, size_bytes, mtime_ms of the files (name, size_bytes, mtime_ms) that are logs, and place: the newest date first, then by name."""
    date = F.regexp_extract("name", LOG_FILE, 1)
    logs = files.select(date.alias("date"), "name", "size_bytes", "mtime_ms").where("date <> ''")
    return logs.withColumn("place", F.row_number().over(Window.orderBy(F.desc("date"), "name")))


def diagnostic_parts(lines: DataFrame, now_ms: int, retention_days: int = 7, facts: dict[str, str] | None = None) -> DataFrame:
    """Parts of one diagnostic bundle for each device: its logs of the last days, line by line without paths and content, a manifest, and `facts` (JSON texts by name) as they are.

    lines: media (the device), name (of its log file), seq, line. Files of other names, of days that ended before the limit, and empty lines are left out.
    """
    date = F.regexp_extract("name", LOG_FILE, 1)
    ends = F.unix_millis(F.try_to_timestamp(F.concat(date, F.lit("T23:59:59Z"))))
    recent = lines.where((date != "") & (F.coalesce(ends, F.lit(now_ms)) >= now_ms - retention_days * 86_400_000) & (F.col("line") != ""))
    logs = recent.select("media", F.concat(F.lit("logs/"), "name").alias("name"), F.col("seq").cast("long").alias("seq"), F.concat(redact(F.col("line")), F.lit("\n")).alias("content"))
    all_ = lines.select("media").distinct()
    fixed = {MANIFEST: f'{{"retentionDays":{retention_days}}}', **(facts or {})}
    heads = all_.select("media", F.explode(F.create_map(*(F.lit(x) for kv in fixed.items() for x in kv))).alias("name", "content"))
    return logs.unionByName(heads.select("media", "name", F.lit(0).cast("long").alias("seq"), "content"))
