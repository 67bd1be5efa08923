"""Bundles of all media, written as archives and read again, and their rubric, with the SQL of what each part must hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom import storage
from cueloom.functions.text import collapse_space
from cueloom.plans import bundles as B
from cueloom.plans.queries import query
from cueloom.sources import adapters
from cueloom.sources import bundles as archives


def facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """media, cues and insights of all conversations; every third medium has no insights."""
    cues = adapters.cues(spark, d).withColumn("media", F.col("media").cast("string")).select("media", "cue_idx", "start_ms", "end_ms", "text", "speaker")
    k = F.col("media").cast("long")
    media = cues.select("media").distinct().select("media", F.lit("mp4").alias("ext"), (k * 1000).alias("size_bytes"), F.when(k % 2 == 0, k).alias("duration_s"))
    short = F.left(collapse_space(F.col("text")), F.lit(40))
    chapter = F.struct((F.col("start_ms") + 700).alias("start_ms"), F.concat(F.lit("Part "), F.col("cue_idx").cast("string")).alias("title"), F.when(F.col("cue_idx") % 4 == 0, F.col("speaker")).alias("description"))
    in_order = lambda test, value: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("cue_idx", value.alias("v"))))), lambda x: x["v"])
    cued = cues.where(k % 3 != 0)
    insights = cued.groupBy("media").agg(F.max(F.when(F.col("cue_idx") == 0, short)).alias("summary"), in_order(F.col("speaker") == "assistant", short).alias("bullets"), in_order(F.col("cue_idx") % 2 == 0, chapter).alias("chapters"))
    return media, cues, insights


def write_bundles(spark: SparkSession, d: str, recipe: str) -> DataFrame:
    """The parts of the archives of one recipe, read back."""
    archives.register(spark)
    path = storage.shared_dir(spark)
    archives.sorted_parts(B.media_parts(*facts(spark, d), recipe)).write.format("bundle").mode("append").save(path)
    return spark.read.format("bundle").load(path).withColumn("recipe", F.lit(recipe))


def _clock_sql(ms: str, mark: str = "") -> str:
    two = lambda x: f"lpad(CAST({x} AS VARCHAR), CAST(greatest(2, length(CAST({x} AS VARCHAR))) AS INTEGER), '0')"
    text = f"{two(f'{ms} // 3600000')} || ':' || {two(f'{ms} // 60000 % 60')} || ':' || {two(f'{ms} // 1000 % 60')}"
    return f"({text} || '{mark}' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0'))" if mark else f"({text})"


_FACTS = r"""c AS (SELECT CAST(media AS VARCHAR) AS media, cue_idx, start_ms, end_ms, text, speaker, row_number() OVER (PARTITION BY media ORDER BY cue_idx) AS n,
        trim(regexp_replace(text, '[ \t\n\x0B\f\r\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g')) AS flat FROM {cues}),
    w AS (SELECT media, count(*) AS cues, arg_max(end_ms, n) AS last_end, 'media-' || left(media, 12) AS title, CAST(media AS BIGINT) % 3 <> 0 AS cached FROM c GROUP BY 1),
    b AS (SELECT media, left(flat, 40) AS bullet, row_number() OVER (PARTITION BY media ORDER BY cue_idx) - 1 AS pos FROM c WHERE speaker = 'assistant' AND CAST(media AS BIGINT) % 3 <> 0),
    h AS (SELECT media, start_ms + 700 AS start_ms, 'Part ' || cue_idx AS title, CASE WHEN cue_idx % 4 = 0 THEN coalesce(speaker, '') ELSE '' END AS descr, row_number() OVER (PARTITION BY media ORDER BY cue_idx) - 1 AS pos
        FROM c WHERE cue_idx % 2 = 0 AND CAST(media AS BIGINT) % 3 <> 0),
    g AS (SELECT h.*, w.last_end, (SELECT 'cue-' || lpad(CAST(arg_min(n, (abs(c.start_ms - h.start_ms), n)) AS VARCHAR), 5, '0') FROM c WHERE c.media = h.media) AS cite FROM h JOIN w USING (media)),
    s AS (SELECT media, max(CASE WHEN cue_idx = 0 THEN left(flat, 40) END) AS summary FROM c WHERE CAST(media AS BIGINT) % 3 <> 0 GROUP BY 1),
    f AS (SELECT w.*, coalesce(trim(s.summary), '') AS summary, (SELECT count(*) FROM h WHERE h.media = w.media) AS chapters, (SELECT count(*) FROM b WHERE b.media = w.media) AS bullets FROM w LEFT JOIN s USING (media))"""


def _agg(of: str, text: str, order: str, where: str = "true", sep: str = "") -> str:
    return f"coalesce((SELECT string_agg({text}, '{sep}' ORDER BY {order}) FROM {of} x WHERE x.media = f.media AND {where}), '')"


def _parts_sql(recipe: str) -> str:
    """name and content of each part of a bundle, from f."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    line = f"'- [' || {_clock_sql('x.start_ms')} || '] ' || x.title || CASE WHEN descr <> '' THEN ' - ' || descr ELSE '' END"
    cite = "' (' || x.cite || ')'"
    nl = "chr(10)"
    none = lambda text: f"CASE WHEN f.chapters = 0 THEN {q(text)} ELSE '' END"
    source = f"""'{{"id":"cue-' || lpad(CAST(x.n AS VARCHAR), 5, '0') || '","fileId":"primary","title":"' || f.title || '","startMs":' || x.start_ms || ',"endMs":' || x.end_ms || ',"timestamp":"' || {_clock_sql('x.start_ms')} || '","speaker":null,"snippet":' || to_json(left(x.flat, 240)) || ',"snippetHash":"' ||
        lower(lpad(printf('%x', list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(list_filter(string_split(x.flat, ''), lambda y: y <> ''), lambda y: CAST(unicode(y) AS BIGINT))), lambda h, y: CAST((CAST(xor(h, y) AS HUGEINT) * 16777619) % 4294967296 AS BIGINT))), 8, '0')) || '"}}'"""
    ref = lambda name: f"""'{{"artifact":"{name}","section":' || to_json(x.title) || ',"sourceIds":["' || x.cite || '"]}}'"""
    refs = _agg("g", ref("chapters.md"), "pos", sep=",\n")
    if recipe != B.GENERIC:
        refs += " || " + _agg("g", "',' || chr(10) || " + ref("deliverable.md"), "pos")
    insight = "CASE WHEN f.cached THEN '\"artifact\"' ELSE 'null' END"
    parts = {
        "transcript.md": f"'# Transcript' || {nl} || {nl} || 'Source: ' || f.title || {nl} || {nl} || " + _agg("c", f"'- [' || {_clock_sql('x.start_ms')} || '] ' || x.text || {nl}", "n"),
        "subtitles.srt": _agg("c", f"x.n || {nl} || {_clock_sql('x.start_ms', ',')} || ' --> ' || {_clock_sql('x.end_ms', ',')} || {nl} || x.text || {nl} || {nl}", "n"),
        "chapters.md": f"CASE WHEN f.chapters = 0 THEN '# Chapters' || {nl} || {nl} || CASE WHEN last_end < 180000 THEN {q(B.TOO_SHORT)} ELSE {q(B.NO_CHAPTERS)} END || {nl} ELSE '# Chapters' || {nl} || {nl} || {_agg('g', line + ' || ' + nl, 'pos')} END",
        "summary.md": f"CASE WHEN f.summary = '' AND f.bullets = 0 THEN {q(B.NO_SUMMARY)} ELSE '# Summary' || {nl} || {nl} || CASE WHEN f.summary <> '' THEN f.summary || {nl} || {nl} ELSE '' END || " + _agg("b", f"'- ' || x.bullet || {nl}", "pos") + " END",
        "sources.json": f"""'{{"schemaVersion":1,"videoSha":"' || f.media || '","title":"' || f.title || '","sources":[' || {nl} || {_agg("c", source, "n", sep=",\n")} || '],"outputReferences":[' || {nl} || {refs} || ']}}' || {nl}""",
        "manifest.json": f"""'{{"schemaVersion":1,"kind":"artifact-bundle","recipe":"{recipe}","status":"complete","input":{{"sha256":"' || f.media || '","title":"' || f.title || '","sourceNameRedacted":true,"ext":"mp4","sizeBytes":' || CAST(f.media AS BIGINT) * 1000 || ',"durationS":' || CASE WHEN CAST(f.media AS BIGINT) % 2 = 0 THEN f.media ELSE 'null' END
            || '}},"artifacts":{{"transcript":"transcript.md","subtitles":"subtitles.srt","chapters":"chapters.md","summary":"summary.md","sources":"sources.json","deliverable":"deliverable.md"}},"counts":{{"cues":' || f.cues || ',"sources":' || f.cues || ',"chapters":' || f.chapters || '}},"sourceState":{{"transcriptStatus":"cached","insightSource":' || {insight} || '}}}}' || {nl}""",
    }
    media = f"'Media: ' || f.title || {nl} || {nl}"
    if recipe == B.GENERIC:
        parts["deliverable.md"] = f"'# Local Archive Pack' || {nl} || {nl} || {media} || {q(B.GENERIC_HEAD)} || '- Cues: ' || f.cues || {nl} || '- Sources: ' || f.cues || {nl} || '- Cached summary: ' || CASE WHEN f.cached THEN 'yes' ELSE 'no' END || {nl}"
    elif recipe == B.CREATOR:
        until = "least(x.start_ms + 90000, CASE WHEN x.last_end > 0 THEN x.last_end ELSE x.start_ms + 90000 END)"
        clip = f"'- [' || {_clock_sql('x.start_ms')} || '-' || {_clock_sql(until)} || '] ' || CASE WHEN descr <> '' THEN descr ELSE x.title END || {cite} || {nl}"
        parts["deliverable.md"] = " || ".join([
            f"'# Creator Editing Brief' || {nl} || {nl} || {media} || '## Chapter Outline' || {nl} || {nl}", none("- No cached chapters found.\n"), _agg("g", f"{line} || {cite} || {nl}", "pos"),
            f"{nl} || '## Clip Candidates For Human Review' || {nl} || {nl}", none("- No clip candidates found from cached AI chapters.\n"), _agg("g", clip, "pos", "x.pos < 8"), q(B.CREATOR_END)])
    else:
        parts["deliverable.md"] = " || ".join([
            f"'# Meeting Notes Evidence Pack' || {nl} || {nl} || {media} || '## Decisions' || {nl} || {nl}", "CASE WHEN f.bullets = 0 THEN '- No cached summary bullets found.' || chr(10) ELSE '' END",
            _agg("b", f"'- Review candidate: ' || x.bullet || {nl}", "pos", "x.pos < 6"), q(B.MEETING_ACTIONS), none("- No cached chapters found.\n"), _agg("g", f"{line} || {cite} || {nl}", "pos"),
            q(B.MEETING_OPEN), none("- No agenda candidates found.\n"), _agg("g", f"'- Revisit ' || x.title || {cite} || {nl}", "pos", "x.pos < 5"), q(B.MEETING_END)])
    return " UNION ALL ".join(f"SELECT '{recipe}' AS recipe, media, '{name}' AS name, {text} AS content FROM f" + (" WHERE f.cached" if recipe != B.GENERIC else "") for name, text in parts.items())


_PARTS = " UNION ALL ".join(map(_parts_sql, B.RECIPES))


@query(f"WITH {_FACTS}, p AS ({_PARTS}) SELECT recipe, media, name, CAST(strlen(content) AS BIGINT) AS size, sha256(content) AS sha256 FROM p")
def media_bundles(spark, d):
    """Every part of every archive of the three recipes, as read back."""
    return reduce(DataFrame.unionByName, (write_bundles(spark, d, r) for r in B.RECIPES)).select("recipe", "media", "name", "size", "sha256")
