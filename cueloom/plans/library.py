"""More of the library's state: tasks that are ensured, guarded updates, validators, fingerprints, partial insights, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from cueloom.functions.text import SPACE, trimmed
from cueloom.operators import transcripts
from cueloom.sources import subtitles

#: Names, codes and limits that inputs and results are held to.
MODELS = ("tiny", "base", "small", "medium", "large-v3", "large-v3-turbo")
LANG, EXPORT_LANG, SHA = r"^[a-z]{2}(-[A-Z]{2})?$", r"^[a-zA-Z0-9_-]{1,32}$", r"^[0-9a-f]{64}$"
INSIGHT_LANGS, STRATEGIES = ("zh-CN", "en"), ("complete_each_file", "fast_first")
SUMMARY_CHARS, BULLET_CHARS, TITLE_CHARS, DESCRIPTION_CHARS, MOST_ITEMS = 700, 220, 90, 180, 5
MODEL_ERRORS = ("LLM_MODEL_NOT_CONFIGURED", "LLM_BINARY_MISSING", "MODEL_UNUSABLE", "failed to load model")
WHISPER_ERRORS, SENSE_ERROR = ("whisper-cli not built", "Model not downloaded"), "SENSE_VOICE_NOT_INSTALLED"


def ensure_tasks(tasks: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, video_sha, status, action of the task of each wanted medium (video_sha): its latest one, queued again if it failed or was cancelled, or else a new one without an id.

    Asking again changes nothing. Of tasks made at the same time the greatest id is the latest.
    """
    last = tasks.groupBy("video_sha").agg(F.max(F.struct("created_at", "id", "status")).alias("t"))
    x = wanted.select("video_sha").distinct().join(last, "video_sha", "left")
    dead = F.col("t.status").isin("failed", "canceled")
    action = F.when(F.col("t").isNull(), "created").when(dead, "revived").otherwise("kept")
    return x.select("video_sha", F.col("t.id").alias("id"), F.when(F.col("t").isNull() | dead, "queued").otherwise(F.col("t.status")).alias("status"), action.alias("action"))


def mark_items(items: DataFrame, changes: DataFrame, keys: list[str], now_ms: int) -> DataFrame:
    """items (keys, status, started_at, completed_at, error_msg) with the changes (keys, new_status, new_error) made, and `changed`.

    A cancelled item is final. The first change beyond queued sets started_at, an ending one
    completed_at; a change without an error leaves the old one.
    """
    ends = F.col("new_status").isin("completed", "failed", "canceled")
    x = items.join(changes, keys, "left").withColumn("changed", F.coalesce(F.col("new_status").isNotNull() & (F.col("status") != "canceled"), F.lit(False)))
    put = lambda col, test, value: F.when(F.col("changed") & test, value).otherwise(F.col(col)).alias(col)
    return x.select(
        *keys, put("status", F.lit(True), F.col("new_status")), put("started_at", F.col("started_at").isNull() & (ends | (F.col("new_status") == "running")), F.lit(now_ms)),
        put("completed_at", ends, F.lit(now_ms)), put("error_msg", F.col("new_error").isNotNull(), F.col("new_error")), "changed",
    )


OPTIONS = "whisperModel string, targetLangs array<string>, insights boolean, insightLanguage string, diarize boolean, diarizeTopK long, executionStrategy string"


def batch_options(body: Column) -> Column:
    """The options in a JSON object, repeated languages once; null if one of them isn't valid."""
    v = F.try_parse_json(body)
    of = lambda name: F.variant_get(v, f"$.{name}", "variant")
    kind = lambda name: F.coalesce(F.schema_of_variant(of(name)), F.lit("absent"))
    o = F.from_json(body, OPTIONS)
    text_of = lambda name, allowed: (kind(name) == "absent") | ((kind(name) == "STRING") & o[name].isin(*allowed))
    langs = kind("targetLangs").isin("ARRAY<STRING>", "ARRAY<VOID>") & F.forall(o["targetLangs"], lambda x: F.coalesce(x.rlike(LANG), F.lit(False)))
    top = (kind("diarizeTopK") == "absent") | ((kind("diarizeTopK") == "BIGINT") & (o["diarizeTopK"] >= 1))
    ok = (kind("whisperModel") == "STRING") & o["whisperModel"].isin(*MODELS) & langs & (kind("insights") == "BOOLEAN") & (kind("diarize") == "BOOLEAN") & top & text_of("insightLanguage", INSIGHT_LANGS) & text_of("executionStrategy", STRATEGIES)
    names = [f.split()[0] for f in OPTIONS.split(", ")]
    return F.when(ok, F.struct(*((F.array_distinct(o[n]) if n == "targetLangs" else o[n]).alias(n) for n in names)))


def distinct_shas(shas: Column) -> Column:
    """Distinct hashes of a list; null if it is empty or one of them is none."""
    return F.when((F.size(shas) > 0) & F.forall(shas, lambda x: F.coalesce(x.rlike(SHA), F.lit(False))), F.array_distinct(shas))


def export_langs(langs: Column) -> Column:
    """The languages of an export as asked for; null if there is none, one repeats or one isn't valid."""
    return F.when((F.size(langs) > 0) & (F.size(F.array_distinct(langs)) == F.size(langs)) & F.forall(langs, lambda x: F.coalesce(x.rlike(EXPORT_LANG), F.lit(False))), langs)


def canonical_json(value: Column, kind: S.DataType) -> Column:
    """JSON with the keys of objects in order at every depth, so that equal values have equal texts; null fields are left out."""

    def ordered(c: Column, t: S.DataType) -> Column:
        if isinstance(t, S.StructType):
            fields = sorted(t.fields, key=lambda f: (f.name.lower(), f.name.swapcase()))
            return F.when(c.isNotNull(), F.struct(*(ordered(c[f.name], f.dataType).alias(f.name) for f in fields)))
        if isinstance(t, S.ArrayType):
            return F.transform(c, lambda x: ordered(x, t.elementType))
        return c

    return F.to_json(ordered(value, kind))


def fingerprint(rows: DataFrame, value: str, omit: tuple[str, ...] = ()) -> DataFrame:
    """rows with `fingerprint`: the hash of the canonical JSON of a struct column, without the fields in omit."""
    kind = rows.schema[value].dataType
    kind = S.StructType([f for f in kind.fields if f.name not in omit])
    return rows.withColumn("fingerprint", F.sha2(canonical_json(F.col(value), kind).cast("binary"), 256))


def shortened(text: Column, most: int) -> Column:
    """Blanks collapsed, `most` characters at most: a longer text ends with three dots."""
    t = F.trim(F.regexp_replace(text, f"{SPACE}+", " "))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 3)), F.lit("...")))


def partial_insight(reply: Column) -> Column:
    """summary, bullets and chapters of a model's JSON object, fenced or not, clamped; null if the reply is no object.

    An array is an object without fields. What has the wrong type is left out. Items are cut to the first MOST_ITEMS before blank ones go.
    """
    body = trimmed(F.regexp_replace(F.regexp_replace(trimmed(reply), r"(?i)^```(?:json)?\s*", ""), r"\s*```\s*$", ""))
    body = F.when(F.startswith(trimmed(reply), F.lit("```")), body).otherwise(trimmed(reply))
    v = F.try_parse_json(body)
    kind = lambda x: F.schema_of_variant(x)
    text = lambda x, path: F.coalesce(F.when(kind(F.variant_get(x, path, "variant")) == "STRING", F.try_variant_get(x, path, "string")), F.lit(""))
    items = lambda path: F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.expr("cast(array() as array<variant>)"))
    bullets = F.transform(F.filter(items("$.summaryBullets"), lambda x: kind(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    bullets = F.filter(F.transform(F.slice(bullets, 1, MOST_ITEMS), lambda x: shortened(x, BULLET_CHARS)), lambda x: x != "")
    start = lambda x: F.try_variant_get(x, "$.startMs", "double")
    numbered = lambda x: F.coalesce(kind(F.variant_get(x, "$.startMs", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL)") & start(x).isNotNull() & (trimmed(text(x, "$.title")) != ""), F.lit(False))
    chapter = lambda x: F.struct(F.greatest(F.lit(0), F.floor(start(x))).cast("long").alias("start_ms"), shortened(text(x, "$.title"), TITLE_CHARS).alias("title"), shortened(text(x, "$.description"), DESCRIPTION_CHARS).alias("description"))
    chapters = F.transform(F.slice(F.filter(items("$.chapters"), numbered), 1, MOST_ITEMS), chapter)
    return F.when(kind(v).rlike("^(OBJECT|ARRAY)"), F.struct(shortened(text(v, "$.summary"), SUMMARY_CHARS).alias("summary"), bullets.alias("bullets"), chapters.alias("chapters")))


def task_error(message: Column) -> Column:
    """The code of a transcription task's error, by what its message holds."""
    has = lambda words: F.greatest(*(F.contains(message, F.lit(w)).cast("int") for w in words), F.lit(0)) == 1
    return F.when(has((SENSE_ERROR,)), "SENSE_VOICE_NOT_CONFIGURED").when(has(WHISPER_ERRORS), "WHISPER_NOT_CONFIGURED").otherwise("FATAL_UNKNOWN")


def is_model_error(message: Column) -> Column:
    return F.greatest(*(F.contains(message, F.lit(w)).cast("int") for w in MODEL_ERRORS)) == 1


def fastest(measured: DataFrame, by: str) -> DataFrame:
    """by, url, bytes_per_second of the fastest url (pos: its place in the list) of each group; the first of equals, and none that is at 0."""
    best = measured.where("bytes_per_second > 0").groupBy(by).agg(F.max(F.struct("bytes_per_second", (-F.col("pos")).alias("back"), "url")).alias("b"))
    return best.select(by, "b.url", "b.bytes_per_second")


def default_view(speakers: Column, unknown: Column) -> Column:
    """grouped for two or three speakers of whom little is unknown, else list."""
    return F.when(F.coalesce((speakers > 1) & (speakers <= 3) & (unknown < 0.15), F.lit(False)), "grouped").otherwise("list")


def export(cues: DataFrame, fmt: str, timeline: DataFrame | None = None, names: DataFrame | None = None, translated: DataFrame | None = None) -> DataFrame:
    """media, content in one of five formats (vtt, srt, txt, bilingual-vtt, bilingual-srt), with speakers' names in front if a timeline is given.

    Bilingual formats need translated cues; media whose two lists don't match in number and times have no export.
    """
    writers = {"vtt": subtitles.to_vtt, "srt": subtitles.to_srt, "txt": subtitles.to_txt}
    kind = fmt.removeprefix("bilingual-")
    if kind not in writers or fmt == "bilingual-txt" or (translated is None) == fmt.startswith("bilingual-"):
        raise ValueError(f"no such export: {fmt}")
    if timeline is not None:
        cues = transcripts.speaker_lines(cues, timeline, names)
    if translated is not None:
        cues = subtitles.bilingual(cues, translated).where("ok").drop("ok")
    return writers[kind](cues)
