"""Text and time-code functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def two_digits(n: Column, width: int = 2) -> Column:
    """Left-padded with zeros, and never cut."""
    s = n.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def clock(ms: Column, mark: str | None = ".") -> Column:
    """HH:MM:SS, with `mark` and milliseconds unless mark is None; hours may have more than two digits."""
    whole = [two_digits(F.floor(ms / 3_600_000)), two_digits(F.floor(ms % 3_600_000 / 60_000)), two_digits(F.floor(ms % 60_000 / 1000))]
    text = F.concat_ws(":", *whole)
    return text if mark is None else F.concat(text, F.lit(mark), two_digits(ms % 1000, 3))


def clock_ms(text: Column) -> Column:
    """Milliseconds of H:MM:SS or MM:SS, a fraction dropped; null for anything else."""
    p = F.split(F.regexp_replace(text, r"\.\d*$", ""), ":")
    n = lambda i: F.try_element_at(p, F.lit(i)).try_cast("long")
    return F.when(F.size(p) == 3, ((n(1) * 60 + n(2)) * 60 + n(3)) * 1000).when(F.size(p) == 2, (n(1) * 60 + n(2)) * 1000)


#: The ranges that count as a token each.
CJK = r"[\u3400-\u9fff\uf900-\ufaff\u3040-\u30ff\uac00-\ud7af]"
#: White space, as the estimate counts it and as texts are trimmed of it.
BLANKS = r"\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = rf"[\t-\r {BLANKS}]"
#: The same but for the line feed.
IN_LINE = rf"[\t\x0B-\r {BLANKS}]"


def trimmed(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.regexp_replace(text, rf"^{SPACE}++|(?<!{SPACE}){SPACE}++$", "")


def token_estimate(text: Column) -> Column:
    """max(1, ceil(cjk + ascii word characters / 3 + punctuation + white space / 8), ceil(characters / 2))."""
    n, cjk, word, space = F.length(text), F.regexp_count(text, F.lit(CJK)), F.regexp_count(text, F.lit("[A-Za-z0-9_]")), F.regexp_count(text, F.lit(SPACE))
    aware = F.ceil(cjk + word / 3 + (n - cjk - word - space) + space / 8)
    return F.greatest(F.lit(1), aware, F.ceil(n / 2)).cast("long")


def dominant_language(text: Column) -> Column:
    """ja if there is any kana, else ko, zh or en by which script is there; null if none is."""
    has = lambda r: text.rlike(r)
    return F.when(has(r"[\u3040-\u30ff]"), "ja").when(has(r"[\uac00-\ud7af]"), "ko").when(has(r"[\u4e00-\u9fff]"), "zh").when(has("[A-Za-z]"), "en")


def strip_control_tags(text: Column) -> Column:
    """Without <|...|> that holds neither a bar nor a closing bracket."""
    return F.regexp_replace(text, r"<\|[^|>]*\|>", "")


def strip_think(text: Column) -> Column:
    """Without think blocks; an unclosed one goes to the end. Trimmed."""
    return trimmed(F.regexp_replace(text, r"(?s)<think>.*?(</think>|$)", ""))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def compact(text: Column, most: int) -> Column:
    """At most `most` characters, the last three of a longer text being dots."""
    t = collapse_space(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 3)), F.lit("...")))


def sentence_case(text: Column) -> Column:
    """Where 60 % or more of the ASCII letters are capitals: lower case, but for a-z at the start and after the end of a sentence."""
    letters, capitals = F.regexp_count(text, F.lit("[A-Za-z]")), F.regexp_count(text, F.lit("[A-Z]"))
    pieces = F.split(F.regexp_replace(F.lower(text), rf"([.!?]{SPACE}++)", "$1\x01"), "\x01")
    first = lambda p: F.substring(p, 1, 1)
    up = F.transform(pieces, lambda p: F.concat(F.when(first(p).rlike("[a-z]"), F.upper(first(p))).otherwise(first(p)), F.substring(p, 2, 1 << 30)))
    return F.when((letters > 0) & (capitals >= 0.6 * letters), F.array_join(up, "")).otherwise(text)


def fnv1a(text: Column) -> Column:
    """FNV-1a of 32 bits over UTF-16 units, eight hex digits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    pair = lambda c: F.array(F.lit(0xD800) + F.shiftright(c - 0x10000, 10), F.lit(0xDC00) + (c - 0x10000).bitwiseAND(F.lit(0x3FF)))
    units = F.flatten(F.transform(codes, lambda c: F.when(c < 0x10000, F.array(c)).otherwise(pair(c))))
    h = F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c.cast("long")) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where the product of their norms is under 1e-12."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm < 1e-12, 0.0).otherwise(dot(a, b) / norm)


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(done / total * 100 + 0.5)).otherwise(0).cast("int")


def safe_name(name: Column, sha: Column) -> Column:
    """name without its extension and with a line for each run of what file systems forbid; media- and eight digits of sha where nothing is left."""
    stem = trimmed(F.regexp_replace(F.coalesce(name, F.lit("")), r"\.[^.]+$", ""))
    safe = F.regexp_replace(stem, r'[/\\:*?"<>|]+', "_")
    return F.when(safe != "", safe).otherwise(F.concat(F.lit("media-"), F.substring(sha, 1, 8)))


def bytes_text(n: Column) -> Column:
    """n bytes in decimal units: two places from a GB, one from a KB; halves are rounded up."""

    def unit(size: int, places: int, name: str) -> Column:
        parts = F.floor((n + size // 10**places // 2) / (size // 10**places)).cast("long")
        return F.concat(F.floor(parts / 10**places).cast("string"), F.lit("."), two_digits(parts % 10**places, places), F.lit(f" {name}"))

    return F.when(n >= 10**9, unit(10**9, 2, "GB")).when(n >= 10**6, unit(10**6, 1, "MB")).when(n >= 10**3, unit(10**3, 1, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def duration_text(seconds: Column) -> Column:
    """M:SS, or H:MM:SS from an hour; empty for null, negative and infinite values."""
    s = F.floor(seconds)
    hours, minutes, rest = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), two_digits((s % 60).cast("long"))
    text = F.when(hours > 0, F.concat_ws(":", hours.cast("string"), two_digits(minutes), rest)).otherwise(F.concat_ws(":", minutes.cast("string"), rest))
    usable = seconds.isNotNull() & ~F.isnan(seconds) & (seconds >= 0) & (seconds < float("inf"))
    return F.when(usable, text).otherwise("")


#: Starts of paths that must not leave a machine.
RAW_PATH = r"""(^|["'\s])(/Users/|/tmp/|[A-Za-z]:\\)[^"'\s]+"""


def has_raw_path(text: Column) -> Column:
    return text.rlike(RAW_PATH)


def detected_language(output: Column) -> Column:
    """The code that a tool's output names as auto-detected, in lower case; null if it names none."""
    found = F.regexp_extract(output, r"(?i)auto-detected language:\s*([a-z]{2,3})\b", 1)
    return F.lower(F.nullif(found, F.lit("")))
