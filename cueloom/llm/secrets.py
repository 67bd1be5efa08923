"""Secret scans with multipart credential linking, in DataFrame functions alone.

Strong patterns are reported wherever they match. Weak candidates (identifiers, blobs, endpoints)
are common in clean text, so they are reported only where their complement lies in the same scope:
an interval join by document and position bin looks for it, and never emits pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_QUOTED_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
#: Kind: (pattern, group whose length counts, least length), in the order in which spans at the same place are listed.
STRONG = {
    "assign": ("(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")" + _QUOTED_VALUE + "([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]+", 0, 24),
}
WEAK = {
    "ident": ("(?:" + "|".join(map(_either_case, ("client_?id", "access_?id", "access_?key", "user_?name", "account_?id"))) + ")" + _QUOTED_VALUE + "([A-Za-z0-9._@-]+)", 1, 4),
    "blob": ("[A-Za-z0-9+/]{40,}={0,2}", 0, 40),
    "endpoint": (r"(?:https?|postgres|mysql|mongodb|redis|amqp|ftp)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+", 0, 12),
}
KINDS = [*STRONG, *WEAK]
IDENTIFIERS, SECRETS = ("access", "ident"), ("assign", "hex", "blob")
#: Code points between a weak candidate and its complement at most.
SCOPE = 400


def _no_spans() -> Column:
    return F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")


def spans(text: Column, kind: str) -> Column:
    """Matches of a kind that are long enough: structs of start, kind and end, in code points.

    The pieces between matches and the matches themselves alternate, so their lengths add up to
    the places. They are added up in runs of about the root of their number, and then the runs'
    sums, so that a text with very many matches doesn't copy a growing list for each of them.
    A pattern that is one run of a class needs its least length in the pattern alone.
    """
    pattern, group, least = (STRONG | WEAK)[kind]
    if group == 0 and pattern.endswith("+") and kind in STRONG:  # a maximal run: shorter ones needn't be listed
        fixed = len("AKIA") if kind == "access" else 0
        pattern = pattern[:-1] + f"{{{least - fixed},}}"
    all_ = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    sizes = lambda c: F.transform(c, F.length)
    zipped = F.arrays_zip(sizes(F.split(text, pattern, -1)).alias("piece"), sizes(all_(0)).alias("match"), sizes(all_(group)).alias("value"))
    zero = F.struct(F.lit(0).alias("at"), _no_spans().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["piece"]
        end = begin + F.coalesce(x["match"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.coalesce(x["value"] >= least, F.lit(False)), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def placed(matches: Column) -> Column:
        run = F.ceil(F.sqrt(F.size(matches))).cast("int")
        runs = F.transform(F.sequence(F.lit(1), F.size(matches), run), lambda i: F.aggregate(F.slice(matches, i, run), zero, step))
        return _let(runs, joined)

    def joined(runs: Column) -> Column:
        sums = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")), lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        moved = lambda r, by: F.transform(r["out"], lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end")))
        return F.flatten(F.zip_with(runs, sums, moved))

    return F.when(text.rlike(pattern), _let(zipped, placed)).otherwise(_no_spans())


def _let(value: Column, use) -> Column:
    """use(value), where value is worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _listed(array: Column) -> Column:
    """kind:start:end, comma-joined, by start and then kind."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(F.array_sort(array), lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_weak.

    Patterns match leftmost and without overlap, each kind by itself, over the whole text; matches
    that are too short are consumed and dropped. An identifier needs a secret in scope, a blob an
    identifier, an endpoint both; a weak candidate inside a strong span is that span. A null text
    counts as empty. Rows that repeat are scanned each and listed alike. Extra columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    found = settled(rows.select("doc_id", F.xxhash64("text").alias("key"), *(spans(text, k).alias(k) for k in KINDS)))
    base = F.concat(*(F.col(k) for k in STRONG))
    parts = found.where(reduce(lambda a, b: a | b, (F.size(k) > 0 for k in WEAK))).select("doc_id", "key", F.explode(F.concat(*map(F.col, KINDS))).alias("s")).select("doc_id", "key", "s.*").distinct()
    kinds = lambda names: F.col("kind").isin([KINDS.index(n) for n in names])
    weak = parts.where(kinds(WEAK)).withColumn("bin", F.floor(F.col("start") / (2 * scope)))
    same = lambda a: weak["doc_id"].eqNullSafe(a["a_doc"]) & (weak["key"] == a["a_key"]) & (weak["bin"] == a["a_bin"])

    def anchors(names, margin: int) -> DataFrame:
        a = parts.where(kinds(names)).select(F.col("doc_id").alias("a_doc"), F.col("key").alias("a_key"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
        bins = F.sequence(F.floor((F.col("a_start") - margin) / (2 * scope)), F.floor((F.col("a_end") + margin) / (2 * scope)))
        return a.withColumn("a_bin", F.explode(bins))

    def near(some: DataFrame, names) -> DataFrame:
        a = anchors(names, scope)
        return some.join(a, same(a) & (F.col("start") >= F.col("a_start") - scope) & (F.col("start") <= F.col("a_end") + scope), "left_semi")

    strong = anchors(STRONG, 0)
    weak = weak.join(strong, same(strong) & (F.col("start") >= F.col("a_start")) & (F.col("end") <= F.col("a_end")), "left_anti")
    linked = near(weak.where(kinds(["ident"])), SECRETS).unionByName(near(weak.where(kinds(["blob"])), IDENTIFIERS)).unionByName(near(near(weak.where(kinds(["endpoint"])), SECRETS), IDENTIFIERS))
    more = linked.groupBy(F.col("doc_id").alias("w_doc"), F.col("key").alias("w_key")).agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    all_ = found.join(more, found["doc_id"].eqNullSafe(more["w_doc"]) & (found["key"] == more["w_key"]), "left")
    every = F.concat(base, F.coalesce("more", _no_spans()))
    count = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return all_.select("doc_id", *map(count, STRONG), F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(every).alias("spans"), (F.size(every) - F.size(base)).cast("long").alias("n_weak"))
