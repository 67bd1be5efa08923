"""Toxicity: a weighted lexicon, learned from labels and matched by Aho-Corasick in folded text.

Folding undoes accents, homoglyphs and digit substitutions, so one entry matches all spellings. An
entry matches at the start of a word. Matches inside an exception phrase don't count. The weights
that match, alone and normalised by the text's length, give the score through a logistic curve.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, settled

#: The most labelled documents of each class that the lexicon is learned from, chosen by a hash of their ids.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
LEXICON_SIZE, EXCEPTIONS_SIZE = 2000, 1000
#: An entry needs this log odds ratio, and as many standard errors of it.
LEAST_WEIGHT, LEAST_Z = 1.5, 2.75
PREFIXES = (4, 5, 6, 7, 8, 24)

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ß": "ss", "ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe",
}
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s"}
#: Characters that are not seen.
UNSEEN = "­​‌‍⁠﻿"


def _fold_table() -> dict[int, str]:
    table = {}
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)).lower() if not unicodedata.combining(c))
        if plain and plain.isascii():
            table[cp] = plain
    table |= {ord(k): v for k, v in (HOMOGLYPHS | SUBSTITUTES).items()} | {ord(c): "" for c in UNSEEN} | {cp: "" for cp in range(0x300, 0x370)}
    table |= {cp: "".join(table.get(ord(c), c) for c in v) for cp, v in table.items()}
    # "1" stands for l as for i, so these are one letter
    return {cp: v.replace("l", "i") for cp, v in table.items()} | {ord("l"): "i"}


_TABLE = _fold_table()
_SIGN, _WORD = re.compile(r"[@$](?=\w)"), re.compile(r"\w+")


def fold(text: str) -> str:
    text = text.lower()
    if "@" in text or "$" in text:
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return text.translate(_TABLE)


@dataclass
class Lexicon:
    """weights: entries (folded starts of words) and their log odds; exceptions: folded phrases; curve: bias and slopes of the score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    curve: tuple[float, float, float] = (0.0, 1.0, 0.0)

    def automaton(self):
        a = ahocorasick.Automaton()
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), None))
        for entry, w in self.weights.items():
            a.add_word(entry, (len(entry), w))
        if len(a):
            a.make_automaton()
        return a


def matches(automaton, text: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, weight) of the entries in folded text that start a word and lie in no exception phrase, by their ends.

    One sweep: a match waits until no exception that could cover it can still end, and an exception
    that ends takes away the waiting matches that it covers.
    """
    if not len(automaton):
        return
    longest = automaton.get_stats()["longest_word"]
    waiting: deque = deque()
    spared = (0, 0)  # the last exception: of those that end at one place the longest comes first, and before shorter matches
    for last, (n, weight) in automaton.iter(text):
        start, end = last + 1 - n, last + 1
        while waiting and waiting[0][1] + longest < end:
            yield waiting.popleft()
        if start and text[start - 1].isalnum():
            continue
        if weight is not None:
            if end != spared[1] or start < spared[0]:
                waiting.append((start, end, weight))
        elif end == len(text) or not text[end].isalnum():
            if end != spared[1]:
                spared = start, end
            for _ in range(len(waiting)):  # at most those of one phrase's length
                m = waiting.popleft()
                if m[0] < start:
                    waiting.append(m)
    yield from waiting


def features(automaton, text: str) -> tuple[float, float, int]:
    """log(1 + weight), log(1 + weight for each 100 words), matches."""
    folded = fold(text)
    total, n = 0.0, 0
    for _, _, w in matches(automaton, folded):
        total, n = total + w, n + 1
    return (math.log1p(total), math.log1p(100 * total / max(1, folded.count(" ") + 1)), n) if n else (0.0, 0.0, 0)


def _counted(rows: DataFrame, terms) -> DataFrame:
    """For each of terms(text): how many toxic and clean documents of rows (text, toxic) have it. A task's counts are handed on when many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            batch = pa.RecordBatch.from_pydict({"term": pa.array(names, pa.string()), "toxic": pa.array([counts[1][x] for x in names], pa.int64()), "clean": pa.array([counts[0][x] for x in names], pa.int64())})
            counts[0].clear(), counts[1].clear()
            return batch

        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[toxic].update(terms(text or ""))
                if len(counts[0]) + len(counts[1]) > 300_000:
                    yield out()
        yield out()

    return rows.mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn(docs: DataFrame, labels: DataFrame, n_toxic: int = SAMPLE_TOXIC, n_clean: int = SAMPLE_CLEAN) -> Lexicon:
    """A lexicon from the whole texts of at most n_toxic and n_clean labelled documents.

    A document with several labels is toxic if one says so; rows with a null id or label teach
    nothing. Without labels of both classes the lexicon is empty and the score is the share of toxic ones.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pick = lambda c, n: known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = pick(1, n_toxic).unionByName(pick(0, n_clean))  # at most n_toxic + n_clean rows
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = settled(text.join(F.broadcast(ids), "doc_id").select("text", "toxic").dropDuplicates())  # a copied text teaches once
    sampled = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    t, c = sampled.get(1, 0), sampled.get(0, 0)
    prior = math.log((total.get(1, 0) + 0.5) / (total.get(0, 0) + 0.5))
    if not t or not c:
        return Lexicon(curve=(prior, 0.0, 0.0))

    def starts(text: str) -> set[str]:
        return {w[:k] for w in set(_WORD.findall(fold(text))) for k in PREFIXES if k <= len(w) or k == PREFIXES[-1] and len(w) > 2}

    z = lambda d: d.withColumn("w", F.log((F.col("toxic") + 0.5) / (t + 1)) - F.log((F.col("clean") + 0.5) / (c + 1))).withColumn("z", F.col("w") / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5)))
    # ordered by the lower bound of the log odds; of entries as good as each other the longest is the most exact
    best = z(_counted(rows, starts)).where((F.col("w") >= LEAST_WEIGHT) & (F.col("z") >= LEAST_Z)).orderBy(F.desc(F.col("w") - F.col("w") / F.col("z")), F.desc(F.length("term")), "term").limit(2 * LEXICON_SIZE).collect()
    weights: dict[str, float] = {}
    for r in best:  # an entry makes longer and shorter ones needless
        if len(weights) < LEXICON_SIZE and not any(r["term"][:k] in weights for k in PREFIXES) and not any(e.startswith(r["term"]) for e in weights):
            weights[r["term"]] = float(r["w"])
    lexicon = Lexicon(weights)

    # phrases and curve come from the texts that chose the entries: the sample is all that is read
    automaton = lexicon.automaton()

    def around(text: str) -> set[str]:
        folded, out = fold(text), set()
        for start, _, _ in matches(automaton, folded):
            word = re.match(r"\w*", folded[start:])[0]
            if m := re.search(r"(\w+ )$", folded[max(0, start - 32) : start]):
                out.add(m[1] + word)
            if m := re.match(r"( \w+)", folded[start + len(word) : start + len(word) + 32]):
                out.add(word + m[1])
        return out

    spare = z(_counted(rows, around)).where((F.col("clean") >= 5) & (F.col("w") <= -1)).orderBy("w", "term").limit(EXCEPTIONS_SIZE).collect()
    lexicon.exceptions = {r["term"] for r in spare}
    measured = _mapped(rows.select(F.lit(0).cast("long").alias("doc_id"), "text", "toxic"), lexicon, "toxic").select("toxic", "a", "b").toPandas()
    x = np.stack([np.ones(len(measured)), measured["a"], measured["b"]], 1).astype(float)
    y = measured["toxic"].to_numpy(float)
    beta = np.zeros(3)
    for _ in range(25):  # Newton's method with a slight pull to zero
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.1, 0.1])
        beta += np.linalg.solve(h, x.T @ (y - p) - np.array([0, 0.1, 0.1]) * beta)
    lexicon.curve = (float(beta[0]) + prior - math.log(t / c), float(beta[1]), float(beta[2]))
    return lexicon


def _mapped(rows: DataFrame, lexicon: Lexicon, *carry: str) -> DataFrame:
    """rows (doc_id, text, ...) with the features a and b, the matches and the score of each text."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)
    more = [rows.columns.index(c) for c in carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, (bias, one, two) = shared.value.automaton(), shared.value.curve
        for b in batches:
            got = [features(automaton, t.as_py() or "") for t in b.column(1)]
            f = np.array(got, float).reshape(-1, 3)
            score = 1 / (1 + np.exp(-np.clip(bias + one * f[:, 0] + two * f[:, 1], -40, 40)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(i) for i in more), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(f[:, 2].astype(np.int64)), pa.array(score)], names=["doc_id", *carry, "a", "b", "matches", "score"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(["doc_id long", *(f"{c} {kinds[c]}" for c in carry), "a double, b double, matches long, score double"]))


def toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 if score >= 0.5), matches.

    A null or empty text matches nothing and has the score of such texts. Rows that repeat are scored
    each; extra columns are ignored; texts of any length are scored whole; no rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _mapped(rows, lexicon).select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "matches")


def held_out(col: str = "doc_id"):
    return crc_bucket(col, 5) == 0
