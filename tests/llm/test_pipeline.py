"""The pipeline's stages, each against a brute-force version on what the one before it kept."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cueloom.llm import language_id
from cueloom.llm.common import settled

from ..conftest import SMALL
from .test_operators import brute_groups, words


@pytest.fixture(scope="module")
def kept(spark):
    out = {"": spark.read.parquet(f"{SMALL}/documents.parquet")}
    docs = out[""]
    for name, stage in corpus_pipeline.STAGES:
        out[name] = docs = settled(stage(spark, docs, SMALL))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(kept):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert kept[name].columns == kept[""].columns


def test_language(kept):
    before, after = rows(kept[""]), rows(kept["language_id"])
    assert all(not any(c.isalpha() for c in before[i].text or "") or len(before[i].text) < 40 for i in before.keys() - after.keys())


def test_exact(kept):
    before, after = rows(kept["language_id"]), rows(kept["exact_dedup"])
    best = {}
    for i, r in before.items():
        key = "".join((r.text or "").translate({c: None for c in (32, *range(9, 14))}))
        best[key] = max(best.get(key, (-1, 0)), (len(r.text or ""), -i))
    assert set(after) == {-i for _, i in best.values()}


def test_near(kept):
    before, after = rows(kept["exact_dedup"]), rows(kept["near_dedup"])
    groups = brute_groups([(i, r.text) for i, r in before.items()], 5, 4, 5)
    assert set(after) == {i for i, (_, c) in groups.items() if i == c}


def test_decontaminate(kept):
    before, after = rows(kept["near_dedup"]), rows(kept["decontaminate"])
    windows = {}
    for (t,) in duckdb.sql(f"SELECT text FROM '{SMALL}/benchmark.parquet'").fetchall():
        w = words(t)
        k = min(10, len(w))
        windows.setdefault(k, set()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1) if k)

    def leaks(t):
        w = words(t)
        return any(tuple(w[i : i + k]) in s for k, s in windows.items() for i in range(len(w) - k + 1))

    assert set(after) == {i for i, r in before.items() if not leaks(r.text)}


def test_encode(kept):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = rows(kept["decontaminate"])
    for r in kept["bpe"].collect():
        assert list(r.ids) == t.encode(docs[r.doc_id].text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_language_rejects_what_was_not_learned(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rng = random.Random(3)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(60))
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto"
    polish = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem"
    # a few words of each learned language, in even shares
    each = [" ".join(r.text.split()[:15]) for lang in ("de", "en", "es", "fr") for r in docs.where(f"lang = '{lang}' and length(text) > 200").orderBy("doc_id").limit(1).collect()]
    planted = spark.createDataFrame([(1, noise), (2, finnish), (3, polish), (4, " ".join(each))], "doc_id long, text string")
    crf = language_id.learn(docs)
    assert [r.doc_id for r in language_id.known_language(planted, crf).collect()] == [4]


def test_removal_where_ids_repeat(spark):
    long = " ".join(f"word{i}" for i in range(60))
    near = long.replace("word59", "other")
    rows = [(1, "a copy"), (2, "a copy"), (2, "a text of its own"), (3, "written twice"), (3, "written  twice"), (3, "written  twice"), (None, "a copy"), (None, "no id"), (None, "no id"), (4, long), (5, near), (5, "another of its own"), (None, f"{long} end")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    exact = settled(corpus_pipeline.drop_exact_copies(spark, docs, SMALL))
    key = lambda r: (r[0] or 0, r[1])
    want = [(1, "a copy"), (2, "a text of its own"), (3, "written  twice"), (None, "no id"), (4, long), (5, near), (5, "another of its own"), (None, f"{long} end")]
    assert sorted(((r.doc_id, r.text) for r in exact.collect()), key=key) == sorted(want, key=key)
    kept = corpus_pipeline.drop_near_copies(spark, exact, SMALL).collect()
    want = [(1, "a copy"), (2, "a text of its own"), (3, "written  twice"), (None, "no id"), (4, long), (5, "another of its own")]
    assert sorted(((r.doc_id, r.text) for r in kept), key=key) == sorted(want, key=key)


def test_odd_input(spark):
    """Nulls, blanks, repeats, one language alone, an empty table, and columns whose names the stages use themselves."""
    some = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("lang = 'en' and length(text) > 300").orderBy("doc_id").limit(3).collect()]
    leak = duckdb.sql(f"SELECT text FROM '{SMALL}/benchmark.parquet' ORDER BY item_id LIMIT 1").fetchall()[0][0]
    rows = [(1, None), (2, ""), (3, some[0]), (3, some[0]), (4, some[0] + " "), (None, some[1]), (5, some[2]), (5, some[2][:200]), (6, f"{some[1][:150]} {leak}")]
    more = "__mask string, mask string, digest string, row long, key0 string, __salt int"
    docs = spark.createDataFrame([(i, t, "en", "q", "q", "q", 1, "q", 1) for i, t in rows], f"doc_id long, text string, lang string, {more}")
    for given in (docs, docs.limit(0)):
        kept = given
        for name, stage in corpus_pipeline.STAGES:
            kept = settled(stage(spark, kept, SMALL))
            assert name == "bpe" or kept.columns == docs.columns
        left = sorted((r.doc_id or 0, r.n_tokens > 0) for r in kept.collect())
        assert left == ([] if given is not docs else [(0, True), (4, True), (5, True), (5, True)])


def test_a_corpus_of_long_texts_alone_is_kept(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    by_lang = docs.where("lang is not null and text is not null").groupBy("lang").agg({"text": "collect_list"}).toDF("lang", "texts").collect()
    made = [(i, ("\n".join(r.texts) + "\n") * (1 + 60_000 // len("\n".join(r.texts))), r.lang) for i, r in enumerate(by_lang)]
    long = spark.createDataFrame(made, "doc_id long, text string, lang string")
    assert all(len(t) > language_id.SAMPLE_CHARS for _, t, _ in made)
    assert sorted(language_id.learn(long).languages) == sorted(r.lang for r in by_lang)
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, long, SMALL).collect()} == {i for i, _, _ in made}


def test_the_language_found_reaches_the_result(spark):
    """Labels that are missing or wrong are set right, and the encoded rows carry them."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang is not null and length(text) > 300")
    given = {r.doc_id: r.lang for r in docs.collect()}
    odd = sorted(given)[::25]
    wrong = {i: None if n % 2 else next(x for x in sorted(set(given.values())) if x != given[i]) for n, i in enumerate(odd)}
    changed = docs.join(spark.createDataFrame(list(wrong.items()), "doc_id long, new string").withColumnRenamed("doc_id", "i"), F.col("doc_id") == F.col("i"), "left")
    changed = changed.withColumn("lang", F.when(F.col("i").isNull(), F.col("lang")).otherwise(F.col("new"))).select(docs.columns)
    found = settled(corpus_pipeline.identify_language(spark, changed, SMALL))
    assert found.columns == docs.columns
    assert {r.doc_id: r.lang for r in found.collect()} == given
    assert {r.doc_id: r.lang for r in corpus_pipeline.encode(spark, found, SMALL).collect()} == given
