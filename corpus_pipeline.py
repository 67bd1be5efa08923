"""A training-data pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm import language_id
from cueloom.llm.bpe import bpe_encode
from cueloom.llm.common import among, clearing, free_name, release, settled, small_batches, table, without
from cueloom.llm.decontaminate import clean_documents
from cueloom.llm.exact_dedup import exact_dedup, text_digest
from cueloom.llm.near_dedup import near_groups


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and blank texts among them), or with words of none of the languages for the most part, go.

    lang becomes the language that the text is in by its words: a missing label is filled, a wrong one
    corrected, and all stages after this one carry it. The languages are learned from the documents'
    own labels; without any label all documents go. Rows that repeat go or stay alike, and copies of a
    text have one language. Extra columns are carried along; an empty table stays empty.
    """
    small_batches(spark)
    crf = language_id.learn(docs)
    release()  # what the driver learned from
    return language_id.known_language(docs, crf, label="lang")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays: the longest, then the least doc_id (null last), then the least row in its JSON form.

    So of rows that are one document written several times one stays, and rows that share a doc_id
    are told apart by their texts. A null text counts as an empty one. Columns stay as they were.
    """
    small_batches(spark)
    names = docs.columns
    digest, row = free_name(names, "digest"), free_name(names, "row")
    marked = docs.withColumn(digest, F.unhex(text_digest(F.col("text"))))
    verdicts = settled(exact_dedup(docs).select("doc_id", F.unhex("text_sha256").alias("digest"), "kept"))
    left = without(marked, verdicts.where("not kept"), {"doc_id": "doc_id", digest: "digest"})
    repeated = settled(verdicts.where("kept").groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1"))
    if repeated.isEmpty():
        return left.select(names)
    keys = {"doc_id": "doc_id", digest: "digest"}
    whole = F.struct(*names)
    one = among(left, repeated, keys, "left_semi").groupBy("doc_id", digest).agg(F.min_by(whole, F.struct(-F.length("text"), F.to_json(whole))).alias(row))
    return without(left, repeated, keys).select(names).unionByName(one.select(f"{row}.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more; the least doc_id of the group.

    Null and blank texts are alike to nothing and stay. Rows that share an id or have none are
    documents of their own, numbered after all ids. Columns stay as they were; an empty table stays empty.
    """
    small_batches(spark)
    names = docs.columns
    number = free_name(names, "row")
    repeated = settled(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null"))
    if repeated.isEmpty():
        return without(docs, near_groups(docs).where("not kept"), {"doc_id": "doc_id"})
    odd = among(docs, repeated, {"doc_id": "doc_id"}, "left_semi")
    top = F.lit(docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)).cast("long")).first()[0])
    rows = settled(without(docs, repeated, {"doc_id": "doc_id"}).withColumn(number, F.col("doc_id").cast("long")).unionByName(odd.withColumn(number, top + 1 + F.monotonically_increasing_id())))
    groups = near_groups(rows.select(F.col(number).alias("doc_id"), "text"))
    return without(rows, groups.where("not kept"), {number: "doc_id"}).select(names)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item (ten words; of a shorter item all its words) go.

    Null and blank texts hold none and stay; rows that repeat go or stay alike. Columns stay as they were.
    """
    small_batches(spark)
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and lang of each document: a row for each row of docs. A null text has no ids."""
    small_batches(spark)
    return bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"), carry=("lang",))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, over the whole documents table. What a stage wrote on the way is deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with clearing(spark):
            docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The first stage is a learned model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None
