"""A corpus from raw documents to pieces: five stages, each over all that the stage before it kept.

Rows are judged by what they hold, not by doc_id alone: documents without doc_id
are judged like any other. Rows that share a doc_id and differ in their text are
judged one by one by the first stage and the second, and stay or go together in the third. Repeated rows are copies of
one document. Nulls in any column, empty and very long texts, empty tables and
more columns (whatever their names) are taken by every stage; see the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import own_name, store, table
from tidemark.llm.linededup import MIN_CHARS, dedup_lines
from tidemark.llm.mixing import poisson_mix
from tidemark.llm.nearcopies import near_copies
from tidemark.llm.pieces import default_model, encode
from tidemark.llm.quality import quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Each row is carried through, so that it meets its own verdict."""
    whole = docs.select("doc_id", "lang", "source", F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    return quality_rules(whole, keep=("row",), text="row.text").where("kept").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, or are one edit from one, go; no document does. Lines under 12 characters, mostly structure, stay."""
    return dedup_lines(docs, min_exact=MIN_CHARS)


#: Documents without doc_id are numbered from here, by a hash of their text, so that they come last.
UNNAMED = 2**62


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of their five-word shingles alike) the document with the smallest doc_id stays, one row of it."""
    key, again = own_name(docs, "_id"), own_name(docs, "_again")
    unnamed = F.lit(UNNAMED) + F.xxhash64("text").bitwiseAND(F.lit(UNNAMED - 1))
    marked = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("bigint"), unnamed))
    found = near_copies(marked.select(F.col(key).alias("doc_id"), "text"))
    first = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(f"{key}_")).agg((F.count("*") > 1).alias(again))
    stay = marked.join(store(first, "kept"), F.col(key) == F.col(f"{key}_"))
    # Rows of one document and text are copies; nearly all documents are one row and aren't shuffled for it.
    text = own_name(stay, "_text")
    copies = stay.where(F.col(again)).withColumn(text, F.md5("text")).dropDuplicates([key, text])
    return stay.where(~F.col(again)).select(*docs.columns).unionByName(copies.select(*docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out to bring the sources to their target weights."""
    return poisson_mix(docs).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and ids of each remaining copy."""
    return encode(docs, default_model())


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near), ("mixing", mix), ("pieces", encode_pieces)]

#: SQL can't express robust covariance fits or piece merges; tests/llm hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store(docs, name.replace(" ", "-"))
    return docs
