"""A training-data pipeline over ``documents``: five stages, each one operator of panelcast.llm.

Every stage works on all rows that its predecessor kept, and all but the last return the columns
of documents. Nulls, repeated rows, empty texts and empty tables are handled as each operator
defines. SQL cannot express the outlier, random-token and rounding stages, so there is no
``ORACLE_SQL``; the tests compare with brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import bpe, ngram_join, quality, secret_scan, source_mix
from panelcast.session import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates: shingles of five words, a similarity of 0.8 or more; its many signatures in parts.
NEAR = ngram_join.Rule(words=5, num=8, den=10, passes=3)
RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and are no outliers of their language and source."""
    return quality.judge(docs.select(COLUMNS)).where("kept").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of alike ones; documents without an id all
    stay. Of rows that share an id, the smallest by text, language, source and length stays."""
    found = ngram_join.groups(docs, rule=NEAR, tidy=True)
    first = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    alike = docs.select(COLUMNS).join(first, "doc_id", "left_semi")
    least = F.min(F.struct("text", "lang", "source", "n_chars"))
    kept = alike.groupBy("doc_id").agg(least.alias("row")).select("doc_id", "row.*").select(COLUMNS)
    return kept.unionByName(docs.select(COLUMNS).where("doc_id IS NULL"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark and their length corrected."""
    marked = secret_scan.scan(docs.select(COLUMNS), secret_scan.train(docs))
    found = F.size("spans") > 0
    clean = secret_scan.redact(marked.withColumn("found", found))
    length = F.when(F.col("found"), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length).select(COLUMNS)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target needs it."""
    return source_mix.repeat(source_mix.mix(docs.select(COLUMNS)), COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their number and whether they decode to the text."""
    kept = ["doc_id", "lang", "source", "text"]
    both = bpe.encode_and_decode(docs, RANK_FILE, public_tokenizers.PATTERN, keep=kept)
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return both.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == whole).alias("round_trip"),
        "ids",
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("source_weights", source_weights),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as a table and read back by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
