"""The queries on secrets and personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import pii, secret_scan
from panelcast.llm.tables import table


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text: counts and digest of the fixed formats, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(docs)).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"] != secret_scan.RANDOM_KIND)
    counts = [_count("spans", kind) for kind in secret_scan.BASE_KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("spans")).alias("spans"),
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text: counts and digest of the fixed formats, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs)).select("doc_id", "base_spans", "spans")
    return found.select(
        "doc_id",
        *[_count("base_spans", kind) for kind in pii.KINDS],
        F.sha2(secret_scan.spans_text(F.col("base_spans")), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("spans")).alias("spans"),
    )
