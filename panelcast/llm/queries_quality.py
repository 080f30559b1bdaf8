"""The query on quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelcast.llm import quality
from panelcast.llm.tables import table


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return quality.judge(docs, keep=["doc_id"])
