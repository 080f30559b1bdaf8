"""The query on source weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import source_mix
from panelcast.llm.tables import table


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their source's target and the words that the mix takes of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = source_mix.mix(docs, columns=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
