"""The query on near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelcast.llm import ngram_join
from panelcast.llm.tables import table


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document."""
    return ngram_join.groups(table(spark, sf_dir, "documents"))
