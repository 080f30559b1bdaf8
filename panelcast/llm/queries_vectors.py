"""The query on embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import whitening
from panelcast.llm.tables import table


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each usable vector's whitened components, one row for each."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    white = whitening.whiten(vectors, whitening.fit(vectors), keep=["vec_id"])
    parts = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "part")
    rows = white.select("vec_id", "n", "deviation", "identity_error", parts)
    return rows.select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        "n",
        F.col("deviation").try_cast("bigint").alias("deviation"),
        "part.whitened",
        "part.explained",
        "identity_error",
    )
