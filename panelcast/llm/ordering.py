"""Placing rows in one total order, so that every row meets its successor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_order(docs: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows placed and sorted by descending ``key`` (null last), with what follows each block.

    Blocks are ranges of the key between approximate quantiles. The first row of each block is
    also sent, as ``context``, to the end of the block before it, and the very first row to the
    very last block, so each task sees every row's successor. Only block bounds reach the driver.
    """
    spark = docs.sparkSession
    number = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.coalesce(F.col(key), F.lit(-(2**63))).cast("long")
    rows = docs.select(*columns, order.alias("order"))
    ids = rows.select("order")
    cuts = ids.approxQuantile("order", [i / number for i in range(1, number)], 1 / (2 * number))
    inner = sorted(set(cuts)) or [0.0]
    splits = [float("-inf"), *inner, float("inf")]
    bucket = Bucketizer(splits=splits, inputCol="order_value", outputCol="block")

    def placed(df: DataFrame) -> DataFrame:
        return bucket.transform(df.withColumn("order_value", F.col("order").cast("double"))).drop("order_value")

    firsts = placed(ids).groupBy("block").agg(F.max("order").alias("first")).orderBy("block").collect()
    if not firsts:
        return rows.withColumns({"block": F.lit(0.0), "context": F.lit(False)})
    # Block i's successor is the first row of the next lower block; the lowest's, the first of all.
    after = [(firsts[i - 1]["first"], firsts[i]["block"]) for i in range(len(firsts))]
    extra = F.broadcast(spark.createDataFrame(after, "order long, before double"))  # one row per block
    copies = rows.join(extra, "order").select(*columns, "order", F.col("before").alias("block"), F.lit(True).alias("context"))
    own = placed(rows).select(*columns, "order", "block", F.lit(False).alias("context"))
    both = own.unionByName(copies)
    tie = F.xxhash64(*columns)
    return both.repartition("block").sortWithinPartitions("block", "context", F.desc("order"), tie)
