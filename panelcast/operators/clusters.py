"""Location clusters: a fitted feature stage that groups stores by where they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.splits import Split, train_rows
from panelcast.schema import STORE


class LocationClusters:
    """Means of ``k`` groups of positions, found by moving each to the mean of the stores nearest to it.

    The first centres are the stores whose ids have the smallest digests, so a fit depends neither
    on row order nor on chance. A step is one aggregation over the stores with ``k`` rows out; centres,
    ``k`` pairs of numbers, are all that the driver holds. A centre that no store is nearest to
    stays. Stores without a position get no cluster, and there may be fewer stores than centres.
    """

    def __init__(self, k: int = 8, most_steps: int = 25) -> None:
        self.k = k
        self.most_steps = most_steps
        self.centres: list[tuple[float, float]] = []

    def fit(self, stores: DataFrame) -> LocationClusters:
        known = stores.where("lat IS NOT NULL AND lon IS NOT NULL").select(
            F.col(STORE).cast("string").alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")
        )
        first = known.orderBy(F.md5(F.col("id").cast("binary")), "id", "lat", "lon").limit(self.k)
        self.centres = [(r["lat"], r["lon"]) for r in first.collect()]
        for _ in range(self.most_steps):
            means = known.groupBy(self.nearest().alias("cluster")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
            moved = list(self.centres)
            for r in means.collect():
                moved[r["cluster"]] = (r["lat"], r["lon"])
            if moved == self.centres:
                break
            self.centres = moved
        return self

    def nearest(self) -> Column:
        """The number of the nearest centre, from 0; of equally near ones the first."""
        far = [
            F.struct((F.pow(F.col("lat") - y, 2) + F.pow(F.col("lon") - x, 2)).alias("d"), F.lit(i).alias("i"))
            for i, (y, x) in enumerate(self.centres)
        ]
        return F.array_min(F.array(*far))["i"] if far else F.lit(None).cast("int")

    def assign(self, stores: DataFrame) -> DataFrame:
        """The stores with ``location_cluster``."""
        known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
        return stores.withColumn("location_cluster", F.when(known, self.nearest()))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, y, x) for i, (y, x) in enumerate(self.centres)]
        spark.createDataFrame(rows, "cluster int, lat double, lon double").coalesce(1).write.mode("overwrite").parquet(path)

    def load(self, spark: SparkSession, path: str) -> LocationClusters:
        rows = spark.read.parquet(path).orderBy("cluster").collect()
        self.k, self.centres = len(rows), [(r["lat"], r["lon"]) for r in rows]
        return self


def fold_clusters(stores: DataFrame, visits: DataFrame, split: Split, k: int = 8) -> DataFrame:
    """``store_id, location_cluster`` of all stores, by centres of those that the fold's training slice
    has seen."""
    seen = train_rows(visits, split).select(STORE).distinct()
    model = LocationClusters(k).fit(stores.join(seen, STORE, "left_semi"))
    return model.assign(stores).select(STORE, "location_cluster")
