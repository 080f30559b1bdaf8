"""Readings of the nearest station, as of each day."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.schema import DATE, KEYS, STORE
from panelcast.session import stage

#: The finest cells hold at most this many stations, unless that takes over MOST_HALVINGS halvings.
CROWDED, MOST_HALVINGS = 64, 20


def _cell(value: str, size: float):
    return F.floor(F.col(value) / F.lit(size)).cast("long")


def nearest_stations(places: DataFrame, stations: DataFrame, key: str = STORE) -> DataFrame:
    """``key, station_id, distance`` (in degrees, straight): the nearest station of every place with a
    position; of equally near ones the smallest id.

    Both sides are put on a grid. A place meets the stations of its own and the eight cells around
    it by an equi-join, and is settled if the best of them is no farther than a cell is wide, since
    nothing nearer can lie outside. The others go on with cells twice as wide. The first grid is
    fine enough that no cell is crowded; stations at one position count as one.
    """
    known = stations.where("lat IS NOT NULL AND lon IS NOT NULL")
    spots = known.groupBy("lat", "lon").agg(F.min("station_id").alias("station_id"))
    todo = places.where("lat IS NOT NULL AND lon IS NOT NULL").select(key, "lat", "lon")
    names = [f"{f}({c})" for f in ("min", "max") for c in ("lat", "lon")]
    box = spots.select("lat", "lon").unionByName(todo.select("lat", "lon")).selectExpr(*names, "count(*)").first()
    n = spots.count()
    out = todo.select(key, F.lit(None).cast(dict(spots.dtypes)["station_id"]).alias("station_id"), F.lit(0.0).alias("distance")).limit(0)
    if not n or box[4] == 0:
        return out
    extent = max(box[2] - box[0], box[3] - box[1], 1e-9)
    size = extent / math.sqrt(n)
    for _ in range(MOST_HALVINGS):
        fullest = spots.groupBy(_cell("lat", size), _cell("lon", size)).count().agg(F.max("count")).first()[0]
        if fullest <= CROWDED:
            break
        size /= 2
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    while True:
        there = spots.select("station_id", F.col("lat").alias("y"), F.col("lon").alias("x"), _cell("lat", size).alias("r"), _cell("lon", size).alias("c"))
        cells = todo.select(key, "lat", "lon", around.alias("dr")).select("*", around.alias("dc"))
        cells = cells.select(key, "lat", "lon", (_cell("lat", size) + F.col("dr")).alias("r"), (_cell("lon", size) + F.col("dc")).alias("c"))
        far = F.sqrt(F.pow(F.col("lat") - F.col("y"), 2) + F.pow(F.col("lon") - F.col("x"), 2))
        best = cells.join(there, ["r", "c"]).groupBy(key).agg(F.min(F.struct(far.alias("distance"), "station_id")).alias("b"))
        last = size >= extent  # every station is in the cells around any place
        found = best.select(key, "b.station_id", "b.distance", (F.lit(last) | (F.col("b.distance") <= size)).alias("final"))
        found = stage(found, "nearest")
        settled = found.where("final").drop("final")
        out = out.unionByName(settled)
        if last:
            return out
        todo = stage(todo.join(settled, key, "left_anti"), "nearest-left")
        if todo.isEmpty():
            return out
        size *= 2


def readings_as_of(requests: DataFrame, readings: DataFrame) -> DataFrame:
    """``station_id, date, value, read_on``: the latest reading up to the end of each requested day.

    Readings are first reduced to the last one of a station's day, so a busy station is bounded by
    the calendar. Requests and readings are then one sorted sequence per station, and a request takes the
    last value before it: no join by time. A day before a station's first reading has nulls. Of
    readings at one moment the greatest value counts.
    """
    daily = readings.where("value IS NOT NULL").groupBy("station_id", F.to_date("ts").alias(DATE))
    daily = daily.agg(F.max(F.struct("ts", "value"))["value"].alias("value"))
    wanted = requests.select("station_id", DATE).distinct()
    both = daily.select("station_id", DATE, "value", F.col(DATE).alias("read_on"), F.lit(0).alias("asked")).unionByName(
        wanted.select("station_id", DATE, F.lit(None).cast("double").alias("value"), F.lit(None).cast("date").alias("read_on"), F.lit(1).alias("asked"))
    )
    before = Window.partitionBy("station_id").orderBy(DATE, "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = both.select(
        "station_id", DATE, "asked",
        F.last("value", ignorenulls=True).over(before).alias("value"),
        F.last("read_on", ignorenulls=True).over(before).alias("read_on"),
    )
    return filled.where("asked = 1").drop("asked")


def add_weather(panel: DataFrame, places: DataFrame, stations: DataFrame, readings: DataFrame) -> DataFrame:
    """The panel with ``station_id``, ``distance``, ``weather`` and ``weather_age`` in days; null for
    stores without a position."""
    rows = panel.join(nearest_stations(places, stations), STORE, "left")
    found = readings_as_of(rows.where("station_id IS NOT NULL"), readings)
    joined = rows.join(found, ["station_id", DATE], "left")
    kept = [c for c in panel.columns if c not in KEYS]
    return joined.select(
        *KEYS, *kept, "station_id", "distance", F.col("value").alias("weather"), F.datediff(DATE, "read_on").alias("weather_age")
    )
