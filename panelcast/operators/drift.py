"""Per-store drift: two windows compared by mergeable sketches, and a change statistic over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions import scalar
from panelcast.operators.entities import weekday_split
from panelcast.schema import DATE, STORE, TARGET

#: Bins per factor e of (1 + target): the sketch's resolution.
BINS_PER_E = 2


def target_bin(value: Column) -> Column:
    return F.floor(F.log1p(F.greatest(value.cast("double"), F.lit(0.0))) * BINS_PER_E).cast("int")


def sketch(visits: DataFrame, recent: Column) -> DataFrame:
    """Counts per store and bin of the reference rows (``base``) and of the ``recent`` ones.

    Fixed bins make sketches of different parts of the data add up, so they can be kept per day
    or file and summed; a store has a few dozen bins, however many rows it has.
    """
    inside = recent.cast("int")
    return visits.groupBy(STORE, target_bin(F.col(TARGET)).alias("bin")).agg(
        F.sum(1 - inside).alias("base"), F.sum(inside).alias("recent")
    )


def compare(sketches: DataFrame) -> DataFrame:
    """Per store the rows of both windows, the population stability index and the greatest
    difference of the distribution functions.

    Shares are smoothed by half a row per bin in use. A store missing from a window has null for both.
    """
    bins = F.array_sort(F.collect_list(F.struct("bin", "base", "recent"))).alias("bins")
    rows = sketches.groupBy(STORE).agg(bins, F.sum("base").alias("n_base"), F.sum("recent").alias("n_recent"))
    size = F.size("bins")
    shares = F.transform(
        "bins",
        lambda b: F.struct(
            ((b["base"] + 0.5) / (F.col("n_base") + 0.5 * size)).alias("p"),
            ((b["recent"] + 0.5) / (F.col("n_recent") + 0.5 * size)).alias("q"),
            (b["recent"] / F.col("n_recent") - b["base"] / F.col("n_base")).alias("d"),
        ),
    )
    rows = rows.where((F.col("n_base") > 0) & (F.col("n_recent") > 0)).select(STORE, shares.alias("x")).join(
        rows.select(STORE, "n_base", "n_recent"), STORE, "right"
    )
    index = F.aggregate("x", F.lit(0.0), lambda a, s: a + (s["q"] - s["p"]) * F.log(s["q"] / s["p"]))
    start = F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("most"))

    def further(a: Column, s: Column) -> Column:
        at = a["at"] + s["d"]
        return F.struct(at.alias("at"), F.greatest(a["most"], F.abs(at)).alias("most"))

    return rows.select(
        STORE, "n_base", "n_recent", index.alias("stability_index"),
        F.aggregate("x", start, further, lambda a: a["most"]).alias("distance"),
    )


def residuals(visits: DataFrame, recent: Column) -> DataFrame:
    """Recent targets minus the store's weekday mean in the reference rows, over the spread that the
    reference rows have around theirs. Stores or weekdays without reference rows have none."""
    rows = visits.select(STORE, DATE, F.col(TARGET).cast("double").alias(TARGET), scalar.day_of_week(F.col(DATE)).alias("dow"), recent.alias("r"))
    value = F.when(~F.col("r"), F.col(TARGET))
    levels = rows.groupBy(STORE).agg(
        weekday_split(value, F.col("dow"), F.avg).alias("mean"),
        weekday_split(value, F.col("dow"), F.var_pop).alias("var"),
        weekday_split(value, F.col("dow"), F.count).alias("n"),
    )
    both = F.arrays_zip("var", "n")
    square = F.aggregate(both, F.lit(0.0), lambda a, d: a + F.coalesce(d["var"] * d["n"], F.lit(0.0)))
    total = F.aggregate("n", F.lit(0).cast("bigint"), lambda a, n: a + n)
    levels = levels.select(STORE, "mean", F.sqrt(square / F.nullif(total, F.lit(0))).alias("spread"))
    mean = F.element_at("mean", F.col("dow") + 1)
    z = (F.col(TARGET) - mean) / F.nullif("spread", F.lit(0.0))
    return rows.where("r").join(levels, STORE).select(STORE, DATE, z.alias("z")).where("z IS NOT NULL")


def change_points(scores: DataFrame, slack: float = 0.5, limit: float = 8.0) -> DataFrame:
    """Two-sided cumulative sums of each store's scores (``store_id, date, z``).

    Per store the greatest upward and downward sums, each started anew at zero, and the first day on
    which one exceeds ``limit`` (with the defaults, normal scores without a change do so about once in
    ten thousand days). A store's scores are one array, bounded by the calendar.
    """
    series = scores.groupBy(STORE).agg(F.array_sort(F.collect_list(F.struct(DATE, "z"))).alias("s"))
    zero = F.lit(0.0)
    start = F.struct(
        zero.alias("up"), zero.alias("down"), zero.alias("most_up"), zero.alias("most_down"), F.lit(None).cast("date").alias("first")
    )

    def step(a: Column, e: Column) -> Column:
        up = F.greatest(zero, a["up"] + e["z"] - slack)
        down = F.greatest(zero, a["down"] - e["z"] - slack)
        over = (up > limit) | (down > limit)
        return F.struct(
            up.alias("up"),
            down.alias("down"),
            F.greatest(a["most_up"], up).alias("most_up"),
            F.greatest(a["most_down"], down).alias("most_down"),
            F.coalesce(a["first"], F.when(over, e[DATE])).alias("first"),
        )

    folded = series.select(STORE, F.aggregate("s", start, step).alias("c"))
    return folded.select(
        STORE, F.col("c.most_up").alias("rise"), F.col("c.most_down").alias("fall"), F.col("c.first").alias("first_alarm")
    )


def monitor(visits: DataFrame, since, slack: float = 0.5, limit: float = 8.0) -> DataFrame:
    """Both statistics per store, for the rows from ``since`` on against those before.

    Every store of the panel has a row; statistics that a store has no rows for are null.
    """
    recent = F.col(DATE) >= F.lit(since)
    found = compare(sketch(visits, recent))
    alarms = change_points(residuals(visits, recent), slack, limit)
    return found.join(alarms, STORE, "left").withColumn("drifted", F.col("first_alarm").isNotNull())
