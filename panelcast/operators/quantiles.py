"""Exact quantiles and histograms of a whole column without one task holding it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Cells per stretch inside a bracket.
CELLS = 512


def exact_quantiles(df: DataFrame, value: str, probs: list[float], accuracy: int = 50_000):
    """Interpolated quantiles (rank ``p * (n - 1)``) of all rows, as one array row.

    A mergeable sketch brackets each wanted rank to within n / accuracy rows. Distinct values
    with their counts are ranked inside the brackets only. Of the values in a gap between
    brackets, only the first and the last are kept apart: with few rows, where the sketch is
    exact, a wanted rank may be the neighbour of a bracket's edge. The result is exact, the
    sketch just decides what need not be ranked.

    Ranks come from two levels: values fall into cells (equal parts of each bracket), the few
    cells are summed in order, and each cell ranks its own values.
    Returns columns ``n`` and ``quantiles``.
    """
    slack = 2.0 / accuracy
    edges = [(max(p - slack, 0.0), min(p + slack, 1.0)) for p in probs]
    sketch = F.percentile_approx(value, [b for pair in edges for b in pair], accuracy)
    summary = df.agg(F.struct(F.count(value).alias("n"), sketch.alias("b"))).scalar()
    rows = (
        df.where(F.col(value).isNotNull())
        .groupBy(F.col(value).alias("v"))
        .agg(F.count("*").alias("c"))
        .withColumn("s", summary)
    )
    inside = F.lit(False)
    for i in range(len(probs)):
        inside = inside | F.col("v").between(F.col("s.b")[2 * i], F.col("s.b")[2 * i + 1])
    # Bracket edges below the value number both the gaps and the stretches inside brackets.
    below = F.size(F.filter("s.b", lambda b: b < F.col("v")))
    marked = rows.select("v", "c", "s", inside.alias("inside"), below.alias("below"))
    left = F.coalesce(F.array_max(F.filter("s.b", lambda b: b < F.col("v"))), F.array_min("s.b"))
    right = F.coalesce(F.array_min(F.filter("s.b", lambda b: b >= F.col("v"))), F.array_max("s.b"))
    part = F.floor((F.col("v") - left) / F.nullif(right - left, F.lit(0.0)) * CELLS).cast("int")
    kept = marked.where("inside").select("v", "c", "below", F.coalesce(part, F.lit(0)).alias("cell"))
    gaps = (
        marked.where("NOT inside")
        .groupBy("below")
        .agg(
            F.min(F.struct("v", "c")).alias("lo"),
            F.max(F.struct("v", "c")).alias("hi"),
            F.sum("c").alias("all"),
        )
    )
    # A gap's middle is counted at its last value: first and last rank are right.
    ends = F.array(
        F.struct(F.col("lo.v").alias("v"), F.col("lo.c").alias("c")),
        F.struct(F.col("hi.v").alias("v"), (F.col("all") - F.col("lo.c")).alias("c")),
    )
    skipped = gaps.select(F.inline(ends), "below", F.lit(-1).alias("cell")).where("c > 0")
    counted = kept.unionByName(skipped)
    place = ["below", "cell"]
    cells = counted.groupBy(*place).agg(F.sum("c").alias("in_cell"))
    earlier = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        *place,
        F.coalesce(F.sum("in_cell").over(earlier), F.lit(0)).alias("before"),
        F.sum("in_cell").over(Window.partitionBy()).alias("n"),
    )
    own = Window.partitionBy(*place).orderBy("v")
    running = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.select("v", *place, F.sum("c").over(running).alias("within")).join(offsets, place)
    ranked = ranked.select("v", "n", (F.col("before") + F.col("within")).alias("upto"))
    picks = []
    for p in probs:
        rank = F.lit(p) * (F.col("n") - 1)
        low = F.min(F.when(F.col("upto") > F.floor(rank), F.col("v")))
        high = F.min(F.when(F.col("upto") > F.ceil(rank), F.col("v")))
        picks.append(low + (high - low) * F.max(rank - F.floor(rank)))
    return ranked.agg(F.max("n").alias("n"), F.array(*picks).alias("quantiles"))


def bin_index(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin number from 0; the last bin is closed on both sides."""
    width = (hi - lo) / F.lit(float(bins))
    raw = F.floor((value - lo) / F.nullif(width, F.lit(0.0))).cast("int")
    return F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1))


def histogram(df: DataFrame, value: str, bins: int, *keys: str, bounds: Column | None = None):
    """Counts per key and bin over ``bounds`` (struct lo, hi; default: min and max).

    Only bins that hold rows are returned, with their left edge.
    """
    if bounds is None:
        bounds = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    v = F.col(value)
    # The lower and upper bound are read from one subquery result.
    rows = df.withColumn("_b", bounds).where(v.between(F.col("_b.lo"), F.col("_b.hi")))
    lo, hi = F.col("_b.lo"), F.col("_b.hi")
    return (
        rows.withColumn("bin", bin_index(v, lo, hi, bins))
        .groupBy(*keys, "bin")
        .agg(F.count("*").alias("n"), F.any_value("_b").alias("_b"))
        .select(*keys, "bin", (lo + F.col("bin") * ((hi - lo) / float(bins))).alias("left_edge"), "n")
    )
