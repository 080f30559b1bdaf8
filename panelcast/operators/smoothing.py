"""Exponentially weighted means that only look back: ``e = rate * y + (1 - rate) * e`` day by day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.schema import DATE, STORE, TARGET

RATES = (0.1, 0.3)
#: Days of a block; the powers of (1 - rate) stay within doubles inside one for rates up to 0.9.
BLOCK = 256
#: Earlier blocks that can still matter to a double, for rates from 0.05.
REACH = 4


def ewm_column(rate: float) -> str:
    return f"ewm_{round(100 * rate)}"


def ewm_rates(columns: Sequence[str]) -> tuple[float, ...]:
    """The rates whose columns are among the given names, in their order."""
    return tuple(int(c[4:]) / 100 for c in columns if c.startswith("ewm_") and c[4:].isdigit())


def _check(rates: Sequence[float]) -> None:
    if not all(0.05 <= r <= 0.9 for r in rates):
        raise ValueError("rates must lie between 0.05 and 0.9")


def add_ewm(dense: DataFrame, rates: Sequence[float] = RATES, target: str = TARGET) -> DataFrame:
    """``ewm_r`` per rate on a gap-free daily grid: the mean of the days before, weighted by age.

    The first day's value starts the recurrence, so the first day itself has none. The recurrence is
    unrolled inside blocks of ``BLOCK`` days of a store, where it is a running sum of scaled values;
    a block begins with what the last ones left. All windows run on the store placement of the grid.
    """
    _check(rates)
    base = dense.columns
    by_day = Window.partitionBy(STORE).orderBy(DATE)
    rows = dense.withColumn("_i", F.row_number().over(by_day) - 1)
    rows = rows.withColumns({"_b": F.floor(F.col("_i") / BLOCK), "_j": F.col("_i") % BLOCK})
    inside = Window.partitionBy(STORE, "_b").orderBy(DATE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for rate in rates:
        keep = 1.0 - rate
        # The first day counts in full, since there is nothing to mix it with.
        weight = F.when(F.col("_i") == 0, 1.0).otherwise(rate)
        scaled = F.sum(F.col(target) * weight * F.pow(F.lit(1.0 / keep), F.col("_j"))).over(inside)
        rows = rows.withColumn(f"_own_{ewm_column(rate)}", scaled * F.pow(F.lit(keep), F.col("_j")))
    # The value a block ends with stands on its last day, j + 1 rows back; earlier ones a block further.
    ends = {}
    for rate in rates:
        own = F.collect_list(F.when(F.col("_j") == BLOCK - 1, F.col(f"_own_{ewm_column(rate)}"))).over(by_day.rowsBetween(Window.unboundedPreceding, -1))
        ends[f"_ends_{ewm_column(rate)}"] = F.slice(F.reverse(own), 1, REACH)
    rows = rows.withColumns(ends)
    after = {}
    for rate in rates:
        keep = 1.0 - rate
        carried = F.aggregate(
            F.transform(f"_ends_{ewm_column(rate)}", lambda e, k: e * F.pow(F.lit(keep), k * BLOCK)), F.lit(0.0), lambda a, e: a + e  # noqa: B023
        )
        after[f"_after_{ewm_column(rate)}"] = F.col(f"_own_{ewm_column(rate)}") + carried * F.pow(F.lit(keep), F.col("_j") + 1)
    rows = rows.withColumns(after)
    return rows.select(*base, *[F.lag(f"_after_{ewm_column(r)}").over(by_day).alias(ewm_column(r)) for r in rates])


def ewm_state(dense: DataFrame, rates: Sequence[float] = RATES) -> DataFrame:
    """Per store the values that its next day will have, as an array in the order of ``rates``."""
    following = dense.groupBy(STORE).agg(F.max(DATE).alias(DATE))
    extra = following.select(STORE, F.date_add(DATE, 1).alias(DATE), F.lit(0.0).alias(TARGET))
    grid = dense.select(STORE, DATE, TARGET).unionByName(extra)
    last = F.max_by(F.array(*[ewm_column(r) for r in rates]), DATE).alias("_ewm")
    return add_ewm(grid, rates).groupBy(STORE).agg(last)


def next_ewm(state: Column, value: Column, rates: Sequence[float] = RATES) -> Column:
    """The state a day later; a store without any day starts with the value."""
    parts = [
        F.coalesce(F.lit(r) * value + F.lit(1.0 - r) * F.get(state, F.lit(i)), value) for i, r in enumerate(rates)
    ]
    return F.array(*parts)
