"""Exploratory profile of the inputs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions import scalar
from panelcast.operators.quantiles import exact_quantiles, histogram
from panelcast.schema import DATE, KEYS, STORE, TARGET


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def null_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Null count per table and column; each table is read once."""
    out = []
    for name, df in tables.items():
        one = df.agg(
            F.count("*").alias("n_rows"),
            *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns],
        )
        pairs = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c))])
        out.append(
            one.select(F.lit(name).alias("table_name"), "n_rows", F.explode(pairs).alias("column_name", "n_null"))
        )
    return union_all(out)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Rows beyond the first of each key."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("c"))
    return per_key.agg(
        F.sum("c").alias("n_rows"),
        F.count("*").alias("n_keys"),
        F.sum(F.col("c") - 1).alias("n_duplicate_rows"),
    )


def cardinality(columns: dict[str, tuple[DataFrame, str]], approximate: bool = False) -> DataFrame:
    """Distinct values per named column; exact by default."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return union_all(
        [
            df.agg(count(F.col(c)).alias("n_distinct")).select(F.lit(name).alias("variable"), "n_distinct")
            for name, (df, c) in columns.items()
        ]
    )


def value_counts(columns: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows and share per value of each named column, nulls left out."""
    out = []
    for name, (df, c) in columns.items():
        rows = df.where(F.col(c).isNotNull())
        total = rows.agg(F.count("*")).scalar()
        out.append(
            rows.groupBy(F.col(c).cast("string").alias("value"))
            .agg(F.count("*").alias("n"))
            .select(F.lit(name).alias("variable"), "value", "n", (F.col("n") / total).alias("share"))
        )
    return union_all(out)


def describe(df: DataFrame, value: str = TARGET) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum in one row."""
    moments = df.agg(
        F.count(value).alias("n_values"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75]).select("quantiles").scalar()
    return moments.withColumn("q", q).select(
        "n_values", "mean", "std", "min",
        F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max",
    )


def sample_skewness(value):
    """Bias-corrected sample skewness (Spark's own is the population form)."""
    n = F.count(value).cast("double")
    return F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2)


def skew(df: DataFrame, value: str = TARGET) -> DataFrame:
    v = F.col(value)
    return df.agg(
        sample_skewness(v).alias("skew_raw"), sample_skewness(F.log1p(v)).alias("skew_log1p")
    )


def mean_by(df: DataFrame, key, name: str, value: str = TARGET) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(
        F.avg(value).alias("mean_visitors"), F.count("*").alias("n")
    )


def mean_by_weekday(visits: DataFrame) -> DataFrame:
    """Mean target by weekday name, with its Monday-first number."""
    dow = scalar.day_of_week(F.col(DATE))
    return visits.groupBy(dow.alias("dow"), F.date_format(DATE, "EEEE").alias("day_name")).agg(
        F.avg(TARGET).alias("mean_visitors"), F.count("*").alias("n")
    )


def mean_by_holiday(visits: DataFrame, holidays: DataFrame) -> DataFrame:
    joined = visits.join(holidays.select(DATE, "is_holiday"), DATE, "left")
    return mean_by(joined, F.col("is_holiday"), "is_holiday")


def target_histogram(visits: DataFrame, bins: int = 60, value: str = TARGET) -> DataFrame:
    """Histograms of the target and of its log1p."""
    raw = histogram(visits, value, bins).withColumn("scale", F.lit("raw"))
    logged = histogram(visits.select(F.log1p(value).alias("_log")), "_log", bins)
    return raw.unionByName(logged.withColumn("scale", F.lit("log1p")))


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise Pearson correlation, long form, from one aggregation over the rows.

    Each pair ignores rows where either side is null. Every pair of columns appears once.
    """
    pairs = list(combinations(columns, 2))
    return _correlations(df, pairs)


def correlation_with(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """Correlation of each column with the target, strongest absolute value first."""
    long = _correlations(df, [(c, target) for c in columns])
    return long.select(
        F.col("left").alias("feature"), "corr", F.abs("corr").alias("abs_corr")
    )


def _correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``left, right, corr`` per pair. Each task sums deviations from its own means over whole batches
    and hands on one row per pair; tasks are merged with the distances of their means."""
    columns = sorted({c for pair in pairs for c in pair})
    at = [(columns.index(a), columns.index(b)) for a, b in pairs]
    rows = df.select(*[F.col(c).cast("double") for c in columns])
    parts = rows.mapInArrow(lambda it: _moments(it, at), _MOMENTS)
    # A pair without any row still has its line.
    none = df.sparkSession.range(len(pairs)).select(F.col("id").cast("int").alias("i"), *[F.lit(0.0).alias(c) for c in _SUMS])
    listed = parts.unionByName(none).groupBy("i").agg(F.sort_array(F.collect_list(F.struct(*_SUMS))).alias("parts"))
    merged = listed.select("i", F.aggregate("parts", F.struct(*[F.lit(0.0).alias(c) for c in _SUMS]), _together).alias("m"))
    corr = F.when(F.col("m.n") > 1, F.col("m.xy") / F.sqrt(F.col("m.xx") * F.col("m.yy")))
    left, right = (F.array(*[F.lit(pair[k]) for pair in pairs]) for k in (0, 1))
    return merged.select(F.get(left, F.col("i")).alias("left"), F.get(right, F.col("i")).alias("right"), corr.alias("corr"))


_SUMS = ("n", "x", "y", "xx", "yy", "xy")
_MOMENTS = "i int, " + ", ".join(f"{c} double" for c in _SUMS)


def _together(a: Column, b: Column) -> Column:
    """Two parts' counts, means and sums of products of deviations, as one."""
    n = F.greatest(a["n"] + b["n"], F.lit(1.0))
    share, between = b["n"] / n, a["n"] * b["n"] / n
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    values = {"n": a["n"] + b["n"], "x": a["x"] + dx * share, "y": a["y"] + dy * share}
    for name, product in (("xx", dx * dx), ("yy", dy * dy), ("xy", dx * dy)):
        values[name] = a[name] + b[name] + product * between
    return F.struct(*[v.alias(c) for c, v in values.items()])


def _moments(batches: Iterator[pa.RecordBatch], at: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """A task's counts, means and sums of products of deviations, per pair, of the rows where both are known."""
    left, right = np.array(at).T
    total = np.zeros((6, len(at)))
    with np.errstate(all="ignore"):
        for batch in batches:
            if not batch.num_rows:
                continue
            known = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
            x = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns])
            first = x[known.argmax(0), np.arange(x.shape[1])]
            both = known[:, left] & known[:, right]
            n = both.sum(0).astype(float)
            share = np.maximum(n, 1.0)
            # From the first value, so that equal values have no deviation at all.
            a, b = (np.where(both, x[:, k] - first[k], 0.0) for k in (left, right))
            mean_a, mean_b = a.sum(0) / share, b.sum(0) / share
            a, b = np.where(both, a - mean_a, 0.0), np.where(both, b - mean_b, 0.0)
            own = [n, first[left] + mean_a, first[right] + mean_b, (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)]
            own = np.where(n > 0, own, 0.0)
            sums = np.maximum(total[0] + n, 1.0)
            dx, dy = own[1] - total[1], own[2] - total[2]
            between = total[0] * n / sums
            total[1:3] += np.stack([dx, dy]) * n / sums
            total[3:] += own[3:] + np.stack([dx * dx, dy * dy, dx * dy]) * between
            total[0] += n
    columns = [pa.array(np.arange(len(at), dtype=np.int32)), *map(pa.array, total)]
    yield pa.RecordBatch.from_arrays(columns, ["i", *_SUMS])


def _gram(batches: Iterator[pa.RecordBatch], p: int) -> Iterator[pa.RecordBatch]:
    """A task's sums over all pairs of columns, of the rows where both are known."""
    total = np.zeros((6, p, p))
    for batch in batches:
        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
        known = ~np.isnan(x)
        x, m = np.where(known, x, 0.0), known.astype(float)
        square = x * x
        total += np.stack([m.T @ m, x.T @ m, m.T @ x, square.T @ m, m.T @ square, x.T @ x])
    i, j = np.triu_indices(p, 1)
    columns = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *[pa.array(t[i, j]) for t in total]]
    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _GRAM.split(", ")])


_GRAM = "i int, j int, n double, x double, y double, xx double, yy double, xy double"


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """``left, right, n, corr`` of every pair of columns, from one pass over the rows.

    Each task multiplies whole batches, so the cost is that of a matrix product however many columns
    there are, and hands on one row per pair. A pair takes the rows where both sides are known;
    without two different values on both it has no correlation.
    """
    rows = df.select(*[F.col(c).cast("double") for c in columns])
    parts = rows.mapInArrow(lambda it: _gram(it, len(columns)), _GRAM)
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    n, names = F.col("n"), F.array(*map(F.lit, columns))

    def spread(square: str, total: str) -> Column:
        value = n * F.col(square) - F.col(total) * F.col(total)
        return F.when(value > 1e-12 * n * F.col(square), value)  # less is rounding

    joint = n * F.col("xy") - F.col("x") * F.col("y")
    return sums.select(
        F.element_at(names, F.col("i") + 1).alias("left"),
        F.element_at(names, F.col("j") + 1).alias("right"),
        n.cast("long").alias("n"),
        (joint / F.sqrt(spread("xx", "x")) / F.sqrt(spread("yy", "y"))).alias("corr"),
    )


def reservation_lift(visits: DataFrame, daily: DataFrame) -> DataFrame:
    """Share of store days with bookings, and the booking/target correlation on them."""
    joined = visits.join(daily.select(*KEYS, "reserve_visitors"), list(KEYS), "left").withColumn(
        "reserve_visitors", F.coalesce(F.col("reserve_visitors"), F.lit(0.0))
    )
    booked = F.col("reserve_visitors") > 0
    return joined.agg(
        F.count("*").alias("n_days"),
        F.count_if(booked).alias("n_reserved_days"),
        F.avg(booked.cast("double")).alias("reserved_share"),
        F.corr(F.when(booked, F.col("reserve_visitors")), F.when(booked, F.col(TARGET))).alias(
            "corr_reserved"
        ),
        F.avg(F.when(booked, F.col(TARGET))).alias("mean_reserved"),
        F.avg(F.when(~booked, F.col(TARGET))).alias("mean_unreserved"),
    )


def sample_rows(df: DataFrame, n: int, *keys: str, seed: int = 0) -> DataFrame:
    """At most ``n`` random rows (a sampling operator; a plot's worth): those whose keys have the
    smallest digests under the seed, whatever the partitioning."""
    named = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return df.orderBy(F.md5(named.cast("binary")), *keys).limit(n)


def first_stores(df: DataFrame, n: int = 2) -> DataFrame:
    """The smallest ``n`` store ids, as a report samples stores."""
    return df.select(STORE).distinct().orderBy(STORE).limit(n)
