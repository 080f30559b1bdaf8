"""Temporal validation: date boundaries, and rows assigned to folds without a join."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.functions import scalar
from panelcast.operators.panel import place_by_store
from panelcast.schema import DATE, KEYS, STORE, TARGET


@dataclass(frozen=True)
class Split:
    """Train on ``date <= train_end``; validate on ``valid_start .. valid_end``."""

    fold: int
    train_end: date
    valid_start: date
    valid_end: date


def rolling_origin_splits(
    last: date, n_folds: int, horizon: int, stride: int | None = None
) -> list[Split]:
    """Expanding windows, earliest first; a missing or zero stride tiles by the horizon."""
    offsets = range((n_folds - 1) * (stride or horizon), -1, -(stride or horizon))

    def back(days: int) -> date:
        return last - timedelta(days=days)

    return [
        Split(k, back(age + horizon), back(age + horizon - 1), back(age))
        for k, age in enumerate(offsets)
    ]


def final_holdout(last: date, horizon: int) -> Split:
    """The last ``horizon`` days, carved off before any cross-validation."""
    return rolling_origin_splits(last, 1, horizon)[0]


def splits_frame(spark: SparkSession, splits: list[Split]) -> DataFrame:
    rows = [(s.fold, s.train_end, s.valid_start, s.valid_end) for s in splits]
    return spark.createDataFrame(
        rows, "fold int, train_end date, valid_start date, valid_end date"
    )


def _split_literals(splits: list[Split]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(s.fold).alias("fold"),
                F.lit(s.train_end).alias("train_end"),
                F.lit(s.valid_start).alias("valid_start"),
                F.lit(s.valid_end).alias("valid_end"),
            )
            for s in splits
        ]
    )


def _fan_out(df: DataFrame, splits: list[Split], wanted, *columns: str) -> DataFrame:
    """Repeat each row once per fold that wants it, inside the task (splits are literals)."""
    chosen = F.filter(_split_literals(splits), wanted)
    return df.withColumn("_split", F.explode(chosen)).select(
        *[F.col(f"_split.{c}").alias(c) for c in columns], *df.columns
    )


def trailing_rows(df: DataFrame, splits: list[Split], days: int) -> DataFrame:
    """Rows of each fold within ``days`` days up to its cutoff; adds fold and train_end."""
    d = F.col(DATE)
    first = min(s.train_end for s in splits) - timedelta(days=days)
    last = max(s.train_end for s in splits)
    return _fan_out(
        df.where(d.between(F.lit(first), F.lit(last))),
        splits,
        lambda s: (d <= s["train_end"]) & (d >= F.date_sub(s["train_end"], days)),
        "fold",
        "train_end",
    )


def valid_rows(df: DataFrame, splits: list[Split]) -> DataFrame:
    """Observed rows of each fold's validation window; adds fold and train_end."""
    d = F.col(DATE)
    first, last = min(s.valid_start for s in splits), max(s.valid_end for s in splits)
    return _fan_out(
        df.where(d.between(F.lit(first), F.lit(last))),
        splits,
        lambda s: d.between(s["valid_start"], s["valid_end"]),
        "fold",
        "train_end",
    )


def train_rows(df: DataFrame, split: Split) -> DataFrame:
    return df.where(F.col(DATE) <= F.lit(split.train_end))


def first_fold(splits: list[Split]) -> Column:
    """Index of the earliest split whose training slice holds the row (splits in order)."""
    earlier = F.filter(_split_literals(splits), lambda s: s["train_end"] < F.col(DATE))
    return F.size(earlier)


def folds_from(splits: list[Split], start: Column) -> Column:
    """Fold labels of the splits at position ``start`` and later."""
    labels = F.array(*[F.lit(s.fold) for s in splits])
    return F.slice(labels, start + 1, F.lit(len(splits)))


def fold_slices(visits: DataFrame, splits: list[Split]) -> DataFrame:
    """Train and validation row counts and targets per fold.

    Rows are first counted by (earliest training fold, day), which is bounded by the
    calendar; only those counts are repeated over the folds.
    """
    daily = visits.groupBy(DATE).agg(F.count("*").alias("n"), F.sum(TARGET).alias("total"))
    last = max(s.valid_end for s in splits)
    labelled = daily.where(F.col(DATE) <= F.lit(last)).withColumn(
        "_split", F.explode(_split_literals(splits))
    )
    s, d = F.col("_split"), F.col(DATE)
    in_train = d <= s["train_end"]
    in_valid = d.between(s["valid_start"], s["valid_end"])
    return labelled.groupBy(s["fold"].alias("fold")).agg(
        F.coalesce(F.sum(F.when(in_train, F.col("n"))), F.lit(0)).alias("train_rows"),
        F.coalesce(F.sum(F.when(in_valid, F.col("n"))), F.lit(0)).alias("valid_rows"),
        F.sum(F.when(in_train, F.col("total"))).alias("train_total"),
        F.sum(F.when(in_valid, F.col("total"))).alias("valid_total"),
    )


def fold_levels(visits: DataFrame, splits: list[Split]) -> DataFrame:
    """Mean levels of every fold's own training slice, one row per (fold, store).

    Training slices nest, so a store's days are reduced to one row of sums per earliest fold, and
    these are added up in place: a running row holds from its fold to the one before the store's
    next. Only the days are exchanged. Also carries the slice's first and last observed day, total
    and count.
    """
    splits = sorted(splits, key=lambda s: s.train_end)
    dow, value = scalar.day_of_week(F.col(DATE)), F.col(TARGET)
    kept = visits.where(F.col(DATE) <= F.lit(splits[-1].train_end)).select(STORE, DATE, TARGET)
    parts = {"all": value, **{d: F.when(dow == d, value) for d in range(7)}}
    sums = (
        place_by_store(kept)
        .groupBy(STORE, first_fold(splits).alias("_from"))
        .agg(
            F.min(DATE).alias("_first"),
            F.max(DATE).alias("_last"),
            *[F.count(v).alias(f"_n_{k}") for k, v in parts.items()],
            *[F.sum(v).alias(f"_sum_{k}") for k, v in parts.items()],
        )
    )
    own = Window.partitionBy(STORE).orderBy("_from")
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = sums.select(
        STORE,
        "_from",
        F.lead("_from").over(own).alias("_next"),
        F.min("_first").over(so_far).alias("first_day"),
        F.max("_last").over(so_far).alias("last_day"),
        *[F.sum(f"_{c}_{k}").over(so_far).alias(f"_{c}_{k}") for c in ("n", "sum") for k in parts],
    )

    def mean(k):
        return F.col(f"_sum_{k}") / F.nullif(F.col(f"_n_{k}"), F.lit(0))

    until = F.coalesce("_next", F.lit(len(splits)))
    labels = F.slice(F.array(*[F.lit(s.fold) for s in splits]), F.col("_from") + 1, until - F.col("_from"))
    return running.select(
        F.explode(labels).alias("fold"),
        STORE,
        "first_day",
        "last_day",
        F.col("_sum_all").alias("total"),
        mean("all").alias("store_mean"),
        F.array(*[mean(d) for d in range(7)]).alias("_dow_mean"),
    )


def _sorted_mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return total / F.nullif(F.size(values), F.lit(0))


def _sorted_median(values: Column) -> Column:
    """Median of an ascending array of any length; null when empty."""
    n = F.size(values)
    low, high = F.floor((n + 1) / 2).cast("int"), F.floor((n + 2) / 2).cast("int")
    return F.when(n > 0, (F.get(values, low - 1) + F.get(values, high - 1)) / 2)


def fold_profiles(visits: DataFrame, splits: list[Split]) -> DataFrame:
    """Means and exact medians of every fold's training slice, one row per (fold, store).

    Medians of nested slices cannot be merged, but they need no repeated rows either: a
    store's values are gathered once, sorted by value, each with the earliest fold that
    trains on it. A fold's slice is a filter of that array and is still sorted. The array
    is bounded by the calendar. Also carries the slice's last observed day.
    """
    splits = sorted(splits, key=lambda s: s.train_end)
    value = F.col(TARGET).cast("double")
    item = F.struct(value.alias("v"), F.col("_from").alias("f"))
    dow = scalar.day_of_week(F.col(DATE))
    rows = visits.where(F.col(DATE) <= F.lit(splits[-1].train_end)).withColumn(
        "_from", first_fold(splits)
    )
    days = F.struct(F.col(DATE).alias("d"), F.col("_from").alias("f"))
    gathered = rows.groupBy(STORE).agg(
        F.collect_list(days).alias("_days"),
        F.sort_array(F.collect_list(F.when(value.isNotNull(), item))).alias("_all"),
        F.array(
            *[
                F.sort_array(F.collect_list(F.when(value.isNotNull() & (dow == d), item)))
                for d in range(7)
            ]
        ).alias("_by_dow"),
    )

    def known(items, i):
        return F.transform(F.filter(items, lambda x: x["f"] <= i), lambda x: x["v"])

    labels = F.array(*[F.lit(s.fold) for s in splits])

    def slice_of(i):
        days = F.filter("_days", lambda x: x["f"] <= i)
        return F.struct(
            F.get(labels, i).alias("fold"),
            F.array_max(F.transform(days, lambda x: x["d"])).alias("last_day"),
            known(F.col("_all"), i).alias("_values"),
            F.transform("_by_dow", lambda items: known(items, i)).alias("_dow_values"),
        )

    slices = F.transform(F.sequence(F.lit(0), F.lit(len(splits) - 1)), slice_of)
    per_fold = gathered.select(STORE, F.inline(slices)).where(F.col("last_day").isNotNull())
    return per_fold.select(
        "fold",
        STORE,
        "last_day",
        _sorted_mean(F.col("_values")).alias("store_mean"),
        _sorted_median(F.col("_values")).alias("store_median"),
        F.transform("_dow_values", _sorted_mean).alias("_dow_mean"),
        F.transform("_dow_values", _sorted_median).alias("_dow_median"),
    )


def last_days(visits: DataFrame, splits: list[Split]) -> DataFrame:
    """One row per store: of every fold that trains on it, the fold and the slice's last observed day, as ``_folds``."""
    kept = visits.where(F.col(DATE) <= F.lit(max(s.train_end for s in splits)))
    ends = [F.max(F.when(F.col(DATE) <= F.lit(s.train_end), F.col(DATE))) for s in splits]
    per_store = kept.groupBy(STORE).agg(*[end.alias(f"_last_{i}") for i, end in enumerate(ends)])
    folds = F.array(*[F.struct(F.lit(s.fold).alias("fold"), F.col(f"_last_{i}").alias("last_day")) for i, s in enumerate(splits)])
    return per_store.select(STORE, F.filter(folds, lambda f: f["last_day"].isNotNull()).alias("_folds"))


def fold_entity_stats(visits: DataFrame, splits: list[Split]) -> DataFrame:
    """The per-fold store levels in long form: one row per (fold, store, weekday seen)."""
    wide = fold_profiles(visits, splits)
    position = F.sequence(F.lit(0), F.lit(6))
    return (
        wide.withColumn("dow", F.explode(position))
        .withColumn("store_dow_mean", F.element_at("_dow_mean", F.col("dow") + 1))
        .withColumn("store_dow_median", F.element_at("_dow_median", F.col("dow") + 1))
        .where(F.col("store_dow_mean").isNotNull())
        .select(
            "fold", STORE, "dow",
            "store_mean", "store_median", "store_dow_mean", "store_dow_median",
        )
    )
