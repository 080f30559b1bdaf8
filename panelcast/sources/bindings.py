"""Binds the star-schema parquet tables to the canonical panel inputs.

Suppliers play the stores, shipped quantity per day the demand, order lines the bookings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.bookings import daily_bookings_mixed
from panelcast.schema import DATE, STORE, TARGET, PanelData
from panelcast.sources.tables import reservations_from

# Days of the derived calendar after the last visit, for forecasts.
CALENDAR_AHEAD = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_suppkey").alias(STORE),
            F.to_date("l_shipdate").alias(DATE),
            F.col("l_quantity").alias(TARGET),
        )
        .groupBy(STORE, DATE)
        .agg(F.sum(TARGET).alias(TARGET))
    )


def nation_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second, denser panel: orders per customer nation and day."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias(DATE))
    nations = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias(STORE))
    # Orders are first counted per customer and day, so a busy customer is one row per day.
    per_customer = orders.groupBy("o_custkey", DATE).agg(F.count("*").alias("n"))
    return (
        per_customer.join(nations, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(STORE, DATE)
        .agg(F.sum("n").cast("double").alias(TARGET))
    )


def booking_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as a booking: odd lines name their store, even ones a foreign id. A line
    may be shipped before its order's date, so a lead time may be negative."""
    foreign = F.col("l_linenumber") % 2 == 0
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"),
        F.col("l_orderkey") == F.col("o_orderkey"),
    )
    return lines.select(
        F.when(foreign, F.col("l_partkey")).otherwise(F.col("l_suppkey")).alias("id"),
        foreign.alias("is_foreign"),
        F.col("l_shipdate").alias("visit_datetime"),
        F.col("o_orderdate").alias("reserve_datetime"),
        F.col("l_quantity").cast("bigint").alias("reserve_visitors"),
    )


def store_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_stores = table(spark, sf_dir, "supplier").agg(F.count("*")).scalar()
    parts = table(spark, sf_dir, "part").where(F.col("p_size") <= 25)
    return parts.select((F.col("p_partkey") % n_stores).alias(STORE), F.col("p_partkey").alias("hpg_store_id"))


def booking_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(direct bookings, bookings with a foreign id, foreign id -> store relation)."""
    lines = booking_lines(spark, sf_dir)
    direct = lines.where(~F.col("is_foreign")).withColumnRenamed("id", STORE).drop("is_foreign")
    mapped = lines.where("is_foreign").withColumnRenamed("id", "hpg_store_id").drop("is_foreign")
    return direct, mapped, store_relation(spark, sf_dir)


def reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reservations_from(*booking_sources(spark, sf_dir))


def reservations_daily(spark: SparkSession, sf_dir: str, as_of=None) -> DataFrame:
    return daily_bookings_mixed(booking_lines(spark, sf_dir), store_relation(spark, sf_dir), as_of=as_of)


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias(STORE),
            F.col("n_name").alias("genre"),
            F.concat_ws(
                " ", F.replace("r_name", F.lit(" "), F.lit("-")), "n_name", "s_name"
            ).alias("area"),
        )
    )


def _place(key: str, lat: int, lon: int) -> list:
    """A position that follows from a key, on a grid of hundredths of a degree."""
    return [
        (F.col(key) * lat % 18000 / 100.0 - 90.0).alias("lat"),
        (F.col(key) * lon % 36000 / 100.0 - 180.0).alias("lon"),
    ]


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores with a position; one in ten has none."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(STORE), *_place("s_suppkey", 7919, 104729))
    known = F.col(STORE) % 10 != 3
    return rows.select(STORE, F.when(known, F.col("lat")).alias("lat"), F.when(known, F.col("lon")).alias("lon"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as weather stations."""
    rows = table(spark, sf_dir, "customer")
    return rows.select(F.col("c_custkey").alias("station_id"), *_place("c_custkey", 15731, 32452843))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals as readings of the customer's station."""
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.col("o_custkey").alias("station_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"))


def holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day from the first visit to some weeks after the last, with its flag."""
    day = F.to_date("l_shipdate")
    span = table(spark, sf_dir, "lineitem").agg(F.min(day).alias("first"), F.max(day).alias("last"))
    days = span.where("first IS NOT NULL").select(
        F.explode(F.sequence("first", F.date_add("last", CALENDAR_AHEAD))).alias(DATE)
    )
    month, dom = F.month(DATE), F.dayofmonth(DATE)
    flagged = (
        (dom == 1)
        | ((month == 12) & (dom >= 29))
        | ((month == 5) & dom.between(3, 5))
    )
    return days.select(DATE, flagged.cast("int").alias("is_holiday"))


def load(spark: SparkSession, sf_dir: str) -> PanelData:
    """All inputs; bookings already reduced to days before any id is mapped."""
    return PanelData(
        visits=visits(spark, sf_dir),
        reservations=reservations_daily(spark, sf_dir),
        stores=stores(spark, sf_dir),
        holidays=holidays(spark, sf_dir),
    )
