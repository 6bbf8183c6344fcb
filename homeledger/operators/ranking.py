"""Ranked views, their orders and summaries."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import HIGH_RISK
from .filters import FilterSpec, apply

NO_PRICE = 10**12


def ranking_order(score: str = "score", price: str = "price_eur", key: str = "listing_id") -> list[Column]:
    """Known scores first, high before low, then cheap before dear and unpriced, then by id."""
    return [F.col(score).isNull().asc(), F.coalesce(score, F.lit(0.0)).desc(), F.coalesce(price, F.lit(NO_PRICE)).asc(), F.col(key).asc()]


#: Orders that a view can be shown in; nulls come last in each.
VIEW_ORDERS = {
    "score": lambda: [F.col("score").desc_nulls_last()],
    "price_asc": lambda: [F.col("price_eur").asc_nulls_last()],
    "price_desc": lambda: [F.col("price_eur").desc_nulls_last()],
    "area": lambda: [F.col("area_m2").desc_nulls_last()],
}


def top(df: DataFrame, n: int, order: list[Column] | None = None) -> DataFrame:
    """The first n rows with their position; only these n rows meet in one task."""
    order = order or ranking_order()
    return df.orderBy(*order).limit(n).withColumn("position", F.row_number().over(Window.orderBy(*order)))


def positions(df: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """All rows with their position, by a range sort: each partition numbers its rows after those before it.

    The counts of partitions, one number each, meet in one task; the rows do not. The sorted rows are written once,
    so that counts and rows come from the same ranges: to the shared checkpoint folder, which outlives lost executors and
    is cleaned with the frame; without one (a session of a single process) they are kept on its disk.
    """
    order = order or ranking_order()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % F.lit(1 << 33))
    shared = df.sparkSession.conf.get("spark.checkpoint.dir", None) or df.sparkSession.sparkContext.getCheckpointDir()
    ranged = ranged.checkpoint() if shared else ranged.persist(StorageLevel.DISK_ONLY)
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return ranged.join(F.broadcast(before), "_p").withColumn("position", (F.col("_before") + F.col("_i") + 1).cast("int")).drop("_p", "_i", "_before")


def ranked(df: DataFrame, spec: FilterSpec = FilterSpec(), n: int | None = None) -> DataFrame:
    rows = apply(df, spec)
    order = ranking_order()
    return top(rows, n, order) if n is not None else positions(rows, order)


def summary(shown: DataFrame, total: int | Column) -> DataFrame:
    """Rows shown and in all, best score, mean price and area, and how many are of high risk."""
    mean = F.avg("price_eur")
    return shown.agg(
        F.count("*").alias("shown"), F.lit(total).alias("total"), F.round(F.max("score")).cast("int").alias("top_score"),
        F.round(mean, 2).alias("avg_price"), F.round(F.avg("area_m2"), 1).alias("avg_area"), F.count_if(F.coalesce(F.col("risk").isin(*HIGH_RISK), F.lit(False))).alias("high_risk"),
    )


def bounds(df: DataFrame) -> DataFrame:
    """Slider bounds over active listings: prices to steps of 5,000, areas to steps of 5, rooms at least one apart."""
    whole = lambda c: F.floor(c).cast("long")
    down = lambda c, s, none: F.coalesce(whole(F.floor(F.min(c) / s) * s), F.lit(none))
    up = lambda c, s, none: F.coalesce(whole(F.floor((F.max(c) + s - 1) / s) * s), F.lit(none))
    rooms = lambda v, none: F.coalesce(F.nullif(v.cast("long"), F.lit(0)), none)
    found = df.where("status = 'active'").agg(
        down("price_eur", 5000, 0).alias("price_low"), up("price_eur", 5000, 300_000).alias("price_high"), down("area_m2", 5, 0).alias("area_low"), up("area_m2", 5, 160).alias("area_high"),
        rooms(F.min("declared_rooms"), F.lit(1)).alias("rooms_low"), rooms(F.max("declared_rooms"), F.lit(6)).alias("rooms_high"),
        rooms(F.min("private_rooms"), F.lit(1)).alias("private_low"), rooms(F.max("private_rooms"), F.lit(None).cast("long")).alias("private_high"),
    )
    found = found.withColumn("private_high", F.coalesce("private_high", "rooms_high"))
    for low, high, least in (("price_low", "price_high", 5000), ("area_low", "area_high", 5), ("rooms_low", "rooms_high", 1), ("private_low", "private_high", 1)):
        found = found.withColumn(high, F.greatest(high, F.col(low) + least))
    return found


def districts(df: DataFrame) -> DataFrame:
    return df.where("district <> ''").select("district").distinct().orderBy("district")


def mean_ratio(column: str = "ppm2") -> Column:
    return F.round(F.avg(column), 2)


def ordered_unique(*queues: DataFrame, key: str = "listing_id") -> DataFrame:
    """(key, position): the queues one after another, each id where it first occurs."""
    rows = None
    for i, q in enumerate(queues):
        part = q.select(key, F.struct(F.lit(i).alias("q"), F.col("pos").cast("long").alias("p")).alias("at"))
        rows = part if rows is None else rows.unionByName(part)
    return positions(rows.groupBy(key).agg(F.min("at").alias("at")), [F.col("at").asc(), F.col(key).asc()]).drop("at")
