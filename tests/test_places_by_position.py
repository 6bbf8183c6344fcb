"""Distances are taken once for each pair of positions; sums over points need no pair of rows."""

from pyspark.sql import functions as F

from homeledger.operators import places


def _tables(spark):
    left = spark.sql("SELECT id AS listing_id, 56.95 + (id % 3) * 0.004 AS lat, 24.1D AS lon, id % 5 <> 0 AS fetched FROM range(60) UNION ALL SELECT 60, null, null, true UNION ALL SELECT 61, 10D, 10D, true").withColumn("lat", F.col("lat").cast("double"))
    right = spark.sql("SELECT id AS poi_id, CAST(56.95 + (id % 7) * 0.002 AS double) AS poi_lat, 24.1D AS poi_lon, CASE WHEN id % 2 = 0 THEN 'grocery_shop' ELSE 'transport_stop' END AS category FROM range(700) UNION ALL SELECT 700, 0D, 0D, 'grocery_shop'")
    return left, right


def _rows(df, left):
    return sorted(tuple(r) for r in df.select(left.columns[0], "nearest_shop", "shops_300", "shops_700", "shops_1200", "nearest_stop", "stops_900", "shop_score", "transport_score").collect())


def test_sums_by_position(spark):
    left, right = _tables(spark)
    pairs = places.near(left, right)
    assert pairs.count() == 60 * 700
    assert _rows(places.infrastructure_of(left, right), left) == _rows(places.infrastructure(left.select("listing_id", "fetched"), pairs), left)


def test_points_near(spark):
    left, right = _tables(spark)
    assert {r.poi_id for r in places.with_near(left, right).collect()} == set(range(700))


def test_few_distances(spark):
    left, right = _tables(spark)
    assert places._spots(left, right, places.RADIUS_M, 60.0).count() == 3 * 7
