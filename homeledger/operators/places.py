"""Distance joins by a grid, infrastructure summaries, location scores and map markers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

#: The two destinations.
CAMPUS, STATION = (56.9505, 24.0837), (56.9463, 24.1209)
RADIUS_M = 1800.0
_DEGREE_M = math.pi * geo.EARTH_RADIUS_M / 180


def _spots(left: DataFrame, right: DataFrame, radius_m: float, most_latitude: float) -> DataFrame:
    """(lat, lon, poi_lat, poi_lon, distance_m): pairs of different positions within the radius.

    Cells are at least a radius high and wide (at the highest latitude in use), so neighbours lie in the nine
    cells around: an equi-join on the cell, then the exact distance. A crowded cell is an ordinary skewed
    join key, which adaptive execution splits.
    """
    high = radius_m / _DEGREE_M * 1.0001
    wide = high / math.cos(math.radians(most_latitude))
    cell = lambda c, size: F.floor(F.col(c) / size).cast("long")
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    l = left.select("lat", "lon").distinct().withColumn("_s", F.explode(steps)).withColumn("_y", cell("lat", high) + F.col("_s.i")).withColumn("_x", cell("lon", wide) + F.col("_s.j")).drop("_s")  # noqa: E741
    r = right.select("poi_lat", "poi_lon").distinct().withColumn("_y", cell("poi_lat", high)).withColumn("_x", cell("poi_lon", wide))
    pairs = l.join(r, ["_y", "_x"]).drop("_y", "_x")
    return pairs.withColumn("distance_m", geo.haversine_m("lat", "lon", "poi_lat", "poi_lon")).where(F.col("distance_m") <= radius_m)


def near(left: DataFrame, right: DataFrame, radius_m: float = RADIUS_M, most_latitude: float = 60.0) -> DataFrame:
    """Pairs of left (lat, lon) and right (poi_lat, poi_lon) within the radius, with distance_m.

    Distances are taken once for each pair of different positions; rows meet by their positions.
    """
    spots = _spots(left, right, radius_m, most_latitude)
    return left.join(spots, ["lat", "lon"]).join(right, ["poi_lat", "poi_lon"])


def with_near(left: DataFrame, right: DataFrame, radius_m: float = RADIUS_M, most_latitude: float = 60.0) -> DataFrame:
    """Rows of right (poi_lat, poi_lon) that some row of left is near to: no pair of rows is made."""
    spots = _spots(left, right, radius_m, most_latitude).select("poi_lat", "poi_lon").distinct()
    return right.join(spots, ["poi_lat", "poi_lon"], "left_semi")


def _summed(links: DataFrame, *own: str) -> DataFrame:
    """(own, nearest and counts) of links (own, category, distance_m, n): n points of a category at a distance, rounded to 0.1 m."""
    d = F.round("distance_m", 1)
    shop, stop = F.col("category") == "grocery_shop", F.col("category") == "transport_stop"
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0))).cast("long")
    return links.groupBy(*own).agg(
        F.min(F.when(shop, d)).alias("nearest_shop"), *(count(shop & (d <= r)).alias(f"shops_{r}") for r in (300, 700, 1200)),
        F.min(F.when(stop, d)).alias("nearest_stop"), count(stop & (d <= 900)).alias("stops_900"),
    )


def infrastructure(listings: DataFrame, links: DataFrame) -> DataFrame:
    """Per listing nearest shop and stop and how many lie near, on distances rounded to 0.1 m.

    links: (listing_id, category, distance_m). A listing that was never looked up (fetched false) has nulls;
    one that was, with nothing near, has counts of 0.
    """
    return _scored(listings.join(_summed(links.withColumn("n", F.lit(1)), "listing_id"), "listing_id", "left"))


def infrastructure_of(listings: DataFrame, points: DataFrame, radius_m: float = RADIUS_M, most_latitude: float = 60.0) -> DataFrame:
    """The same from listings (lat, lon) and points (poi_lat, poi_lon, category): summed up once for each position, no pair of rows is made."""
    counted = points.groupBy("poi_lat", "poi_lon", "category").agg(F.count("*").alias("n"))
    found = _summed(_spots(listings, points, radius_m, most_latitude).join(counted, ["poi_lat", "poi_lon"]), "lat", "lon")
    return _scored(listings.join(found, ["lat", "lon"], "left"))


def _scored(rows: DataFrame) -> DataFrame:
    for c in ("shops_300", "shops_700", "shops_1200", "stops_900"):
        rows = rows.withColumn(c, F.when(F.col("fetched"), F.coalesce(c, F.lit(0))))
    for c in ("nearest_shop", "nearest_stop"):
        rows = rows.withColumn(c, F.when(F.col("fetched"), F.col(c)))
    shop_score = F.when(F.col("fetched"), F.coalesce(geo.shop_score("nearest_shop", "shops_300", "shops_700", "shops_1200"), F.lit(0.0)))
    stop_score = F.when(F.col("fetched"), F.coalesce(geo.transport_score("nearest_stop", "stops_900"), F.lit(0.0)))
    return rows.withColumn("shop_score", F.round(shop_score, 2)).withColumn("transport_score", F.round(stop_score, 2))


def location_scores(places: DataFrame) -> DataFrame:
    """Distances (to 0.1 m) and scores for the destinations, where the address allows; else nulls and the reason."""
    rows = places.withColumn("precision", geo.address_precision("district", "street", "house"))
    rows = rows.withColumn("enabled", geo.scores_enabled("precision", "confidence")).withColumn("reason", geo.disabled_reason("precision", "confidence"))
    for name, (lat, lon), points in (("rtu", CAMPUS, geo.CAMPUS), ("station", STATION, geo.STATION)):
        exact = F.when(F.col("enabled"), geo.haversine_m("lat", "lon", F.lit(lat), F.lit(lon)))
        rows = rows.withColumn(f"{name}_distance", F.round(exact, 1)).withColumn(f"{name}_score", F.round(geo.piecewise(exact, points), 2))
    return rows


def markers(places: DataFrame) -> DataFrame:
    """Map markers of listings with coordinates: visual state and score bucket."""
    rows = places.withColumn("precision", geo.address_precision("district", "street", "house")).where("lat IS NOT NULL AND lon IS NOT NULL")
    return rows.select("listing_id", "lat", "lon", geo.marker_state("status", "is_rejected", "is_favorite", "precision").alias("state"), geo.score_bucket("score").alias("bucket"))


def geocode_query(precision: str, district: str, street: str, house: str, city: str = "Riga", country: str = "Latvia"):
    """Text to look an address up by, as precise as it is known."""
    p = F.col(precision)
    return (
        F.when(p == geo.PRECISIONS[0], F.concat_ws(", ", F.concat_ws(" ", street, house), F.lit(city), F.lit(country)))
        .when(p == geo.PRECISIONS[1], F.concat_ws(", ", F.col(street), F.lit(city), F.lit(country)))
        .when(p == geo.PRECISIONS[2], F.concat_ws(", ", F.col(district), F.lit(city), F.lit(country)))
        .otherwise(f"{city}, {country}")
    )


def geocode_confidence(precision: str, lat: str = "lat", lon: str = "lon") -> Column:
    """How far a position can be trusted: by the precision of what was looked up; null without a hit."""
    level = F.create_map(*(F.lit(x) for kv in zip(geo.PRECISIONS, ("high", "medium", "low"), strict=False) for x in kv))
    return F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), level[F.col(precision)])


def poi_rows(payload: DataFrame, column: str = "payload", key: str | None = None) -> DataFrame:
    """(first, element_type, element_id, category, lat, lon, name) of a JSON answer: 0, 1 or 2 rows an element.

    Elements without a position are dropped; of repeated ones the last value wins at the first place.
    """
    shape = "struct<elements:array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>>"
    own = [key] if key else []  # with a key, answers stay apart
    rows = payload.select(*own, F.posexplode(F.from_json(column, shape)["elements"]).alias("pos", "e"))
    lat, lon = F.coalesce("e.lat", "e.center.lat"), F.coalesce("e.lon", "e.center.lon")
    tag = lambda k: F.col("e.tags")[k]
    grocery = tag("shop").isin("supermarket", "convenience", "grocery")
    stop = (tag("highway") == "bus_stop") | (tag("public_transport") == "platform") | tag("railway").isin("tram_stop", "halt", "station")
    kinds = F.array_compact(F.array(F.when(F.coalesce(grocery, F.lit(False)), F.lit("grocery_shop")), F.when(F.coalesce(stop, F.lit(False)), F.lit("transport_stop"))))
    rows = rows.select(*own, "pos", F.col("e.type").alias("element_type"), F.col("e.id").alias("element_id"), F.explode(kinds).alias("category"), lat.alias("lat"), lon.alias("lon"), F.coalesce(tag("name"), tag("brand")).alias("name"))
    rows = rows.where("lat IS NOT NULL AND lon IS NOT NULL AND element_id IS NOT NULL")
    last = rows.groupBy(*own, "element_type", "element_id", "category").agg(F.min("pos").alias("first"), F.max_by(F.struct("lat", "lon", "name"), "pos").alias("x"))
    return last.select(*own, "first", "element_type", "element_id", "category", "x.lat", "x.lon", "x.name")


def fresh(fetches: DataFrame, now, radius_m: float = RADIUS_M, endpoint: str = "default", hours: float = 168) -> DataFrame:
    """fetches with whether each cached answer still serves: same place, radius and source, and young enough."""
    utc = lambda c: F.try_to_timestamp(F.when(F.regexp_like(c, F.lit("([+-]\\d\\d:?\\d\\d|Z)$")), c).otherwise(F.concat(c, F.lit("+00:00"))))  # noqa: E731  times without a zone are UTC's
    at = utc(F.col("fetched_at"))
    same = (F.abs(F.col("lat") - F.col("c_lat")) < 1e-6) & (F.abs(F.col("lon") - F.col("c_lon")) < 1e-6)
    young = (F.lit(hours) > 0) & (at >= utc(F.lit(str(now))) - F.make_interval(hours=F.lit(int(hours))))
    return fetches.withColumn("fresh", F.coalesce(same & (F.col("radius_m") >= radius_m) & (F.col("endpoint") == endpoint) & young, F.lit(False)))
