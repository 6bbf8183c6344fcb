"""Read models over the whole star: candidates, map points, details with their nested history, lines and payload.

A model is a chain of left joins by listing. Dimensions of one row a listing are joined as they are; several rows
(analyses, images, snapshots, events) are first summed up to one with partial aggregates. A filter on listings, where
one is given, is applied before all joins, so that it reaches every scan that it can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nulls, text
from ..functions.geo import score_bucket
from . import scoring, star, views
from .places import CAMPUS, STATION

#: Labels of the score blocks.
BLOCK_LABELS = {
    "price_value": "Price value", "room_privacy": "Room privacy / effective private rooms", "mortgage_suitability": "Mortgage suitability", "rtu_accessibility": "RTU accessibility",
    "transport_connectivity": "Transport connectivity", "central_station_accessibility": "Central station accessibility", "shops_infrastructure": "Shops / infrastructure", "useful_area": "Useful area",
    "building_series": "Building / series", "layout_confidence": "AI layout confidence", "floor": "Floor", "condition": "Condition / renovation",
}
USER_DEFAULTS = {"user_status": "unseen", "is_favorite": False, "is_rejected": False, "is_viewed": False}


def one(listings: DataFrame, listing_id: int | None = None, source_id: str | None = None) -> DataFrame:
    """The listing of an id, or of the id at its source; all of them where neither is given."""
    rows = listings if listing_id is None else listings.where(F.col("listing_id") == listing_id)
    return rows if source_id is None else rows.where(F.col("ss_id") == source_id)


def by_listing(rows: DataFrame, dimension: DataFrame) -> DataFrame:
    """A left join to a dimension of one row a listing, by sorting both sides.

    A dimension grows with the listings. Its columns are texts made from a few small ones, so the optimiser's guess by file size
    is far too low, and a broadcast by it would pass the whole dimension through the driver.
    """
    return rows.join(dimension.hint("merge"), "listing_id", "left")


def with_user(rows: DataFrame, users: DataFrame) -> DataFrame:
    """User state with its defaults, notes, and whether there are any: null and blank ones are none."""
    rows = by_listing(rows, users).withColumns({c: F.coalesce(c, F.lit(v)) for c, v in USER_DEFAULTS.items()})
    return rows.withColumn("has_notes", F.coalesce(F.trim("notes") != "", F.lit(False)))


def floor_plans(images: DataFrame) -> DataFrame:
    """(listing_id, has_plan_image, floor_plan_path): of the floor plans with a path the one of the least id."""
    plans = images.where("is_floor_plan")
    path = F.min(F.when(F.col("path") != "", F.struct("image_id", "path")))["path"]
    return plans.groupBy("listing_id").agg(F.lit(True).alias("has_plan_image"), path.alias("floor_plan_path"))


def with_floor_plan(rows: DataFrame, images: DataFrame) -> DataFrame:
    """has_floor_plan: an image is marked as one, or the analysis names some."""
    rows = by_listing(rows, floor_plans(images))
    named = ~F.col("floor_plan_ids").isin("", "[]")
    return rows.withColumn("has_floor_plan", F.coalesce("has_plan_image", F.lit(False)) | F.coalesce(named, F.lit(False))).drop("has_plan_image")


def of_profile(scores: DataFrame, profile: str) -> DataFrame:
    """Scores of one profile: a condition on the scores, so listings without one stay when joined."""
    return scores.where(F.col("profile_key") == profile).drop("profile_key")


def candidates(listings: DataFrame, users: DataFrame, analyses: DataFrame, images: DataFrame, location: DataFrame, valuation: DataFrame, scores: DataFrame, profile: str) -> DataFrame:
    """Listings with user state, latest analysis, location scores, price value and one profile's score."""
    rows = by_listing(with_user(listings, users), star.latest_analysis(analyses).drop("version", "state"))
    rows = with_floor_plan(rows, images)
    rows = by_listing(rows, location.select("listing_id", "rtu_score", "transport_score", "station_score"))
    rows = by_listing(rows, valuation.select("listing_id", "price_value_score", "suspicious"))
    rows = rows.withColumn("suspicious", F.coalesce("suspicious", F.lit(False)))
    return by_listing(rows, of_profile(scores, profile).select("listing_id", "score"))


def map_points(listings: DataFrame, users: DataFrame, located: DataFrame, scores: DataFrame, profile: str) -> DataFrame:
    """Listings with marks, position and one profile's score."""
    rows = by_listing(with_user(listings, users), located.select("listing_id", "lat", "lon", "precision"))
    return by_listing(rows, of_profile(scores, profile).select("listing_id", "score"))


def map_coverage(ranked: DataFrame, points: DataFrame) -> DataFrame:
    """How many listings are shown and how many of these have a position."""
    own = ranked.select("listing_id").join(points.select("listing_id", "lat", "lon"), "listing_id", "left")
    return own.agg(F.count("*").alias("visible"), F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("geocoded"))


def reference_points(spark: SparkSession, shops: DataFrame) -> DataFrame:
    """The two destinations and the shops (poi_id, poi_name, poi_lat, poi_lon) as points of a map."""
    fixed = spark.createDataFrame([("rtu", "RTU", *CAMPUS, "rtu"), ("station", "Central station", *STATION, "station")], "point_id string, title string, lat double, lon double, kind string")
    own = shops.select(F.concat(F.lit("grocery-"), F.col("poi_id").cast("string")).alias("point_id"), F.coalesce(nulls.filled("poi_name"), F.lit("Grocery store")).alias("title"), F.col("poi_lat").alias("lat"), F.col("poi_lon").alias("lon"), F.lit("grocery").alias("kind"))
    return fixed.unionByName(own)


def linked_pois(links: DataFrame, pois: DataFrame) -> DataFrame:
    """Links (listing_id, poi_id, distance_m) with their points of interest; links to none are dropped."""
    return links.join(pois, "poi_id")


def without_orphans(pois: DataFrame, links: DataFrame) -> DataFrame:
    """Points of interest that some listing is linked to."""
    return pois.join(links.select("poi_id").distinct(), "poi_id", "left_semi")


def to_locate(listings: DataFrame, located: DataFrame) -> DataFrame:
    """Listings that have been looked up, with what was found."""
    return listings.join(located, "listing_id")


def history(snapshots: DataFrame, events: DataFrame) -> DataFrame:
    """(listing_id, history, events): snapshots and events of each listing, newest first; ties by id, the later first."""
    taken = snapshots.groupBy("listing_id").agg(F.sort_array(F.collect_list(F.struct("checked_at", "event_id", "price_eur", "visits", "images")), asc=False).alias("history"))
    seen = events.groupBy("listing_id").agg(F.sort_array(F.collect_list(F.struct("detected_at", "event_id", "event_type", "old_value", "new_value")), asc=False).alias("events"))
    return taken.join(seen, "listing_id", "full")


def detail(
    listings: DataFrame, users: DataFrame, analyses: DataFrame, images: DataFrame, located: DataFrame, location: DataFrame, valuation: DataFrame, scores: DataFrame, profile: str,
    nested: DataFrame | None = None, listing_id: int | None = None,
) -> DataFrame:
    """Everything about a listing, or about all; nested: the result of history()."""
    rows = by_listing(with_user(one(listings, listing_id), users), star.latest_analysis(analyses).drop("version", "state"))
    rows = by_listing(by_listing(by_listing(with_floor_plan(rows, images), located), location), valuation)
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("suspicious", "geo_enabled", "kitchen_living")})
    rows = by_listing(rows, of_profile(scores, profile))
    if nested is not None:
        empty = lambda c: F.coalesce(c, F.array().cast(nested.schema[c].dataType))
        rows = by_listing(rows, nested).withColumn("history", empty("history")).withColumn("events", empty("events"))
    return rows


# ---- texts ---------------------------------------------------------------------------------------------------


def _number(digits: int, c: str, tail: str = "") -> Column:
    return F.when(F.col(c).isNull(), "unknown").otherwise(F.concat(text.fixed(c, digits), F.lit(tail)))


def _score(c: str) -> Column:
    return _number(1, c)


def _metres(c: str) -> Column:
    return _number(0, c, " m")


def _said(c: str, missing: str = "unknown") -> Column:
    return F.coalesce(nulls.filled(F.col(c).cast("string")), F.lit(missing))


def _yes(c: str) -> Column:
    return F.when(F.col(c), "Yes").otherwise("No")


def _line(label: str, *values: Column | str) -> Column:
    return F.concat(F.lit(label + ": "), *(F.lit(v) if isinstance(v, str) else v for v in values))


def per_m2(c: str) -> Column:
    return F.coalesce(F.concat(F.replace(F.format_number(F.col(c), 2), F.lit(","), F.lit(" ")), F.lit(" EUR/m2")), F.lit("unknown"))


def floor_text(floor: str, total: str) -> Column:
    return F.when(F.col(floor).isNull(), "unknown").otherwise(F.concat_ws("/", F.col(floor).cast("string"), F.col(total).cast("string")))


BREAKDOWN = "map<string,string>"


def breakdown(c: str = "breakdown") -> Column:
    """array<struct<label, score, explanation>> of a stored breakdown, by block; what is no object is left out."""
    known = F.create_map(*(F.lit(x) for kv in BLOCK_LABELS.items() for x in kv))
    whole = F.when(F.startswith(F.trim(c), F.lit("{")), F.from_json(c, BREAKDOWN))
    pairs = F.filter(F.array_sort(F.map_entries(whole)), lambda x: F.startswith(F.trim(x["value"]), F.lit("{")))
    number = lambda v: F.when(F.get_json_object(v, "$.score").rlike("^-?[0-9.]+$") & ~v.rlike('"score"\\s*:\\s*"'), F.get_json_object(v, "$.score").try_cast("double"))
    label = lambda k: F.coalesce(known[k], F.initcap(F.replace(k, F.lit("_"), F.lit(" "))))
    return F.coalesce(F.transform(pairs, lambda x: F.struct(label(x["key"]).alias("label"), number(x["value"]).alias("score"), nulls.filled(F.get_json_object(x["value"], "$.explanation")).alias("explanation"))), F.array().cast("array<struct<label:string,score:double,explanation:string>>"))


def top_breakdown(c: str = "breakdown", n: int = 5) -> Column:
    """array<struct<label, value, bucket>>: the n scores farthest from 50."""
    items = F.filter(breakdown(c), lambda x: x["score"].isNotNull())
    rated = F.transform(items, lambda x, i: F.struct((-F.abs(F.round(x["score"]) - 50)).alias("o"), i.alias("i"), x["label"].alias("label"), F.round(x["score"]).cast("int").alias("value")))
    return F.transform(F.slice(F.array_sort(rated), 1, n), lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value"), score_bucket(x["value"]).alias("bucket")))


def sections() -> dict[str, Column]:
    """Lines of a detail page by section, for rows of detail() with a history."""
    newest = lambda k: F.try_element_at("history", F.lit(1))[k]
    last = F.try_element_at("events", F.lit(1))
    event = F.concat(last["event_type"], F.when(last["old_value"].isNotNull() | last["new_value"].isNotNull(), F.concat(F.lit(" ("), F.coalesce(last["old_value"], F.lit("None")), F.lit(" -> "), F.coalesce(last["new_value"], F.lit("None")), F.lit(")"))).otherwise(""))
    lines = F.transform(breakdown(), lambda x: F.concat(x["label"], F.lit(": "), F.coalesce(F.when(x["score"].isNotNull(), text.fixed(x["score"], 1)), F.lit("unknown")), F.coalesce(F.concat(F.lit(" - "), x["explanation"]), F.lit(""))))
    none = F.array().cast("array<string>")
    shown = F.size("history") > 0
    return {
        "top": F.array(
            _line("Price", text.money("price_eur")), _line("Area", text.area("area_m2")), _line("Price per m2", per_m2("ppm2")), _line("District", _said("district")), _line("Street", _said("street")),
            _line("Floor", floor_text("floor", "floors")), _line("Building series", _said("series")), _line("Building type", _said("building_type")), _line("Listing date", _said("date_text")),
        ),
        "rating": F.concat(
            F.array(_line("Overall score", _score("score"))), F.when(nulls.filled("score_text").isNotNull(), F.array(_line("Explanation", F.col("score_text")))).otherwise(none),
            F.when(F.size(lines) > 0, F.concat(F.array(F.lit("Breakdown:")), lines)).otherwise(none),
        ),
        "price": F.array(
            _line("Price value score", _score("price_value_score")), _line("Price per m2 score", _score("ppm2_score")), _line("Relative market score", _score("ppm2_score")),
            _line("Price per effective private room", text.money("ppr")), _line("Private room value score", _score("room_score")), _line("Absolute price score", _score("absolute_score")),
            _line("Suspiciously low price", _yes("suspicious")), _line("Baseline level", _said("baseline_level")), _line("Baseline sample size", _said("baseline_n")),
            _line("Baseline median EUR/m2", per_m2("baseline_median")), _line("Baseline explanation", _said("baseline_text", "not calculated yet")),
        ),
        "layout": F.array(
            _line("AI-effective private rooms", _said("private_rooms")), _line("SS-declared rooms", _said("declared_rooms")), _line("Walkthrough rooms", _said("walkthrough_rooms")), _line("Kitchen-living detected", _yes("kitchen_living")),
            _line("Layout confidence", _said("layout_label", "Unknown")), _line("Explanation", _said("layout_text", "not analyzed yet")),
        ),
        "mortgage": F.array(_line("Mortgage risk", _said("risk", "Unknown")), _line("Reasons", _said("risk_reasons", "not analyzed yet")), _line("Evidence", _said("risk_text", "not analyzed yet"))),
        "location": F.array(
            _line("Address precision", _said("precision")), _line("Geocode confidence", _said("confidence")),
            _line("Coordinates", F.when(F.col("lat").isNull() | F.col("lon").isNull(), "unknown").otherwise(F.concat_ws(", ", text.fixed("lat", 6), text.fixed("lon", 6)))), _line("Location scores enabled", _yes("geo_enabled")), _line("Disabled reason", _said("geo_reason", "none")),
            _line("RTU", _metres("rtu_distance"), ", score ", _score("rtu_score")), _line("Central station", _metres("station_distance"), ", score ", _score("station_score")),
            _line("Grocery shops", "nearest ", _metres("nearest_shop"), ", ", _said("shops_1200"), " within 1200 m, score ", _score("shop_score")),
            _line("Public transport", "nearest ", _metres("nearest_stop"), ", ", _said("stops_900"), " within 900 m, score ", _score("transport_score")), _line("Location explanation", F.coalesce(location_text(), F.lit("not calculated yet"))),
        ),
        "history": F.concat(
            F.array(_line("Snapshots", F.size("history").cast("string")), _line("Change events", F.size("events").cast("string"))),
            F.when(shown, F.array(
                _line("Last checked", F.date_format(newest("checked_at"), "yyyy-MM-dd HH:mm:ss")), _line("Latest price", F.coalesce(F.concat(F.replace(F.format_number(newest("price_eur"), 0), F.lit(","), F.lit(" ")), F.lit(" EUR")), F.lit("unknown"))),
                _line("Latest unique visits", F.coalesce(newest("visits").cast("string"), F.lit("unknown"))), _line("Latest image count", F.coalesce(newest("images").cast("string"), F.lit("unknown"))),
            )).otherwise(none),
            F.when(F.size("events") > 0, F.array(_line("Latest event", event))).otherwise(none),
        ),
    }


def location_text(cache: str = "has_cache", shops: str = "shops_1200", stops: str = "stops_900") -> Column:
    """What the location scores rest on; null where there are none."""
    base = "Straight-line distance scores for RTU main campus and Riga Central Station / Origo."  # fixed value
    with_cache = F.concat(F.lit(base + " OSM cache contains "), F.col(shops).cast("string"), F.lit(" grocery shops within 1200 m and "), F.col(stops).cast("string"), F.lit(" transport stops within 900 m."))
    return F.when(F.col(cache), with_cache).when(~F.col(cache), base + " OSM infrastructure cache is not available.")


def with_street(street: str = "street", house: str = "house") -> Column:
    """Street and house number, or whichever there is."""
    return nulls.filled(F.concat_ws(" ", nulls.filled(street), nulls.filled(house)))


def short_title(district: str = "district", street: str = "street", house: str = "house", title: str = "title", source_id: str = "ss_id") -> Column:
    """Address parts that there are, else the listing's title, else its id at the source."""
    address = nulls.filled(F.concat_ws(", ", nulls.filled(district), with_street(street, house)))
    return F.coalesce(address, nulls.filled(title), F.concat(F.lit("SS "), F.col(source_id).cast("string")))


def short_meta(price: str = "price_eur", area: str = "area_m2", rooms: str = "declared_rooms") -> Column:
    """Price, area and declared rooms, as far as known."""
    size = F.when(F.col(area) == F.floor(area), F.floor(area).cast("string")).otherwise(F.regexp_replace(F.format_string("%.4f", F.col(area)), "0+$", ""))
    return F.concat_ws(" · ", F.concat(text.thousands(price), F.lit(" €")), F.concat(size, F.lit(" m²")), F.concat(F.lit("SS "), F.col(rooms).cast("string")))


def analysis_queue(listings: DataFrame, analyses: DataFrame, again: DataFrame) -> DataFrame:
    """(listing_id, position, status, title, meta): listings to analyse, last seen first, then those to analyse again.

    listings: active ones with a description; again: ids to analyse again, as far as they have an analysis.
    """
    done = analyses.where("state = 'finished'").select("listing_id").distinct().withColumn("done", F.lit(True))
    rows = listings.where("status = 'active' AND description IS NOT NULL").join(done, "listing_id", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    rows = star.with_flag(rows, again, "listing_id", "wanted")
    rows = rows.withColumn("pending", nulls.require(F.col("needs_ai")) | ~F.col("done")).withColumn("again", F.col("wanted") & F.col("done")).where("pending OR again")
    return rows.withColumn("status", F.when(F.col("again"), "reanalyze").otherwise("pending")).withColumn("seen", F.coalesce("last_seen", "updated", "first_seen"))


def queue_order() -> list[Column]:
    """Pending ones first, last seen first, the later id first."""
    return [F.col("pending").desc(), F.col("seen").desc_nulls_last(), F.col("listing_id").desc()]


def in_scope(scope: DataFrame, pending: DataFrame, attempted: DataFrame) -> DataFrame:
    """What is shown and pending and was not tried yet."""
    return scope.join(pending.select("listing_id"), "listing_id", "left_semi").join(attempted.select("listing_id"), "listing_id", "left_anti")


def payload() -> dict[str, Column]:
    """A detail page's payload, for rows of detail() with a history."""
    rounded = lambda c: F.round(c).cast("int")
    rated = lambda label, v: F.struct(F.lit(label).alias("label"), v.alias("value"), score_bucket(v.cast("double")).alias("bucket"))
    mortgage = scoring.scores.mortgage_suitability("risk")
    return {
        "district": F.coalesce(nulls.filled("district"), F.lit("Unknown district")), "address": F.coalesce(nulls.filled("street"), F.lit("Unknown street")), "house_number": F.col("house"), "url": F.col("url"),
        "price": text.money("price_eur", text.DASH, " €"), "area": text.area("area_m2", text.DASH, " m²"), "price_per_m2": F.coalesce(F.concat(text.thousands(F.round("ppm2")), F.lit(" €/m²")), F.lit(text.DASH)),
        "overall_score": rounded("score"), "score_bucket": score_bucket("score"), "badges": views.chips(views.badges()),
        "evaluation": F.array(rated("Price to value", rounded("price_value_score")), rated("Location viability", views.location_value()), rated("Mortgage suitability", F.when(F.col("risk").isNotNull(), F.round(mortgage).cast("int")))),
        "breakdown": top_breakdown(), "ai_insight": text.first_text("score_text", "layout_text", "baseline_text"),
        "layout": F.struct(text.or_unknown("private_rooms", text.DASH).alias("ai_rooms"), text.or_unknown("declared_rooms", text.DASH).alias("ss_rooms"), text.or_unknown("walkthrough_rooms", text.DASH).alias("walkthrough"), F.col("kitchen_living"), F.coalesce("layout_label", F.lit("Unknown")).alias("confidence"), _said("layout_text", "not analyzed yet").alias("explanation")),
        "floor_plan": F.col("floor_plan_path"),
        "mortgage": F.struct(views.mortgage()["level"].alias("level"), views.mortgage()["type"].alias("type"), F.when(F.col("risk").isNull(), "not analyzed yet").otherwise(F.coalesce(nulls.filled("risk_text"), nulls.filled("risk_reasons"), F.lit("not analyzed yet"))).alias("text")),
        "proximity": F.struct(text.distance("rtu_distance").alias("rtu"), text.distance("station_distance").alias("station"), text.distance("nearest_shop").alias("shop"), text.distance("nearest_stop").alias("stop")),
        "history": F.struct(F.size("history").alias("snapshots"), F.size("events").alias("events")),
        "source_text": F.coalesce("description", F.lit("")), "notes": F.coalesce("notes", F.lit("")), "is_favorite": F.col("is_favorite"), "is_rejected": F.col("is_rejected"),
        "building_series": F.coalesce(nulls.filled("series"), nulls.filled("building_type"), F.lit("unknown")),
    }


#: Rows of the short comparison.
SHORT = (
    ("Price", lambda: text.money("price_eur", text.DASH, " €")), ("EUR/m2", lambda: F.coalesce(F.concat(text.thousands(F.round("ppm2")), F.lit(" €/m²")), F.lit(text.DASH))), ("Area", lambda: text.area("area_m2", text.DASH, " m²")),
    ("Score", lambda: F.coalesce(F.round("score").cast("int").cast("string"), F.lit(text.DASH))), ("AI-effective rooms", lambda: text.rooms_label("private_rooms", "kitchen_living")), ("Mortgage risk", lambda: F.coalesce("risk", F.lit("Unknown"))),
    ("Building / series", lambda: F.coalesce(nulls.filled("series"), nulls.filled("building_type"), F.lit("unknown"))), ("Flags", lambda: F.when(F.size(views.comparison_flags()) > 0, F.array_join(views.comparison_flags(), ", ")).otherwise("none")),
)


def short_comparison(rows: DataFrame, ids: list[int]) -> DataFrame:
    """Eight attributes as rows, the first five of the listings as columns; no rows for fewer than two."""
    ids = ids[:5]
    own = rows.where(F.col("listing_id").isin(*ids) if len(ids) >= 2 else F.lit(False))
    cells = F.array(*(F.struct(F.lit(i).alias("row"), F.lit(n).alias("label"), v().alias("value")) for i, (n, v) in enumerate(SHORT)))
    long = own.select("listing_id", F.explode(cells).alias("x")).select("listing_id", "x.*")
    return long.groupBy("row", "label").agg(*(F.max(F.when(F.col("listing_id") == k, F.col("value"))).alias(f"l{i}") for i, k in enumerate(ids, 1)))
