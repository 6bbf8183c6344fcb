"""Queries over the whole star, stored tables' changes, profiles and sessions, with the SQL that they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes, market, mutations, places, profiles, ranking, read_models, scoring, star
from ..sources.bindings import bind, ctes, load, split_columns
from .queries import C, _CHANGED, _halves, _LAGGED, _UPSERT, query

PROFILE = "best_price"
STAR = ctes("market", "users", "images", "ai", "located", "location", "valuation", "profiled")
#: A listing's own columns, apart from those that its dimensions bring.
OWN = "listing_id, price_eur, area_m2, district, street, house, declared_rooms, series, status"
_JOINED = f"""{STAR},
l AS (SELECT {OWN} FROM market), u AS (SELECT * FROM users WHERE stored), g AS (SELECT * FROM located WHERE stored), ls AS (SELECT * FROM location WHERE stored), v AS (SELECT * FROM valuation WHERE stored),
sc AS (SELECT * FROM profiled WHERE stored AND profile_key = '{PROFILE}'),
a AS (SELECT * FROM ai WHERE state = 'finished' QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY version DESC) = 1),
plans AS (SELECT listing_id, arg_min(path, image_id) FILTER (WHERE path <> '') AS floor_plan_path FROM images WHERE is_floor_plan GROUP BY listing_id),
x AS (SELECT l.*, a.private_rooms, a.walkthrough_rooms, coalesce(a.kitchen_living, false) AS kitchen_living, a.room_conflict, a.layout_label, a.risk, a.stove, a.wooden, a.layout_text, a.risk_reasons, a.risk_text,
  coalesce(u.user_status, 'unseen') AS user_status, coalesce(u.is_favorite, false) AS is_favorite, coalesce(u.is_rejected, false) AS is_rejected, coalesce(u.is_viewed, false) AS is_viewed, u.notes, coalesce(trim(u.notes) <> '', false) AS has_notes,
  plans.listing_id IS NOT NULL OR coalesce(a.floor_plan_ids NOT IN ('', '[]'), false) AS has_floor_plan, plans.floor_plan_path,
  g.lat, g.lon, g.precision, g.confidence, coalesce(g.geo_enabled, false) AS geo_enabled, g.geo_reason, ls.rtu_distance, ls.rtu_score, ls.station_distance, ls.station_score, ls.nearest_shop, ls.shops_1200, ls.shop_score, ls.nearest_stop, ls.stops_900, ls.transport_score, ls.has_cache,
  v.price_value_score, v.ppm2_score, v.room_score, v.absolute_score, coalesce(v.suspicious, false) AS suspicious, v.baseline_level, v.baseline_n, v.baseline_median, v.baseline_text, sc.score, sc.score_text, sc.breakdown,
  CASE WHEN l.area_m2 > 0 THEN l.price_eur / l.area_m2 END AS ppm2, CASE WHEN a.private_rooms > 0 THEN l.price_eur / CAST(a.private_rooms AS DOUBLE) END AS ppr
  FROM l LEFT JOIN u USING (listing_id) LEFT JOIN a USING (listing_id) LEFT JOIN plans USING (listing_id) LEFT JOIN g USING (listing_id) LEFT JOIN ls USING (listing_id) LEFT JOIN v USING (listing_id) LEFT JOIN sc USING (listing_id))"""


def _tables(spark, sf):
    """(listings, users, analyses, images, located, location, valuation, scores): what is stored of each."""
    own = bind(spark, sf, "market").select(*OWN.split(", "))
    stored = lambda n: bind(spark, sf, n).where("stored").drop("stored")
    return own, stored("users"), bind(spark, sf, "ai"), bind(spark, sf, "images"), stored("located"), stored("location"), stored("valuation"), stored("profiled")


def _detail(spark, sf, nested=None, listing_id=None):
    l, u, a, i, g, ls, v, sc = _tables(spark, sf)  # noqa: E741
    return market.with_prices(read_models.detail(l, u, a, i, g, ls, v, sc, PROFILE, nested, listing_id))


_CANDIDATE = "listing_id, status, district, price_eur, user_status, is_favorite, is_rejected, is_viewed, has_notes, private_rooms, room_conflict, layout_label, risk, stove, wooden, has_floor_plan, rtu_score, transport_score, station_score, price_value_score, suspicious, score"


@query(f"{_JOINED} SELECT {_CANDIDATE} FROM x")
def candidate_star_full(spark, sf):
    l, u, a, i, _, ls, v, sc = _tables(spark, sf)  # noqa: E741
    return read_models.candidates(l, u, a, i, ls, v, sc, PROFILE).select(*_CANDIDATE.split(", "))


_DETAIL = "listing_id, price_eur, area_m2, district, street, house, declared_rooms, series, status, private_rooms, walkthrough_rooms, kitchen_living, room_conflict, layout_label, risk, stove, wooden, layout_text, risk_reasons, risk_text, user_status, is_favorite, is_rejected, is_viewed, notes, has_floor_plan, floor_plan_path, lat, lon, precision, confidence, geo_enabled, geo_reason, rtu_distance, rtu_score, station_distance, station_score, nearest_shop, shops_1200, shop_score, nearest_stop, stops_900, transport_score, price_value_score, ppm2_score, room_score, absolute_score, suspicious, baseline_level, baseline_n, baseline_median, baseline_text, score, score_text, breakdown"


@query(f"{_JOINED} SELECT {_DETAIL} FROM x")
def detail_star(spark, sf):
    return _detail(spark, sf).select(*_DETAIL.split(", "))


@query(f"{_JOINED} SELECT {_DETAIL} FROM x WHERE listing_id = 17")
def detail_by_id(spark, sf):
    return _detail(spark, sf, listing_id=17).select(*_DETAIL.split(", "))


@query("SELECT page_id, url FROM pages WHERE url = (SELECT min(url) FROM pages)")
def lookup_by_natural_key(spark, sf):
    rows = load(spark, sf, "pages").select(F.col("page_id").alias("listing_id"), F.col("url").alias("ss_id"))
    key = rows.agg(F.min("ss_id")).first()[0]
    return read_models.one(rows, source_id=key).select(F.col("listing_id").alias("page_id"), F.col("ss_id").alias("url"))


@query(f"{_JOINED} SELECT listing_id, status, is_favorite, is_rejected, lat, lon, precision, score FROM x")
def map_points(spark, sf):
    l, u, _, _, g, _, _, sc = _tables(spark, sf)  # noqa: E741
    return read_models.map_points(l, u, g, sc, PROFILE).select("listing_id", "status", "is_favorite", "is_rejected", "lat", "lon", "precision", "score")


@query(f"{_JOINED} SELECT count(*) AS visible, count(*) FILTER (WHERE lat IS NOT NULL AND lon IS NOT NULL) AS geocoded FROM x WHERE status = 'active' AND NOT is_rejected")
def map_coverage(spark, sf):
    l, u, _, _, g, _, _, sc = _tables(spark, sf)  # noqa: E741
    points = read_models.map_points(l, u, g, sc, PROFILE)
    return read_models.map_coverage(points.where("status = 'active' AND NOT is_rejected"), points)


P = ctes("places", "pois")


@query(f"{P} SELECT 'grocery-' || poi_id AS point_id, coalesce(nullif(poi_name, ''), 'Grocery store') AS title, 'grocery' AS kind, poi_lat AS lat, poi_lon AS lon FROM pois WHERE category = 'grocery_shop' UNION ALL SELECT * FROM (VALUES ('rtu', 'RTU', 'rtu', {places.CAMPUS[0]}::DOUBLE, {places.CAMPUS[1]}::DOUBLE), ('station', 'Central station', 'station', {places.STATION[0]}::DOUBLE, {places.STATION[1]}::DOUBLE))")
def reference_points(spark, sf):
    return read_models.reference_points(spark, bind(spark, sf, "pois").where("category = 'grocery_shop'"))


@query(f"{STAR} SELECT listing_id, district, lat, lon, precision FROM market JOIN located USING (listing_id) WHERE stored")
def located_listings(spark, sf):
    l, g = _tables(spark, sf)[0], _tables(spark, sf)[4]  # noqa: E741
    return read_models.to_locate(l, g).select("listing_id", "district", "lat", "lon", "precision")


_LINKS = "SELECT o_custkey % 1000 AS listing_id, o_custkey AS poi_id, CAST(o_orderkey % 1800 AS DOUBLE) AS distance_m FROM orders"


@query(f"{P}, links AS ({_LINKS}) SELECT listing_id, poi_id, category, poi_name, count(*) AS n, CAST(sum(distance_m) AS BIGINT) AS total FROM links JOIN pois USING (poi_id) GROUP BY ALL")
def link_poi_join(spark, sf):
    links = load(spark, sf, "orders").selectExpr("o_custkey % 1000 AS listing_id", "o_custkey AS poi_id", "CAST(o_orderkey % 1800 AS DOUBLE) AS distance_m")
    rows = read_models.linked_pois(links, bind(spark, sf, "pois"))
    return rows.groupBy("listing_id", "poi_id", "category", "poi_name").agg(F.count("*").alias("n"), F.sum("distance_m").cast("long").alias("total"))


@query(f"{P} SELECT poi_id, poi_name, category FROM pois WHERE poi_id IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 1)")
def orphans_deleted(spark, sf):
    links = load(spark, sf, "orders").where("o_orderkey % 50 = 1").select(F.col("o_custkey").alias("poi_id"))
    return read_models.without_orphans(bind(spark, sf, "pois"), links).select("poi_id", "poi_name", "category")


# ---- history, sections, payload ------------------------------------------------------------------------------

_HISTORY = f"""{C}, lagged AS (SELECT *, {_LAGGED}, row_number() OVER w AS nth FROM snapshots WINDOW w AS (PARTITION BY listing_id ORDER BY checked_at, event_id)), pairs AS (SELECT * FROM lagged WHERE nth > 1),
e AS ({_CHANGED.format(k='listing_id, checked_at, event_id', t='pairs')})"""


def _nested(spark, sf):
    rows = bind(spark, sf, "snapshots")
    seen = changes.history_events(rows, keep=("event_id",))
    return read_models.history(rows, seen.withColumnRenamed("checked_at", "detected_at"))


@query(f"{_HISTORY}, h AS (SELECT listing_id, string_agg(strftime(checked_at, '%Y-%m-%d %H:%M:%S') || '/' || event_id || '/' || coalesce(CAST(price_eur AS VARCHAR), '-'), ',' ORDER BY checked_at DESC, event_id DESC) AS t, count(*) AS n FROM snapshots GROUP BY listing_id), v AS (SELECT listing_id, string_agg(event_id || '/' || event_type || '/' || coalesce(old_value, '-') || '/' || coalesce(new_value, '-'), ',' ORDER BY checked_at DESC, event_id DESC, event_type DESC, old_value DESC, new_value DESC) AS t, count(*) AS n FROM e GROUP BY listing_id) SELECT h.listing_id, CAST(h.n AS INT) AS n_history, CAST(coalesce(v.n, 0) AS INT) AS n_events, sha256(h.t) AS history, sha256(coalesce(v.t, '')) AS events FROM h LEFT JOIN v USING (listing_id)")
def history_and_events(spark, sf):
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    slash = lambda *c: F.concat_ws("/", *c)
    taken = F.transform("history", lambda x: slash(F.date_format(x["checked_at"], "yyyy-MM-dd HH:mm:ss"), x["event_id"].cast("string"), dash(x["price_eur"])))
    seen = F.transform(F.coalesce("events", F.array().cast("array<struct<detected_at:timestamp_ntz,event_id:bigint,event_type:string,old_value:string,new_value:string>>")), lambda x: slash(x["event_id"].cast("string"), x["event_type"], dash(x["old_value"]), dash(x["new_value"])))
    return _nested(spark, sf).select("listing_id", F.size("history").alias("n_history"), F.size(seen).alias("n_events"), F.sha2(F.array_join(taken, ","), 256).alias("history"), F.sha2(F.array_join(seen, ","), 256).alias("events"))


def _thousands(v: str) -> str:
    return f"replace(format('{{:,}}', CAST(round({v}) AS BIGINT)), ',', ' ')"


def _known(v: str, missing: str = "unknown") -> str:
    return f"coalesce(nullif(CAST({v} AS VARCHAR), ''), '{missing}')"


_S = lambda v: f"coalesce(printf('%.1f', {v}), 'unknown')"
_METRES = lambda v: f"coalesce(printf('%.0f m', {v}), 'unknown')"
_YES = lambda v: f"CASE WHEN {v} THEN 'Yes' ELSE 'No' END"
_PER = lambda v: f"coalesce(replace(format('{{:,.2f}}', {v}), ',', ' ') || ' EUR/m2', 'unknown')"
_EUR = lambda v: f"coalesce(replace(format('{{:,}}', CAST(round_even(CAST({v} AS DOUBLE), 0) AS BIGINT)), ',', ' ') || ' EUR', 'unknown')"
_LOCATION_TEXT = "CASE WHEN has_cache THEN 'Straight-line distance scores for RTU main campus and Riga Central Station / Origo. OSM cache contains ' || shops_1200 || ' grocery shops within 1200 m and ' || stops_900 || ' transport stops within 900 m.' WHEN NOT has_cache THEN 'Straight-line distance scores for RTU main campus and Riga Central Station / Origo. OSM infrastructure cache is not available.' END"
#: What the breakdown binding holds by its rule, spelled out.
_LINES = "CASE listing_id % 5 WHEN 2 THEN ['Attic View: unknown', 'Price value: ' || (listing_id % 101) || '.0 - cheap'] WHEN 3 THEN ['Floor: ' || (listing_id % 77) || '.0', 'Useful area: 50.0'] ELSE [] END"
_SECTIONS = {
    "top": ["'Price: ' || " + _EUR("price_eur"), "'Area: ' || CAST(CAST(area_m2 AS BIGINT) AS VARCHAR) || ' m2'", "'Price per m2: ' || " + _PER("ppm2"), "'District: ' || " + _known("district"), "'Street: ' || " + _known("street"), "'Floor: ' || CASE WHEN listing_id % 7 = 0 THEN 'unknown' ELSE concat_ws('/', CAST(listing_id % 9 AS VARCHAR), CASE WHEN listing_id % 2 = 0 THEN '9' END) END", "'Building series: ' || " + _known("series"), "'Building type: ' || CASE WHEN listing_id % 3 = 0 THEN 'Panel' ELSE 'unknown' END", "'Listing date: ' || CASE WHEN listing_id % 4 = 0 THEN '26.11.2026 10:00' ELSE 'unknown' END"],
    "price": ["'Price value score: ' || " + _S("price_value_score"), "'Price per m2 score: ' || " + _S("ppm2_score"), "'Relative market score: ' || " + _S("ppm2_score"), "'Price per effective private room: ' || " + _EUR("ppr"), "'Private room value score: ' || " + _S("room_score"), "'Absolute price score: ' || " + _S("absolute_score"), "'Suspiciously low price: ' || " + _YES("suspicious"), "'Baseline level: ' || " + _known("baseline_level"), "'Baseline sample size: ' || " + _known("baseline_n"), "'Baseline median EUR/m2: ' || " + _PER("baseline_median"), "'Baseline explanation: ' || " + _known("baseline_text", "not calculated yet")],
    "layout": ["'AI-effective private rooms: ' || " + _known("private_rooms"), "'SS-declared rooms: ' || " + _known("declared_rooms"), "'Walkthrough rooms: ' || " + _known("walkthrough_rooms"), "'Kitchen-living detected: ' || " + _YES("kitchen_living"), "'Layout confidence: ' || " + _known("layout_label", "Unknown"), "'Explanation: ' || " + _known("layout_text", "not analyzed yet")],
    "mortgage": ["'Mortgage risk: ' || " + _known("risk", "Unknown"), "'Reasons: ' || " + _known("risk_reasons", "not analyzed yet"), "'Evidence: ' || " + _known("risk_text", "not analyzed yet")],
    "location": ["'Address precision: ' || " + _known("precision"), "'Geocode confidence: ' || " + _known("confidence"), "'Coordinates: ' || coalesce(printf('%.6f, %.6f', lat, lon), 'unknown')", "'Location scores enabled: ' || " + _YES("geo_enabled"), "'Disabled reason: ' || " + _known("geo_reason", "none"), f"'RTU: ' || {_METRES('rtu_distance')} || ', score ' || {_S('rtu_score')}", f"'Central station: ' || {_METRES('station_distance')} || ', score ' || {_S('station_score')}", f"'Grocery shops: nearest ' || {_METRES('nearest_shop')} || ', ' || {_known('shops_1200')} || ' within 1200 m, score ' || {_S('shop_score')}", f"'Public transport: nearest ' || {_METRES('nearest_stop')} || ', ' || {_known('stops_900')} || ' within 900 m, score ' || {_S('transport_score')}", f"'Location explanation: ' || coalesce({_LOCATION_TEXT}, 'not calculated yet')"],
}
_RATING = f"list_concat(['Overall score: ' || {_S('score')}], list_concat(CASE WHEN score_text <> '' THEN ['Explanation: ' || score_text] ELSE [] END, CASE WHEN breakdown IS NOT NULL AND len({_LINES}) > 0 THEN list_concat(['Breakdown:'], {_LINES}) ELSE [] END))"


def _sectioned(spark, sf):
    rows = _detail(spark, sf).withColumns({
        "floor": F.expr("CASE WHEN listing_id % 7 <> 0 THEN listing_id % 9 END"), "floors": F.expr("CASE WHEN listing_id % 2 = 0 THEN 9 END"), "building_type": F.expr("CASE WHEN listing_id % 3 = 0 THEN 'Panel' END"), "date_text": F.expr("CASE WHEN listing_id % 4 = 0 THEN '26.11.2026 10:00' END"),
    })
    return rows


@query(f"{_JOINED} SELECT listing_id, " + ", ".join(f"array_to_string([{', '.join(v)}], '|') AS {k}" for k, v in _SECTIONS.items()) + f", array_to_string({_RATING}, '|') AS rating FROM x")
def detail_sections(spark, sf):
    made = read_models.sections()
    return _sectioned(spark, sf).select("listing_id", *(F.array_join(made[k], "|").alias(k) for k in (*_SECTIONS, "rating")))


@query(f"{_HISTORY}, h AS (SELECT listing_id, count(*) AS n, max((checked_at, event_id)) AS m FROM snapshots GROUP BY listing_id), last AS (SELECT s.* FROM snapshots s JOIN h ON s.listing_id = h.listing_id AND (s.checked_at, s.event_id) = h.m), v AS (SELECT listing_id, count(*) AS n, arg_max(event_type || coalesce(' (' || coalesce(old_value, 'None') || ' -> ' || coalesce(new_value, 'None') || ')', ''), (checked_at, event_id, event_type)) AS t FROM e GROUP BY listing_id) SELECT h.listing_id, concat_ws('|', 'Snapshots: ' || h.n, 'Change events: ' || coalesce(v.n, 0), 'Last checked: ' || strftime(last.checked_at, '%Y-%m-%d %H:%M:%S'), 'Latest price: ' || {_EUR('last.price_eur')}, 'Latest unique visits: ' || {_known('last.visits')}, 'Latest image count: ' || {_known('last.images')}, 'Latest event: ' || v.t) AS lines FROM h JOIN last USING (listing_id) LEFT JOIN v USING (listing_id)")
def history_section(spark, sf):
    nested = _nested(spark, sf)
    rows = nested.withColumn("events", F.coalesce("events", F.array().cast(nested.schema["events"].dataType)))
    return rows.select("listing_id", F.array_join(read_models.sections()["history"], "|").alias("lines"))


_CHIP = "CASE WHEN x IN ('Room conflict', 'High mortgage risk') THEN 'risk' WHEN x IN ('Good price', 'Layout confirmed', 'Strong transport') THEN 'good' ELSE 'neutral' END"
_BADGES = "list_filter([CASE WHEN price_value_score >= 80 THEN 'Good price' END, CASE WHEN transport_score >= 70 THEN 'Strong transport' END, CASE WHEN layout_label = 'Confirmed' THEN 'Layout confirmed' END, CASE WHEN is_favorite THEN 'Favorite' END, CASE WHEN room_conflict THEN 'Room conflict' END, CASE WHEN risk IN ('High', 'Critical') THEN 'High mortgage risk' END], lambda x: x IS NOT NULL)"
_BUCKET = lambda v: f"CASE WHEN {v} IS NULL THEN 'unknown' WHEN {v} >= 80 THEN 'high' WHEN {v} >= 60 THEN 'medium' WHEN {v} >= 40 THEN 'low' ELSE 'very_low' END"
_LOC = "CASE WHEN num > 0 THEN CAST(round(total / num) AS INT) END"
_MORT = "CASE risk WHEN 'Low' THEN 100 WHEN 'Medium' THEN 70 WHEN 'High' THEN 35 WHEN 'Critical' THEN 5 END"
_KM = lambda v: f"CASE WHEN {v} IS NULL THEN '—' WHEN {v} >= 1000 THEN printf('%.1f km', {v} / 1000) ELSE printf('%.0f m', {v}) END"
_TOP = "CASE WHEN breakdown IS NULL THEN '' WHEN listing_id % 5 = 2 THEN 'Price value/' || (listing_id % 101) || '/' || " + _BUCKET("listing_id % 101") + " WHEN listing_id % 5 = 3 AND listing_id % 77 <> 50 THEN 'Floor/' || (listing_id % 77) || '/' || " + _BUCKET("listing_id % 77") + " || ',Useful area/50/low' WHEN listing_id % 5 = 3 THEN 'Floor/50/low,Useful area/50/low' ELSE '' END"


@query(f"{_JOINED}, y AS (SELECT *, coalesce(rtu_score, 0) + coalesce(transport_score, 0) + coalesce(station_score, 0) + coalesce(shop_score, 0) AS total, (rtu_score IS NOT NULL)::INT + (transport_score IS NOT NULL)::INT + (station_score IS NOT NULL)::INT + (shop_score IS NOT NULL)::INT AS num FROM x) SELECT listing_id, coalesce(nullif(district, ''), 'Unknown district') AS district, coalesce(street, 'Unknown street') AS address, house AS house_number, {_thousands('price_eur')} || ' €' AS price, CAST(CAST(area_m2 AS BIGINT) AS VARCHAR) || ' m²' AS area, {_thousands('ppm2')} || ' €/m²' AS price_per_m2, CAST(round(score) AS INT) AS overall_score, {_BUCKET('score')} AS score_bucket, array_to_string(list_transform({_BADGES}, lambda x: x || '/' || {_CHIP}), ',') AS badges, concat_ws(',', 'Price to value/' || coalesce(CAST(CAST(round(price_value_score) AS INT) AS VARCHAR), '-') || '/' || {_BUCKET('price_value_score')}, 'Location viability/' || coalesce(CAST({_LOC} AS VARCHAR), '-') || '/' || {_BUCKET(f'({_LOC})')}, 'Mortgage suitability/' || coalesce(CAST({_MORT} AS VARCHAR), '-') || '/' || {_BUCKET(f'({_MORT})')}) AS evaluation, {_TOP} AS breakdown, coalesce(nullif(trim(score_text), ''), nullif(trim(layout_text), ''), nullif(trim(baseline_text), ''), '') AS ai_insight, concat_ws('/', coalesce(CAST(private_rooms AS VARCHAR), '—'), CAST(declared_rooms AS VARCHAR), coalesce(CAST(walkthrough_rooms AS VARCHAR), '—'), CAST(kitchen_living AS VARCHAR), coalesce(layout_label, 'Unknown'), {_known('layout_text', 'not analyzed yet')}) AS layout, floor_plan_path AS floor_plan, concat_ws('/', coalesce(risk, 'Unknown'), CASE risk WHEN 'Low' THEN 'risk-low' WHEN 'Medium' THEN 'risk-medium' WHEN 'High' THEN 'risk-high' WHEN 'Critical' THEN 'risk-high' ELSE 'neutral' END, CASE WHEN risk IS NULL THEN 'not analyzed yet' ELSE coalesce(risk_text, risk_reasons, 'not analyzed yet') END) AS mortgage, concat_ws('/', {_KM('rtu_distance')}, {_KM('station_distance')}, {_KM('nearest_shop')}, {_KM('nearest_stop')}) AS proximity, coalesce(notes, '') AS notes, is_favorite, is_rejected, coalesce(nullif(series, ''), CASE WHEN listing_id % 3 = 0 THEN 'Panel' ELSE 'unknown' END) AS building_series FROM y")
def detail_payload(spark, sf):
    rows = _sectioned(spark, sf).withColumns({"url": F.lit(""), "description": F.lit(None).cast("string"), "history": F.array(), "events": F.array()})
    made = read_models.payload()
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    joined = lambda c, *names: F.array_join(F.transform(c, lambda x: F.concat_ws("/", *(dash(x[n]) for n in names))), ",")
    flat = lambda c, *names: F.concat_ws("/", *(c[n].cast("string") for n in names))
    said = made | {
        "badges": joined(made["badges"], "label", "type"), "evaluation": joined(made["evaluation"], "label", "value", "bucket"), "breakdown": joined(made["breakdown"], "label", "value", "bucket"),
        "layout": flat(made["layout"], "ai_rooms", "ss_rooms", "walkthrough", "kitchen_living", "confidence", "explanation"), "mortgage": flat(made["mortgage"], "level", "type", "text"), "proximity": flat(made["proximity"], "rtu", "station", "shop", "stop"),
    }
    return rows.select("listing_id", *(v.alias(k) for k, v in said.items() if k not in ("url", "history", "source_text")))


@query(f"{_JOINED}, c AS (SELECT * FROM x WHERE listing_id IN (3, 8, 12, 26, 44)), r AS (" + " UNION ALL ".join(f"SELECT listing_id, {i} AS row, '{n}' AS label, {v} AS value FROM c" for i, (n, v) in enumerate((
    ("Price", f"{_thousands('price_eur')} || ' €'"), ("EUR/m2", f"{_thousands('ppm2')} || ' €/m²'"), ("Area", "CAST(CAST(area_m2 AS BIGINT) AS VARCHAR) || ' m²'"), ("Score", "coalesce(CAST(CAST(round(score) AS INT) AS VARCHAR), '—')"),
    ("AI-effective rooms", "coalesce(private_rooms || ' private' || CASE WHEN kitchen_living THEN ' + kitchen-living' ELSE '' END, 'unclear')"), ("Mortgage risk", "coalesce(risk, 'Unknown')"), ("Building / series", "coalesce(nullif(series, ''), CASE WHEN listing_id % 3 = 0 THEN 'Panel' ELSE 'unknown' END)"),
    ("Flags", "coalesce(nullif(concat_ws(', ', CASE WHEN is_favorite THEN 'Favorite' END, CASE WHEN private_rooms <> declared_rooms THEN 'Room conflict' END, CASE WHEN kitchen_living THEN 'Kitchen-living' END, CASE WHEN risk IN ('High', 'Critical') THEN 'High mortgage risk' END), ''), 'none')"),
))) + ") SELECT row, label, " + ", ".join(f"max(value) FILTER (WHERE listing_id = {k}) AS l{i}" for i, k in enumerate((26, 3, 44, 8, 12), 1)) + " FROM r GROUP BY row, label")
def comparison_short(spark, sf):
    """Six are asked for, the first five are compared."""
    return read_models.short_comparison(_sectioned(spark, sf), [26, 3, 44, 8, 12, 50])


# ---- queues --------------------------------------------------------------------------------------------------

_TITLE = "coalesce(nullif(concat_ws(', ', nullif(district, ''), nullif(concat_ws(' ', nullif(street, ''), nullif(house, '')), '')), ''), nullif(title, ''), 'SS ' || ss_id)"
_QUEUED = "SELECT listing_id, status, CASE WHEN listing_id % 3 <> 0 THEN district END AS district, CASE WHEN listing_id % 2 = 0 THEN street END AS street, CASE WHEN listing_id % 5 = 0 THEN house END AS house, CASE WHEN listing_id % 4 <> 0 THEN 'Flat' ELSE '' END AS title, listing_id * 7 AS ss_id, CASE WHEN listing_id % 10 <> 3 THEN price_eur END AS price_eur, area_m2 + (listing_id % 3) * 0.5 AS area_m2, declared_rooms, listing_id % 4 = 0 AS needs_ai, CASE WHEN listing_id % 9 <> 0 THEN 'text' END AS description, CASE WHEN listing_id % 2 = 0 THEN listing_id % 100 END AS last_seen, CASE WHEN listing_id % 3 = 0 THEN listing_id % 50 END AS updated, listing_id % 30 AS first_seen"
_AREA = "CASE WHEN area_m2 = floor(area_m2) THEN CAST(CAST(area_m2 AS BIGINT) AS VARCHAR) ELSE printf('%.1f', area_m2) END"


def _queued(spark, sf):
    return bind(spark, sf, "market").selectExpr(*split_columns(_QUEUED.removeprefix("SELECT ")))


@query(f"{STAR}, q AS ({_QUEUED} FROM market), d AS (SELECT DISTINCT listing_id FROM ai WHERE state = 'finished'), r AS (SELECT q.*, d.listing_id IS NOT NULL AS done, q.listing_id % 6 = 0 AS wanted, coalesce(last_seen, updated, first_seen) AS seen FROM q LEFT JOIN d USING (listing_id) WHERE status = 'active' AND description IS NOT NULL), f AS (SELECT *, needs_ai OR NOT done AS pending, wanted AND done AS again FROM r WHERE needs_ai OR NOT done OR (wanted AND done)) SELECT listing_id, CAST(row_number() OVER (ORDER BY pending DESC, seen DESC, listing_id DESC) AS INT) AS position, CASE WHEN again THEN 'reanalyze' ELSE 'pending' END AS status, {_TITLE} AS title, concat_ws(' · ', {_thousands('price_eur')} || ' €', {_AREA} || ' m²', 'SS ' || declared_rooms) AS meta FROM f")
def analysis_queue(spark, sf):
    rows = _queued(spark, sf)
    again = rows.where("listing_id % 6 = 0").select("listing_id")
    queue = read_models.analysis_queue(rows, bind(spark, sf, "ai"), again)
    found = ranking.positions(queue, read_models.queue_order())
    return found.select("listing_id", "position", "status", read_models.short_title().alias("title"), read_models.short_meta().alias("meta"))


@query(f"{STAR}, d AS (SELECT DISTINCT listing_id FROM ai WHERE state = 'finished' AND stove) SELECT listing_id FROM market WHERE status = 'active' AND listing_id NOT IN (SELECT listing_id FROM d) AND listing_id % 7 <> 0")
def queue_in_scope(spark, sf):
    rows = bind(spark, sf, "market")
    done = bind(spark, sf, "ai").where("state = 'finished' AND stove").select("listing_id").distinct()
    pending = star.without_match(rows, done, "listing_id")
    return read_models.in_scope(rows.where("status = 'active'").select("listing_id"), pending, rows.where("listing_id % 7 = 0"))


@query(f"{STAR}, q AS ({_QUEUED} FROM market) SELECT listing_id, {_TITLE} AS label FROM q")
def progress_labels(spark, sf):
    return _queued(spark, sf).select("listing_id", read_models.short_title().alias("label"))


@query(f"{STAR} SELECT listing_id, {_LOCATION_TEXT} AS explanation FROM location")
def location_texts(spark, sf):
    return bind(spark, sf, "location").select("listing_id", read_models.location_text().alias("explanation"))


# ---- changes of stored tables --------------------------------------------------------------------------------

_U = ctes("users")
_STATE = "listing_id, is_favorite, is_rejected, is_viewed, user_status"


def _states(spark, sf):
    return bind(spark, sf, "users").where("stored").drop("stored")


@query(f"{_U}, n AS (SELECT p_partkey AS listing_id, CASE WHEN p_partkey % 2 = 0 THEN '  see ' || p_size || ' ' ELSE '   ' END AS notes FROM part WHERE p_partkey % 4 < 2), s AS (SELECT * FROM users WHERE stored) SELECT coalesce(s.listing_id, n.listing_id) AS listing_id, coalesce(is_favorite, false) AS is_favorite, coalesce(is_rejected, false) AS is_rejected, coalesce(is_viewed, false) AS is_viewed, coalesce(user_status, 'unseen') AS user_status, CASE WHEN n.listing_id IS NOT NULL THEN nullif(trim(n.notes), '') ELSE s.notes END AS notes FROM s FULL JOIN n ON s.listing_id = n.listing_id")
def notes_updated(spark, sf):
    notes = load(spark, sf, "part").where("p_partkey % 4 < 2").selectExpr("p_partkey AS listing_id", "CASE WHEN p_partkey % 2 = 0 THEN concat('  see ', p_size, ' ') ELSE '   ' END AS notes")
    return mutations.notes_updated(_states(spark, sf), notes)


_FULL = f"{_U}, s AS (SELECT * FROM users WHERE stored), o AS (SELECT p_partkey AS listing_id FROM part WHERE p_partkey % 2 = 0), j AS (SELECT coalesce(s.listing_id, o.listing_id) AS listing_id, coalesce(is_favorite, false) AS f, coalesce(is_rejected, false) AS r, coalesce(is_viewed, false) AS v, coalesce(user_status, 'unseen') AS s, o.listing_id IS NOT NULL AS own FROM s FULL JOIN o ON s.listing_id = o.listing_id)"


def _even(spark, sf):
    return load(spark, sf, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("listing_id"))


@query(f"{_FULL} SELECT listing_id, f AS is_favorite, r AS is_rejected, v OR (own AND NOT f AND NOT r) AS is_viewed, CASE WHEN own AND NOT f AND NOT r THEN 'viewed' ELSE s END AS user_status FROM j")
def opened_marks_viewed(spark, sf):
    return mutations.opened(_states(spark, sf), _even(spark, sf)).select(*_STATE.split(", "))


@query(f"{_FULL} SELECT listing_id, CASE WHEN own THEN NOT f ELSE f END AS is_favorite, r AS is_rejected, v AS is_viewed, CASE WHEN NOT own THEN s WHEN NOT f THEN 'favorite' WHEN r THEN 'rejected' WHEN v THEN 'viewed' ELSE 'unseen' END AS user_status FROM j")
def toggled_favorites(spark, sf):
    return mutations.toggled(_states(spark, sf), _even(spark, sf), "favorite").select(*_STATE.split(", "))


@query(f"{_FULL} SELECT listing_id, f AS is_favorite, CASE WHEN own THEN NOT r ELSE r END AS is_rejected, v AS is_viewed, CASE WHEN NOT own THEN s WHEN NOT r THEN 'rejected' WHEN f THEN 'favorite' WHEN v THEN 'viewed' ELSE 'unseen' END AS user_status FROM j")
def toggled_rejected(spark, sf):
    return mutations.toggled(_states(spark, sf), _even(spark, sf), "rejected").select(*_STATE.split(", "))


_I = ctes("images")


@query(f"{_I} SELECT listing_id, image_id, path FROM images WHERE listing_id % 3 <> 0 UNION ALL SELECT l_partkey, l_orderkey * 10 + l_linenumber, '/new/' || l_linenumber FROM lineitem WHERE l_partkey % 3 = 0 AND l_partkey % 6 = 0 AND l_linenumber <= 2")
def children_replaced(spark, sf):
    own = bind(spark, sf, "images").select("listing_id", "image_id", "path")
    given = own.where("listing_id % 3 = 0").where("listing_id % 6 = 0 AND image_id % 10 <= 2").select("listing_id", "image_id", F.concat(F.lit("/new/"), (F.col("image_id") % 10).cast("string")).alias("path"))
    emptied = own.where("listing_id % 3 = 0").select("listing_id").distinct().selectExpr("listing_id", "CAST(null AS bigint) AS image_id", "CAST(null AS string) AS path")
    return mutations.children_replaced(own, given.unionByName(emptied))


_CLASS = "CASE image_id % 10 WHEN 1 THEN 'kitchen' WHEN 2 THEN 'floor_plan' WHEN 3 THEN 'corridor_or_hallway' END"


@query(f"{_I} SELECT listing_id, image_id, is_floor_plan OR (image_id % 10 = 2 AND listing_id % 5 <> 0) AS is_floor_plan, CASE WHEN listing_id % 5 <> 0 THEN {_CLASS} END AS category, CASE WHEN image_id % 4 = 0 THEN 'hash' || image_id END AS content_hash FROM images")
def images_classified(spark, sf):
    own = bind(spark, sf, "images")
    answers = own.where("image_id % 10 <= 3").select(F.when(F.col("listing_id") % 5 == 0, -1).otherwise(F.col("listing_id")).alias("listing_id"), F.col("image_id").cast("string").alias("image_id"), F.expr(_CLASS).alias("category"))
    odd = own.where("image_id % 10 = 4").select("listing_id", F.concat(F.lit("img-"), F.col("image_id")).alias("image_id"), F.lit("kitchen").alias("category"))
    hashes = own.where("image_id % 4 = 0").select("listing_id", "image_id", F.concat(F.lit("hash"), F.col("image_id")).alias("content_hash"))
    return mutations.images_classified(own, answers.unionByName(odd), hashes).select("listing_id", "image_id", "is_floor_plan", "category", "content_hash")


_A = ctes("ai", "market")


@query(f"{_A} SELECT listing_id, version, state, layout_label, CAST(NULL AS VARCHAR) AS error FROM ai UNION ALL SELECT listing_id, 1, 'finished', 'Likely', NULL FROM market WHERE listing_id % 3 = 0 UNION ALL SELECT listing_id, 1, 'failed', NULL, 'no answer' FROM market WHERE listing_id % 3 = 1")
def analyses_saved(spark, sf):
    stored = bind(spark, sf, "ai").select("listing_id", "version", "state", "layout_label").withColumn("error", F.lit(None).cast("string"))
    rows = bind(spark, sf, "market").select("listing_id", F.lit(1).cast("long").alias("version"))
    return mutations.analyses_saved(stored, rows.where("listing_id % 3 = 0").withColumn("layout_label", F.lit("Likely")), rows.where("listing_id % 3 = 1").withColumn("error", F.lit("no answer")))


@query(f"{_A} SELECT listing_id, listing_id % 4 <> 1 AND listing_id % 3 <> 0 AS needs_ai FROM market")
def marks_cleared(spark, sf):
    rows = bind(spark, sf, "market").selectExpr("listing_id", "listing_id % 4 <> 1 AS needs_ai")
    return mutations.marks_cleared(rows, rows.where("listing_id % 3 = 0"))


_OLD = "SELECT c_custkey AS session_id, 'session ' || c_custkey AS session_name, c_mktsegment AS profile_key, '{}' AS filters, 'score' AS sort_mode, '[]' AS hidden, c_custkey % 10 AS created_at, c_custkey % 20 AS updated_at FROM customer"
_NEW = "SELECT 'session ' || (s_suppkey * 7) AS session_name, 'best_price' AS profile_key, '{\"price_max\": ' || s_suppkey || '}' AS filters, 'area' AS sort_mode, '[\"rejected\"]' AS hidden, 100 AS given_at FROM supplier UNION ALL SELECT 'own ' || s_suppkey, NULL, '{}', NULL, '[]', 101 FROM supplier"
_SAVED = f"WITH old AS ({_OLD}), given AS ({_NEW}), top AS (SELECT max(session_id) AS m FROM old), fresh AS (SELECT * FROM given WHERE session_name NOT IN (SELECT session_name FROM old)), saved AS (SELECT session_id, session_name, CASE WHEN given_at IS NULL THEN o.profile_key ELSE g.profile_key END AS profile_key, CASE WHEN given_at IS NULL THEN o.filters ELSE g.filters END AS filters, CASE WHEN given_at IS NULL THEN o.sort_mode ELSE g.sort_mode END AS sort_mode, CASE WHEN given_at IS NULL THEN o.hidden ELSE g.hidden END AS hidden, CAST(created_at AS BIGINT) AS created_at, CAST(coalesce(given_at, updated_at) AS BIGINT) AS updated_at FROM old o LEFT JOIN given g USING (session_name) UNION ALL SELECT m + row_number() OVER (ORDER BY session_name), session_name, profile_key, filters, sort_mode, hidden, given_at, given_at FROM fresh, top)"


def _sessions(spark, sf):
    old = load(spark, sf, "customer").selectExpr("c_custkey AS session_id", "concat('session ', c_custkey) AS session_name", "c_mktsegment AS profile_key", "'{}' AS filters", "'score' AS sort_mode", "'[]' AS hidden", "c_custkey % 10 AS created_at", "c_custkey % 20 AS updated_at")
    own = load(spark, sf, "supplier")
    given = own.selectExpr("concat('session ', s_suppkey * 7) AS session_name", "'best_price' AS profile_key", "concat('{\"price_max\": ', s_suppkey, '}') AS filters", "'area' AS sort_mode", "'[\"rejected\"]' AS hidden", "100L AS at")
    given = given.unionByName(own.selectExpr("concat('own ', s_suppkey) AS session_name", "CAST(null AS string) AS profile_key", "'{}' AS filters", "CAST(null AS string) AS sort_mode", "'[]' AS hidden", "101L AS at"))
    return mutations.sessions_saved(old, given)


@query(f"{_SAVED} SELECT * FROM saved")
def sessions_saved(spark, sf):
    return _sessions(spark, sf)


@query(f"{_SAVED} SELECT session_id, session_name, CAST(row_number() OVER (ORDER BY updated_at DESC, session_id DESC) AS INT) AS position FROM saved")
def session_order(spark, sf):
    return ranking.positions(_sessions(spark, sf), mutations.session_order()).select("session_id", "session_name", "position")


_IMPORTANCE = {v: k for k, v in scoring.IMPORTANCE.items()}
_BUILTIN = " UNION ALL ".join("SELECT '" + p + "' AS profile_key, '" + p.replace("_", " ").capitalize() + "' AS profile_name, CAST(NULL AS VARCHAR) AS base_profile_key, '{" + ", ".join(f'"{b}": "{_IMPORTANCE[w]}"' for b, w in sorted(zip(scoring.BLOCKS, ws, strict=True)) if w) + "}' AS weights, true AS is_builtin" for p, ws in scoring.PROFILES.items())
_CUSTOM = "SELECT 'custom_' || n_nationkey, 'Mine ' || n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'best_price' END, CASE n_nationkey % 3 WHEN 0 THEN '{\"price_value\": \"Critical\", \"floor\": \"Huge\", \"attic\": \"Weak\"}' WHEN 1 THEN '{}' END, false FROM nation"
_PROFILES = f"WITH p AS ({_BUILTIN} UNION ALL {_CUSTOM})"


def _profiles(spark, sf):
    own = load(spark, sf, "nation").selectExpr("concat('custom_', n_nationkey) AS profile_key", "concat('Mine ', n_name) AS profile_name", "CASE WHEN n_nationkey % 2 = 0 THEN 'best_price' END AS base_profile_key", "CASE n_nationkey % 3 WHEN 0 THEN '{\"price_value\": \"Critical\", \"floor\": \"Huge\", \"attic\": \"Weak\"}' WHEN 1 THEN '{}' END AS weights", "false AS is_builtin")
    return own, profiles.known(own)


@query(f"{_PROFILES} SELECT * FROM p")
def profile_lookup(spark, sf):
    return _profiles(spark, sf)[1]


@query(f"{_PROFILES} SELECT profile_key, CAST(row_number() OVER (ORDER BY is_builtin DESC, profile_name) AS INT) AS position FROM p")
def profile_order(spark, sf):
    return ranking.positions(_profiles(spark, sf)[1], profiles.profile_order()).select("profile_key", "position")


_LABELS = ", ".join(f"({i}, '{b}', '{t}')" for i, (b, t) in enumerate(read_models.BLOCK_LABELS.items(), 1))
_LEVEL = "coalesce(CASE WHEN json_extract_string(weights, '$.' || block) IN ('Ignore', 'Weak', 'Medium', 'Strong', 'Critical') THEN json_extract_string(weights, '$.' || block) END, 'Ignore')"


@query(f"{_PROFILES} SELECT profile_key, profile_name AS name, is_builtin, position, block, label, {_LEVEL} AS importance FROM p, (VALUES {_LABELS}) AS b(position, block, label)")
def profile_editor(spark, sf):
    return profiles.editor(_profiles(spark, sf)[1])


@query(f"{_PROFILES} SELECT profile_key, block AS block_key, CASE {_LEVEL} WHEN 'Weak' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Strong' THEN 3 WHEN 'Critical' THEN 5 ELSE 0 END AS weight FROM p, (VALUES {_LABELS}) AS b(position, block, label)")
def profile_weights(spark, sf):
    return profiles.weights_of(_profiles(spark, sf)[1])


@query(f"{_PROFILES} SELECT profile_key, profile_name, base_profile_key, weights, is_builtin FROM p WHERE NOT is_builtin AND profile_key <> 'custom_3' UNION ALL SELECT 'custom_my_best_picks', 'My Best Picks!', 'best_price', '{{\"price_value\":\"Strong\",\"useful_area\":\"Weak\"}}', false UNION ALL SELECT 'custom_3', '3', NULL, '{{}}', false")
def profile_saved(spark, sf):
    raw = spark.createDataFrame([("best_price", " My Best Picks!", {"useful_area": "Weak", "price_value": "Strong", "floor": "Huge", "attic": "Weak"}), ("no_such", "3", {})], "base_key string, name string, importance map<string,string>")
    return profiles.saved(_profiles(spark, sf)[0], raw)


_PR = ctes("profiled")


@query(f"{_PROFILES} SELECT profile_key, CASE WHEN profile_key = 'custom_7' THEN 'Renamed' ELSE profile_name END AS profile_name FROM p WHERE profile_key <> 'custom_5'")
def profile_deleted_and_renamed(spark, sf):
    rows = _profiles(spark, sf)[1]
    for key in ("custom_5", "best_price"):
        rows, _ = mutations.profile_deleted(rows, bind(spark, sf, "profiled"), key)
    return mutations.profile_renamed(mutations.profile_renamed(rows, "custom_7", "Renamed"), "best_price", "Renamed").select("profile_key", "profile_name")


@query(f"{_PR} SELECT listing_id, profile_key, score FROM profiled WHERE profile_key <> 'best_price'")
def scores_of_deleted_profile(spark, sf):
    return mutations.profile_deleted(_profiles(spark, sf)[1], bind(spark, sf, "profiled"), "best_price")[1].select("listing_id", "profile_key", "score")


_PRIORS = ", ".join(f"('{p[0]}', '{p[1]}', '{p[3]:.0f}-{p[4]:.0f}', {p[5]})" for p in star.PRIORS)


@query(f"SELECT * FROM (VALUES {_PRIORS}) AS t(series, building_type, area_range, rooms)")
def priors_seeded(spark, sf):
    """The bundled priors go into an empty table; a second time they change nothing."""
    made = star.prior_prompts(spark)
    stored = mutations.seeded(made.limit(0), made)
    again = mutations.seeded(stored, made.limit(1))
    return again.select("series", "building_type", F.col("typical_area_range_m2").alias("area_range"), F.col("typical_room_count").alias("rooms"))


@query("WITH e AS (SELECT o_orderkey AS run_id, o_orderdate AS started_at FROM orders), f AS (SELECT o_orderkey AS run_id, o_orderdate + INTERVAL 1 HOUR AS finished_at, CASE WHEN o_orderkey % 5 = 0 THEN 'broken' END AS error FROM orders WHERE o_orderkey % 3 <> 0) SELECT run_id, started_at, finished_at, CASE WHEN finished_at IS NULL THEN 'running' WHEN error IS NOT NULL THEN 'failed' ELSE 'finished' END AS status, error FROM e LEFT JOIN f USING (run_id)")
def run_log(spark, sf):
    own = load(spark, sf, "orders")
    ended = own.where("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS run_id", "o_orderdate + INTERVAL 1 HOUR AS finished_at", "CASE WHEN o_orderkey % 5 = 0 THEN 'broken' END AS error")
    return mutations.run_log(own.selectExpr("o_orderkey AS run_id", "o_orderdate AS started_at"), ended)


@query(f"{_PR}, f AS (SELECT p_partkey AS listing_id, 'best_price' AS profile_key, CAST(p_size AS DOUBLE) AS score FROM part WHERE p_partkey % 3 = 0) SELECT listing_id, profile_key, score FROM profiled WHERE (listing_id, profile_key) NOT IN (SELECT (listing_id, profile_key) FROM f) UNION ALL SELECT * FROM f")
def scores_replaced(spark, sf):
    fresh = load(spark, sf, "part").where("p_partkey % 3 = 0").selectExpr("p_partkey AS listing_id", "'best_price' AS profile_key", "CAST(p_size AS double) AS score")
    return mutations.scores_replaced(bind(spark, sf, "profiled").select("listing_id", "profile_key", "score"), fresh)


_STORED = "WITH r AS (" + _UPSERT.replace("coalesce(NOT has_o OR contains(events, 'description_changed') OR contains(events, 'image_count_changed'), false) AS needs_ai", "coalesce(NOT has_o OR listing_id % 4 = 0 OR contains(events, 'description_changed') OR contains(events, 'image_count_changed'), false) AS needs_ai, has_o AND has_n AND listing_id % 3 = 0 AS reactivated") + ")"


def _stored_upsert(spark, sf):
    stored, incoming = _halves(spark, sf)
    stored = stored.withColumns({"status": F.when(F.col("listing_id") % 3 == 0, "inactive").otherwise("active"), "needs_ai": F.col("listing_id") % 4 == 0})
    return changes.upsert(stored, incoming)


@query(f"{_STORED} SELECT listing_id, needs_ai, reactivated, outcome FROM r")
def upsert_marks(spark, sf):
    """Stored marks stay; listings that were inactive come again."""
    return _stored_upsert(spark, sf).select("listing_id", "needs_ai", "reactivated", "outcome")


_EXTRA = {"house": "CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 90 AS VARCHAR(9)) END", "building_type": "CASE WHEN event_id % 3 <> 0 THEN 'Panel' END"}
_BOTH = _UPSERT[_UPSERT.index(",\nboth_sides") :].replace("n.has_detail,", "n.has_detail, " + ", ".join(f"o.{c} AS o_{c}, n.{c}" for c in _EXTRA) + ",", 1)
_PARTIAL = _UPSERT[: _UPSERT.index(",\nboth_sides")].replace("SELECT * FROM snapshots, cut", "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _EXTRA.items()) + " FROM snapshots, cut") + _BOTH[: _BOTH.index("SELECT listing_id, CASE WHEN NOT has_n THEN 'missing'")]


@query(f"{_PARTIAL} SELECT listing_id, " + ", ".join(f"CASE WHEN has_n THEN {c} ELSE o_{c} END AS {c}" for c in _EXTRA) + ", CASE WHEN has_n AND (has_detail OR NOT has_o) THEN sha256(description) ELSE sha256(o_description) END AS description FROM both_sides")
def upsert_partial(spark, sf):
    """A payload without a detail page keeps the description but overwrites house number and building type, even with null."""
    stored, incoming = (h.withColumns({k: F.expr(v) for k, v in _EXTRA.items()}) for h in _halves(spark, sf))
    rows = changes.upsert(stored, incoming, ("price_eur", "visits", "description", "images", *_EXTRA))
    return rows.select("listing_id", *_EXTRA, F.sha2("description", 256).alias("description"))


@query(f"{_STORED} SELECT listing_id, 'listing_reactivated' AS event_type, TIMESTAMP '2026-01-02 03:04:05' AS reactivated_at FROM r WHERE reactivated")
def reactivations(spark, sf):
    return changes.reactivations(_stored_upsert(spark, sf), "2026-01-02 03:04:05").withColumn("reactivated_at", F.col("reactivated_at").cast("timestamp_ntz"))


@query(f"{_STORED} SELECT count(*) FILTER (WHERE outcome <> 'missing') AS seen, count(*) FILTER (WHERE outcome <> 'missing') AS stored, count(*) FILTER (WHERE outcome = 'new') AS new, count(*) FILTER (WHERE outcome = 'changed') AS changed, count(*) FILTER (WHERE outcome = 'missing') AS inactive, count(*) FILTER (WHERE reactivated) AS reactivated, (SELECT count(*) FROM events WHERE event_id % 11 = 0) AS failed FROM r")
def run_counters_full(spark, sf):
    failed = load(spark, sf, "events").selectExpr("user_id AS listing_id", "CASE WHEN event_id % 11 = 0 THEN 'gone' END AS error")
    return changes.all_counters(_stored_upsert(spark, sf), failed)

