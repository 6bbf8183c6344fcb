"""Queries over pages, answers, payloads and texts that are composed from the test tables, with the SQL that they must agree with."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import text
from ..operators import analysis, filters, mutations, pages, places, scoring, star, views
from ..operators.filters import FilterSpec
from ..sources.bindings import bind, ctes, load
from .queries import _overall, M, query, SCORED

# ---- pages ---------------------------------------------------------------------------------------------------

_ROW = "concat('<html><table><tr id=\"tr_', p_partkey, '\"><td><input></td><td></td><td><a class=\"am\" href=\"/msg/', p_partkey, '.html\">', p_name, ' &amp;&nbsp; co</a></td><td>', p_brand, '<br>', p_type, '</td><td>', p_size % 5, '</td><td>', p_size, '</td><td>', p_size % 9, '/9</td><td>602</td><td>', p_size * 1000, ' €</td><td></td></tr><tr id=\"tr_\"><td>x</td></tr><tr id=\"tr_0\"><td>short</td></tr></table>')"


@query("SELECT 'http://h/page' || p_partkey || '.html' AS page_url, 0 AS pos, CAST(p_partkey AS VARCHAR) AS ss_id, 'http://h/msg/' || p_partkey || '.html' AS url, p_name || ' & co' AS title, p_brand AS district, p_type AS street, CAST(p_size % 5 AS VARCHAR) AS rooms_text, CAST(p_size AS VARCHAR) AS area_text, (p_size % 9) || '/9' AS floor_text, '602' AS series, (p_size * 1000) || ' €' AS eighth, 9 + 1 AS n_cells FROM part")
def list_pages(spark, sf):
    df = load(spark, sf, "part").selectExpr("concat('http://h/page', p_partkey, '.html') AS url", f"{_ROW} AS html")
    rows = pages.parse_list_pages(df)
    return rows.select("page_url", "pos", "ss_id", "url", "title", "district", "street", "rooms_text", "area_text", "floor_text", "series", F.col("cells")["price"].alias("eighth"), F.size("cells").alias("n_cells"))


_DETAIL_PAGE = "concat('<div id=\"msg_div_msg\">', p_name, ' <b>', p_type, '</b> of<br>  ', p_brand, '<table class=\"options_list\"><tr><td>Iela:</td><td>Stabu iela ', p_size, ' [ Karte ]</td></tr><tr><td>Istabas:</td><td>1</td></tr><tr><td>Istabas:</td><td>', p_size % 5, '</td></tr></table></div><p>Datums: 0', 1 + p_size % 9, '.02.2024 10:00 <b>Unikālo apmeklējumu skaits: ', p_partkey, ' x</p><a href=\"https://h/gallery/', p_partkey, '/a.JPG?x\">1</a><a href=\"https://h/gallery/b.gif\">1</a><a href=\"https://h/gallery/', p_partkey, '/a.JPG?x\">1</a>')"


@query("SELECT p_partkey AS listing_id, p_name || chr(10) || p_type || chr(10) || 'of' || chr(10) || p_brand AS description, 'Stabu iela ' || p_size AS address_text, CAST(p_size % 5 AS VARCHAR) AS rooms_text, '0' || (1 + p_size % 9) || '.02.2024 10:00' AS date_text, p_partkey AS visits, 'https://h/gallery/' || p_partkey || '/a.JPG?x' AS images, 2 AS n_fields FROM part")
def detail_pages(spark, sf):
    df = load(spark, sf, "part").selectExpr("CAST(p_partkey AS string) AS url", f"{_DETAIL_PAGE} AS html")
    rows = pages.parse_detail_pages(df)
    return rows.select(F.col("url").cast("long").alias("listing_id"), F.regexp_replace("description", " +\n", "\n").alias("description"), "address_text", "rooms_text", "date_text", "visits", F.array_join("images", ",").alias("images"), F.size("fields").alias("n_fields"))


_NAV = "concat('<button class=\"navia\">', p_size, '</button><a name=\"nav_id\" rel=\"prev\" href=\"page', p_size - 1, '.html\">Iepriekšējie</a><a class=\"navi\" href=\"page', p_size + 3, '.html\">', p_size + 3, '</a><a href=\"/x/page', p_size + 2, '.html?a=1#f\">', p_size + 2, '</a>', CASE WHEN p_partkey % 3 = 0 THEN concat('<a rel=\"next\" href=\"page', p_size + 1, '.html\">tālāk</a>') ELSE '' END, '<a href=\"/msg/page.html\">no</a>')"


@query("SELECT p_partkey, 'http://h/x/page' || (p_size + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END) || '.html' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '?a=1#f' END AS next_url, CAST(p_size + 3 AS BIGINT) AS max_page FROM part")
def navigation(spark, sf):
    df = load(spark, sf, "part").selectExpr("concat('http://h/x/page', p_size, '.html?id=', p_partkey) AS url", f"{_NAV} AS html")
    return pages.page_navigation(df).select(F.substring_index("url", "=", -1).cast("long").alias("p_partkey"), "next_url", "max_page")


# ---- answers and payloads --------------------------------------------------------------------------------------

_GOOD = {"ai_detected_living_rooms": 2, "effective_private_rooms": 1, "walkthrough_rooms": None, "kitchen_living_detected": True, "layout_class": " open ", "layout_confidence_label": "Likely", "ss_vs_ai_room_conflict": 0, "layout_explanation_user": " two rooms ", "floor_plan_image_ids": [" 1 ", ""], "wooden_building_risk": "yes", "mortgage_risk_level": "Low", "mortgage_risk_reasons": None, "mortgage_explanation_user": "fine"}
#: Answers by number, and what is wrong with each.
_ANSWERS = (
    (_GOOD, ""), (_GOOD | {"effective_private_rooms": True}, "effective_private_rooms: whole number expected"), (_GOOD | {"layout_confidence_label": "Sure", "series_guess": 602}, "layout_confidence_label: not in its domain; series_guess: text expected"),
    ({}, "layout_confidence_label: not in its domain; layout_explanation_user: text missing; mortgage_risk_level: not in its domain; mortgage_explanation_user: text missing"), (_GOOD | {"floor_plan_image_ids": [1]}, "floor_plan_image_ids: list of texts expected"),
    ([_GOOD], "not an object"), (_GOOD | {"mortgage_explanation_user": "  "}, "mortgage_explanation_user: text missing"),
)


@query("WITH a(k, errors) AS (VALUES " + ", ".join(f"({i}, '{e}')" for i, (_, e) in enumerate(_ANSWERS)) + ") SELECT p_partkey, errors, CASE WHEN k IN (0, 2, 4, 6) THEN 1::BIGINT END AS effective_private_rooms, CASE WHEN k IN (0, 1, 4, 6) THEN 'Likely' END AS layout_confidence_label, CASE WHEN k NOT IN (3, 5) THEN 'open' END AS layout_class, CASE WHEN k NOT IN (3, 5) THEN 'two rooms' END AS layout_explanation_user, k NOT IN (3, 5) AS wooden_building_risk, false AS ss_vs_ai_room_conflict, CASE WHEN k IN (3, 4, 5) THEN '' ELSE '1' END AS floor_plan_image_ids FROM part JOIN a ON p_partkey % 7 = k")
def second_answers(spark, sf):
    answers = F.array(*(F.lit(json.dumps(a)) for a, _ in _ANSWERS))
    df = load(spark, sf, "part").select("p_partkey", F.element_at(answers, (F.col("p_partkey") % 7 + 1).cast("int")).alias("raw"))
    rows = analysis.validated_pass2(df)
    return rows.select("p_partkey", F.array_join("errors", "; ").alias("errors"), "effective_private_rooms", "layout_confidence_label", "layout_class", "layout_explanation_user", "wooden_building_risk", "ss_vs_ai_room_conflict", F.array_join("floor_plan_image_ids", ",").alias("floor_plan_image_ids"))


_IMAGE = {"image_id": "1", "category": "kitchen", "useful_for_layout": 1, "likely_room_group": " r "}
_FIRST = (
    ({"images": [_IMAGE], "image_groups_by_room": {"r": ["1", " "]}}, "", "kitchen", "r=1"), ({"images": [_IMAGE, _IMAGE | {"category": "cellar"}], "ignored_images": "1"}, "images.category: not in its domain; ignored_images: list of texts expected", "kitchen,", ""),
    ({"image_groups_by_room": [{"room": "a", "image_ids": ["2"]}, {"room": "a", "image_ids": ["3", "4"]}]}, "images: list missing", None, "a=3/4"), ({"images": [], "image_groups_by_room": [{"room": " "}]}, "image_groups_by_room: room missing", "", ""), ("x", "not an object", None, ""),
)


@query("WITH a(k, errors, categories, rooms) AS (VALUES " + ", ".join(f"({i}, '{e}', {'NULL' if c is None else repr(c)}, '{r}')" for i, (_, e, c, r) in enumerate(_FIRST)) + ") SELECT p_partkey, errors, categories, rooms FROM part JOIN a ON p_partkey % 5 = k")
def first_answers(spark, sf):
    answers = F.array(*(F.lit(json.dumps(a)) for a, *_ in _FIRST))
    df = load(spark, sf, "part").select("p_partkey", F.element_at(answers, (F.col("p_partkey") % 5 + 1).cast("int")).alias("raw"))
    rows = analysis.validated_pass1(df)
    rooms = F.array_join(F.transform(F.map_entries("image_groups_by_room"), lambda x: F.concat(x["key"], F.lit("="), F.array_join(x["value"], "/"))), ",")
    return rows.select("p_partkey", F.array_join("errors", "; ").alias("errors"), F.array_join(F.transform("images", lambda x: F.coalesce(x["category"], F.lit(""))), ",").alias("categories"), rooms.alias("rooms"))


@query("SELECT event_id, event_id % 4 < 2 AS is_object FROM events")
def json_objects(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ('{"a": 1}', " {} ", "[1]", "{a"))), (F.col("event_id") % 4 + 1).cast("int"))
    return load(spark, sf, "events").select("event_id", raw.alias("raw")).select("event_id", analysis._object("raw").isNotNull().alias("is_object"))


_PAYLOAD = """concat('{"elements": [{"type": "node", "id": ', c_custkey, ', "lat": 1.5, "lon": 2.5, "tags": {"shop": "supermarket", "brand": "B', c_custkey % 3, '"}}, {"type": "way", "id": 7, "center": {"lat": 3.5, "lon": 4.5}, "tags": {"public_transport": "platform", "shop": "grocery", "name": "N"}}, {"type": "node", "id": ', c_custkey, ', "lat": 9.5, "lon": 2.5, "tags": {"shop": "convenience", "name": "', c_mktsegment, '"}}, {"type": "node", "id": 9, "lat": 1.0, "lon": 1.0, "tags": {"amenity": "cafe"}}, {"type": "node", "id": 8, "tags": {"shop": "grocery"}}]}')"""


@query("SELECT c_custkey, CASE k WHEN 0 THEN 0 ELSE 1 END AS first, CASE k WHEN 0 THEN 'node' ELSE 'way' END AS element_type, CASE k WHEN 0 THEN c_custkey ELSE 7 END AS element_id, CASE k WHEN 2 THEN 'transport_stop' ELSE 'grocery_shop' END AS category, CASE k WHEN 0 THEN 9.5::DOUBLE ELSE 3.5 END AS lat, CASE k WHEN 0 THEN 2.5::DOUBLE ELSE 4.5 END AS lon, CASE k WHEN 0 THEN c_mktsegment ELSE 'N' END AS name FROM customer, (VALUES (0), (1), (2)) AS t(k)")
def poi_payloads(spark, sf):
    df = load(spark, sf, "customer").selectExpr("c_custkey", f"{_PAYLOAD} AS payload")
    return places.poi_rows(df, key="c_custkey")


@query(ctes("located") + " SELECT listing_id, CASE WHEN lat IS NOT NULL THEN CASE precision WHEN 'exact_house' THEN 'high' WHEN 'street_approx' THEN 'medium' WHEN 'district_approx' THEN 'low' END END AS confidence FROM located")
def geocode_confidences(spark, sf):
    return bind(spark, sf, "located").select("listing_id", places.geocode_confidence("precision").alias("confidence"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN false ELSE o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0 AND o_orderkey % 7 <> 0 AND o_orderdate >= TIMESTAMP '1996-01-01' - INTERVAL 168 HOUR END AS fresh FROM orders")
def cache_freshness(spark, sf):
    rows = load(spark, sf, "orders").selectExpr(
        "o_orderkey", "56.9 AS lat", "24.1 AS lon", "CASE WHEN o_orderkey % 3 = 0 THEN 56.9001 ELSE 56.9 END AS c_lat", "24.1 AS c_lon", "CASE WHEN o_orderkey % 4 = 0 THEN 900.0 ELSE 1800.0 END AS radius_m",
        "CASE WHEN o_orderkey % 7 = 0 THEN 'other' ELSE 'default' END AS endpoint", "CASE WHEN o_orderkey % 5 = 0 THEN 'no time' ELSE date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") END AS fetched_at",
    )
    return places.fresh(rows, "1996-01-01 00:00:00").select("o_orderkey", "fresh")


# ---- lists -----------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'twice' WHEN 2 THEN 'unknown: 8, 9' ELSE 'twice' END AS problem FROM part")
def checked_ids(spark, sf):
    df = load(spark, sf, "part").selectExpr("p_partkey", "array('1', '2') AS e", "CASE p_partkey % 4 WHEN 1 THEN array('1', '1') WHEN 3 THEN array('1') ELSE array('2', '1') END AS c", "CASE p_partkey % 4 WHEN 2 THEN array('9', '1', '8') ELSE array('1') END AS f")
    rows = star.checked_ids(df, "e", "c", "f")
    return rows.select("p_partkey", F.when(F.contains("error", F.lit("exactly once")), "twice").when(F.col("error").isNotNull(), F.concat(F.lit("unknown"), F.regexp_replace("error", "^[^:]*", ""))).alias("problem"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey || '-a,2-b' END AS pairs, CASE WHEN p_partkey % 3 = 0 THEN 'lengths differ' END AS error FROM part")
def positional_join(spark, sf):
    df = load(spark, sf, "part").selectExpr("p_partkey", "array(p_partkey, 2L) AS ids", "CASE WHEN p_partkey % 3 = 0 THEN array('a') ELSE array('a', 'b') END AS urls")
    rows = star.positional_join(df, "ids", "urls")
    return rows.select("p_partkey", F.array_join(F.transform("pairs", lambda x: F.concat_ws("-", x["ids"].cast("string"), x["urls"])), ",").alias("pairs"), "error")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '3,2' WHEN 1 THEN CAST(p_partkey AS VARCHAR) END AS ids FROM part")
def id_lists(spark, sf):
    df = load(spark, sf, "part").selectExpr("p_partkey", "CASE p_partkey % 3 WHEN 0 THEN '[3, \"2\", 3, -1, \"x\", 0]' WHEN 1 THEN concat('[', p_partkey, ', null]') ELSE 'no list' END AS v")
    return df.select("p_partkey", F.array_join(analysis.positive_ids("v"), ",").alias("ids"))


@query("SELECT p_partkey AS listing_id, 'bath=2' || CASE WHEN p_partkey % 2 = 0 THEN ',hall=1/' || p_partkey ELSE ',hall=1' END AS rooms FROM part")
def images_by_room(spark, sf):
    image = lambda i, g: f"named_struct('image_id', {i}, 'likely_room_group', {g})"
    df = load(spark, sf, "part").selectExpr("p_partkey AS listing_id", f"array({image(chr(39) + '1' + chr(39), chr(39) + 'hall' + chr(39))}, {image(chr(39) + '2' + chr(39), chr(39) + 'bath' + chr(39))}, {image('CAST(p_partkey AS string)', 'CASE WHEN p_partkey % 2 = 0 THEN ' + chr(39) + 'hall' + chr(39) + ' END')}) AS images")
    rows = analysis.images_by_room(df)
    return rows.select("listing_id", F.array_join(F.transform(F.array_sort(F.map_entries("rooms")), lambda x: F.concat(x["key"], F.lit("="), F.array_join(x["value"], "/"))), ",").alias("rooms"))


# ---- filters, texts, scores ------------------------------------------------------------------------------------


@query(f"{M} SELECT listing_id FROM market WHERE status = 'active' AND NOT coalesce(is_rejected, false) AND private_rooms IN (1, 2, 3) AND area_m2 >= 30 AND price_eur <= 150000 AND district = 'Brand#11'")
def filter_from_payload(spark, sf):
    """A view's own settings: zero and empty are unset, ranges are put in order; through JSON and back."""
    spec = filters.from_payload({"price_min": 0, "price_max": "150000", "area_min": 30, "district": "Brand#11", "effective_private_rooms_min": 3, "effective_private_rooms_max": 1, "hide_rejected": 1})
    spec = filters.from_json(filters.to_json(spec))
    return filters.apply(bind(spark, sf, "market"), spec).select("listing_id")


@query(f"{M} SELECT listing_id FROM market WHERE status = 'active' AND NOT coalesce(is_rejected, false) AND private_rooms IN (0, 2) AND area_m2 >= 40")
def filter_private_rooms(spark, sf):
    return filters.apply(bind(spark, sf, "market"), FilterSpec(effective_private_rooms=frozenset((0, 2)), area_min=40.0)).select("listing_id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '—' WHEN p_partkey * 7 >= 1000 THEN printf('%.1f km', (p_partkey * 7 + 3.7::DOUBLE) / 1000) ELSE printf('%.0f m', p_partkey * 7 + 0.25) END AS distance, CASE WHEN p_partkey >= 1000 THEN printf('%.1fk', (p_partkey + 3.7::DOUBLE) / 1000) ELSE CAST(p_partkey AS VARCHAR) END AS short, round_even(p_partkey / 8.0, 2)::DOUBLE AS even, CAST(o AS VARCHAR) AS day FROM (SELECT *, DATE '2024-01-01' + CAST(p_size AS INT) AS o FROM part)")
def number_texts(spark, sf):
    rows = load(spark, sf, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 9 <> 0 THEN CASE WHEN p_partkey * 7 >= 1000 THEN p_partkey * 7 + 3.7D ELSE p_partkey * 7 + 0.25D END END AS d", "CASE WHEN p_partkey >= 1000 THEN p_partkey + 3.7D ELSE CAST(p_partkey AS double) END AS n", "p_partkey / 8.0D AS e", "concat(date_add(DATE'2024-01-01', p_size), 'T10:00:00+00:00') AS t")
    return rows.select("p_partkey", text.distance("d").alias("distance"), text.compact_number("n").alias("short"), text.exact_round("e", 2).alias("even"), text.date_part("t").alias("day"))


_TABLE = {"en": {"price": "Price", "area": "Area"}, "ru": {"price": "Цена"}}


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'Цена' ELSE 'Price' END WHEN 1 THEN CASE WHEN c_custkey % 3 = 0 THEN 'Цена' ELSE 'Price' END WHEN 2 THEN 'Area' ELSE 'other' END AS said FROM customer")
def translations(spark, sf):
    rows = load(spark, sf, "customer").selectExpr("c_custkey", "CASE c_custkey % 4 WHEN 0 THEN 'price' WHEN 1 THEN 'Price' WHEN 2 THEN 'area' ELSE 'other' END AS t", "CASE WHEN c_custkey % 3 = 0 THEN 'ru' ELSE 'xx' END AS lang")
    return rows.select("c_custkey", text.translated("t", F.col("lang"), _TABLE, {"Price": "price", "Area": "area"}).alias("said"))


_KEYS = "[CASE WHEN is_favorite THEN 'Favorite/neutral' END, CASE WHEN has_notes THEN 'Note/neutral' END, CASE WHEN room_conflict THEN 'Room conflict/risk' END, CASE WHEN layout_label = 'Confirmed' THEN 'Layout confirmed/good' END, CASE WHEN has_floor_plan THEN 'Floor plan/ai' END, CASE WHEN kitchen_living THEN 'Kitchen-living/ai' END, CASE WHEN price_value_score >= 80 THEN 'Good price/good' END, CASE WHEN suspicious THEN 'Suspiciously low price - check carefully/risk' END, CASE WHEN risk IN ('High', 'Critical') THEN 'High mortgage risk/risk' END, CASE WHEN stove THEN 'Stove heating/risk' END, CASE WHEN wooden THEN 'Wooden building/neutral' END]"


@query(f"{SCORED} SELECT listing_id, array_to_string(list_filter({_KEYS}, lambda x: x IS NOT NULL), ',') AS chips FROM blocks")
def flag_chips(spark, sf):
    rows = scoring.with_blocks(bind(spark, sf, "market"))
    return rows.select("listing_id", F.array_join(F.transform(views.chips(views.key_flags()), lambda x: F.concat_ws("/", x["label"], x["type"])), ",").alias("chips"))


@query(f"{SCORED} SELECT listing_id, 'best_transport' AS profile_key, {_overall('best_transport')} AS score FROM blocks WHERE listing_id % 10 = 1")
def rescored(spark, sf):
    """Some listings scored anew against the whole market."""
    rows = bind(spark, sf, "market")
    return mutations.rescored(rows, rows.where("listing_id % 10 = 1"), "best_transport")


_MARK = ctes("market")


@query(f"{_MARK} SELECT listing_id, 'Baseline uses ' || baseline_n || ' active comparable listings at ' || baseline_level || ' level.' AS sentence FROM (" + SCORED.removeprefix("WITH").strip().join(("WITH ", " SELECT listing_id, baseline_n, baseline_level FROM blocks WHERE baseline_level IS NOT NULL")) + ")")
def baseline_sentences(spark, sf):
    from ..operators import market

    rows = market.baselines(bind(spark, sf, "market").where("status = 'active'")).where("baseline_level IS NOT NULL")
    return rows.select("listing_id", market.explanation().alias("sentence"))


@query("SELECT conv_id, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS said FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def text_lines(spark, sf):
    """A conversation's texts as lines, those that lack left out."""
    rows = load(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    said = F.filter(F.transform("x", lambda t: t["text"]), lambda t: t.isNotNull())
    return rows.where(F.size(said) > 0).select("conv_id", F.sha2(F.array_join(said, "\n"), 256).alias("said"))


