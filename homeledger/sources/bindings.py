"""The test tables as domain relations.

Each binding is one SELECT of plain arithmetic that Spark SQL and DuckDB read alike, so queries and their
SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Listings with every property that filters, baselines and scores read; some values missing by a rule.
MARKET = """
SELECT p_partkey AS listing_id,
  CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS price_eur,
  CAST(p_size + 20 AS DOUBLE) AS area_m2,
  p_brand AS district,
  CASE WHEN p_partkey % 21 <> 0 THEN p_name END AS street,
  CASE WHEN p_partkey % 4 <> 1 THEN CAST(p_partkey % 100 AS VARCHAR(10)) END AS house,
  CAST(1 + p_partkey % 4 AS INT) AS declared_rooms,
  CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_partkey % 4 AS INT) END AS private_rooms,
  CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS series,
  CASE p_partkey % 5 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' WHEN 3 THEN 'Critical' END AS risk,
  CASE WHEN p_partkey % 10 <> 0 THEN 'active' ELSE 'inactive' END AS status,
  CASE WHEN p_partkey % 19 <> 0 THEN p_partkey % 13 = 0 END AS is_favorite,
  CASE WHEN p_partkey % 23 <> 0 THEN p_partkey % 17 = 0 END AS is_rejected,
  CASE WHEN p_partkey % 29 <> 0 THEN p_partkey % 3 = 0 END AS is_viewed,
  CASE WHEN p_partkey % 31 <> 0 THEN p_partkey % 9 = 0 END AS room_conflict,
  p_partkey % 8 = 0 AS kitchen_living,
  CASE p_partkey % 6 WHEN 0 THEN 'Confirmed' WHEN 1 THEN 'Likely' WHEN 2 THEN 'Unclear' WHEN 3 THEN 'Conflict' END AS layout_label,
  CASE WHEN p_partkey % 37 <> 0 THEN p_partkey % 25 = 0 END AS stove,
  CASE WHEN p_partkey % 41 <> 0 THEN p_partkey % 27 = 0 END AS wooden,
  CASE WHEN p_partkey % 43 <> 0 THEN p_partkey % 5 = 1 END AS has_floor_plan,
  p_partkey % 16 = 3 AS has_notes,
  CASE WHEN p_partkey % 12 <> 0 THEN CAST((p_partkey * 37) % 101 AS DOUBLE) END AS transport_score,
  CASE WHEN p_partkey % 14 <> 0 THEN CAST((p_partkey * 53) % 101 AS DOUBLE) END AS rtu_score,
  CASE WHEN p_partkey % 15 <> 0 THEN CAST((p_partkey * 61) % 101 AS DOUBLE) END AS station_score,
  CASE WHEN p_partkey % 18 <> 0 THEN CAST((p_partkey * 71) % 101 AS DOUBLE) END AS shop_score
FROM part
"""

#: Listings with coordinates and address parts, and points of interest.
PLACES = """
SELECT s_suppkey AS listing_id, 56.90 + CAST(s_suppkey * 37 % 100 AS DOUBLE) / 1000 AS lat, 24.00 + CAST(s_suppkey * 53 % 200 AS DOUBLE) / 1000 AS lon,
  CASE WHEN s_suppkey % 9 <> 0 THEN 'District ' || CAST(s_nationkey AS VARCHAR(10)) END AS district,
  CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS street,
  CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_suppkey % 50 AS VARCHAR(10)) WHEN s_suppkey % 2 = 0 THEN '' END AS house,
  CASE WHEN s_suppkey % 5 <> 0 THEN 'high' WHEN s_suppkey % 2 = 0 THEN 'low' END AS confidence,
  CASE WHEN s_suppkey % 8 = 0 THEN 'inactive' ELSE 'active' END AS status,
  s_suppkey % 6 = 0 AS is_rejected, s_suppkey % 7 = 0 AS is_favorite,
  CASE WHEN s_suppkey % 10 <> 0 THEN CAST(s_suppkey * 29 % 101 AS DOUBLE) END AS score,
  s_suppkey % 11 <> 0 AS fetched
FROM supplier
"""
POIS = """
SELECT c_custkey AS poi_id, 56.90 + CAST(c_custkey * 71 % 1000 AS DOUBLE) / 10000 AS poi_lat, 24.00 + CAST(c_custkey * 29 % 2000 AS DOUBLE) / 10000 AS poi_lon,
  CASE WHEN c_custkey % 2 = 0 THEN 'grocery_shop' ELSE 'transport_stop' END AS category, c_name AS poi_name
FROM customer
"""

#: Dimensions of the star: user state, finished analyses by version.
STATES = "SELECT doc_id AS listing_id, quality = 1 AS is_favorite, toxic = 1 AS is_rejected, quality IS NOT NULL AS is_viewed FROM labels"
ANALYSES = "SELECT conv_id AS listing_id, turn AS version, CASE WHEN role = 'assistant' THEN 'finished' ELSE 'pending' END AS state, text AS explanation FROM conversations"
LISTINGS = "SELECT doc_id AS listing_id, source AS district, lang AS street, n_chars AS price_eur, CAST(n_chars % 97 AS DOUBLE) AS area_m2, doc_id % 3 = 0 AS needs_ai FROM documents"

#: Snapshots: one row a listing and time.
SNAPSHOTS = """
SELECT user_id AS listing_id, event_id, ts AS checked_at, CASE WHEN event_id % 13 <> 0 THEN CAST(floor(value * 100 + 0.5) AS BIGINT) END AS price_eur,
  CASE WHEN event_id % 3 <> 0 THEN event_id % 40 END AS visits, CASE WHEN event_id % 4 <> 0 THEN props END AS description,
  CASE WHEN event_id % 4 <> 0 THEN event_id % 6 END AS images, event_id % 4 <> 0 AS has_detail, event_type
FROM events
"""

#: User states, images, analyses, positions, location scores, price values and profile scores of the same listings; `stored` tells which rows exist.
USERS = """
SELECT p_partkey AS listing_id, p_partkey % 13 = 0 AS is_favorite, p_partkey % 17 = 0 AS is_rejected, p_partkey % 3 = 0 AS is_viewed,
  CASE WHEN p_partkey % 17 = 0 THEN 'rejected' WHEN p_partkey % 13 = 0 THEN 'favorite' WHEN p_partkey % 3 = 0 THEN 'viewed' ELSE 'unseen' END AS user_status,
  CASE p_partkey % 16 WHEN 3 THEN concat('call ', p_name) WHEN 5 THEN '  ' WHEN 7 THEN '' END AS notes, p_partkey % 5 <> 4 AS stored
FROM part
"""
IMAGES = """
SELECT l_partkey AS listing_id, l_orderkey * 10 + l_linenumber AS image_id, l_returnflag = 'R' AND l_linenumber = 1 AS is_floor_plan,
  CASE l_linenumber WHEN 1 THEN concat('/plans/', CAST(l_orderkey AS VARCHAR(20)), '.png') WHEN 2 THEN '' END AS path
FROM lineitem
"""
AI = """
SELECT l_partkey AS listing_id, l_orderkey * 10 + l_linenumber AS version, CASE WHEN l_linestatus = 'O' THEN 'finished' ELSE 'failed' END AS state,
  CASE WHEN l_linenumber <> 6 THEN CAST(CAST(l_quantity AS INT) % 5 AS INT) END AS private_rooms, CAST(CAST(l_quantity AS INT) % 3 AS INT) AS walkthrough_rooms,
  l_linenumber % 3 = 0 AS kitchen_living, l_linenumber % 4 = 1 AS room_conflict, CASE l_linenumber WHEN 1 THEN 'Confirmed' WHEN 2 THEN 'Likely' WHEN 3 THEN 'Unclear' WHEN 4 THEN 'Conflict' END AS layout_label,
  CASE l_linenumber WHEN 1 THEN 'Low' WHEN 3 THEN 'Medium' WHEN 4 THEN 'High' WHEN 5 THEN 'Critical' END AS risk, l_orderkey % 11 = 0 AS stove, l_orderkey % 13 = 0 AS wooden,
  CASE l_linenumber % 4 WHEN 0 THEN '[]' WHEN 1 THEN '' WHEN 2 THEN '["7"]' END AS floor_plan_ids, CASE WHEN l_orderkey % 4 <> 0 THEN concat('layout of ', CAST(l_orderkey AS VARCHAR(20))) ELSE ' ' END AS layout_text,
  CASE WHEN l_orderkey % 5 <> 0 THEN '["thick walls"]' END AS risk_reasons, CASE WHEN l_orderkey % 7 <> 0 THEN concat('evidence ', CAST(l_orderkey AS VARCHAR(20))) END AS risk_text
FROM lineitem
"""
LOCATED = """
SELECT p_partkey AS listing_id, CASE WHEN p_partkey % 6 <> 0 THEN 56.9 + CAST(p_partkey % 100 AS DOUBLE) / 1000 END AS lat, CASE WHEN p_partkey % 6 <> 0 THEN 24.1 + CAST(p_partkey % 64 AS DOUBLE) / 1000 END AS lon,
  CASE p_partkey % 4 WHEN 0 THEN 'exact_house' WHEN 1 THEN 'street_approx' WHEN 2 THEN 'district_approx' END AS precision, CASE p_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS confidence,
  p_partkey % 4 = 0 AS geo_enabled, CASE WHEN p_partkey % 4 <> 0 THEN 'Approximate address - location scores not calculated' END AS geo_reason, p_partkey % 9 <> 2 AS stored
FROM part
"""
LOCATION = """
SELECT p_partkey AS listing_id, CAST(p_partkey * 371 % 40000 AS DOUBLE) / 9.7 AS rtu_distance, CAST(p_partkey * 53 % 101 AS DOUBLE) AS rtu_score, CAST(p_partkey * 173 % 30000 AS DOUBLE) / 9.7 AS station_distance,
  CASE WHEN p_partkey % 15 <> 0 THEN CAST(p_partkey * 61 % 101 AS DOUBLE) END AS station_score, CASE WHEN p_partkey % 8 <> 1 THEN CAST(p_partkey % 900 AS DOUBLE) END AS nearest_shop, CAST(p_partkey % 12 AS INT) AS shops_1200,
  CAST(p_partkey * 71 % 101 AS DOUBLE) AS shop_score, CAST(p_partkey % 700 AS DOUBLE) AS nearest_stop, CAST(p_partkey % 7 AS INT) AS stops_900, CAST(p_partkey * 37 % 101 AS DOUBLE) AS transport_score,
  p_partkey % 8 <> 1 AS has_cache, p_partkey % 7 <> 3 AS stored
FROM part
"""
VALUATION = """
SELECT p_partkey AS listing_id, CAST(p_partkey * 29 % 101 AS DOUBLE) AS price_value_score, CAST(p_partkey * 31 % 101 AS DOUBLE) AS ppm2_score, CAST(p_partkey * 41 % 101 AS DOUBLE) AS room_score,
  CASE WHEN p_partkey % 6 <> 5 THEN CAST(p_partkey * 43 % 101 AS DOUBLE) END AS absolute_score, p_partkey % 19 = 0 AS suspicious, CASE WHEN p_partkey % 10 <> 9 THEN 'district' END AS baseline_level,
  CAST(p_partkey % 40 AS INT) AS baseline_n, CAST(p_partkey % 5000 AS DOUBLE) / 4 AS baseline_median, CASE WHEN p_partkey % 10 <> 9 THEN 'Baseline of the district.' END AS baseline_text, p_partkey % 11 <> 6 AS stored
FROM part
"""
PROFILED = """
SELECT p_partkey AS listing_id, CASE WHEN p_partkey % 2 = 0 THEN 'best_price' ELSE 'best_transport' END AS profile_key, CAST(p_partkey * 59 % 1000 AS DOUBLE) / 9.7 AS score,
  CASE WHEN p_partkey % 4 <> 0 THEN concat('Weighted of ', CAST(p_partkey % 9 AS VARCHAR(4))) END AS score_text,
  CASE p_partkey % 5 WHEN 0 THEN '[1]' WHEN 1 THEN 'no json' WHEN 2 THEN concat('{"price_value": {"score": ', CAST(p_partkey % 101 AS VARCHAR(4)), ', "explanation": "cheap"}, "attic_view": {"score": "x"}, "floor": 3}') WHEN 3 THEN concat('{"floor": {"score": ', CAST(p_partkey % 77 AS VARCHAR(4)), '}, "useful_area": {"score": 50}}') END AS breakdown, p_partkey % 23 <> 8 AS stored
FROM part
"""

BINDINGS = {"market": MARKET, "places": PLACES, "pois": POIS, "states": STATES, "analyses": ANALYSES, "listings": LISTINGS, "snapshots": SNAPSHOTS} | {
    "users": USERS, "images": IMAGES, "ai": AI, "located": LOCATED, "location": LOCATION, "valuation": VALUATION, "profiled": PROFILED,
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain relation; its SELECT runs over the table itself, so filters and columns reach the scan."""
    sql = BINDINGS[name].strip()
    select, _, source = sql.rpartition("FROM ")
    expressions = split_columns(select.strip().removeprefix("SELECT"))
    return load(spark, sf_dir, source.strip()).selectExpr(*expressions)


def split_columns(text: str) -> list[str]:
    """The expressions of a select list, cut at commas outside parentheses."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[at:i].strip())
            at = i + 1
    return [*out, text[at:].strip()]


def ctes(*names: str) -> str:
    """The bindings as common table expressions."""
    return "WITH " + ", ".join(f"{n} AS ({BINDINGS[n].strip()})" for n in names)
