"""Queries over the test tables, each with the SQL that it must agree with.

A query is registered by @query(sql): the function takes (spark, sf_dir); sql is DuckDB's form, None where
SQL cannot say it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, scores, text
from ..functions.nulls import enum, filled
from ..operators import analysis, changes, filters, market, pages, places, ranking, scoring, star, views
from ..operators.filters import FilterSpec
from ..sources.bindings import bind, ctes, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _load_all() -> None:
    """The modules that register their queries here."""
    from . import read_queries, text_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-price ranking: baselines, price value, weighted score, order, first 20."""
    rows = scoring.score(bind(spark, sf_dir, "market"), "best_price")
    return ranking.top(rows, 20).select("position", "listing_id", "price_eur", "area_m2", "baseline_level", "baseline_n", "baseline_median", "price_value_score", "score")


# ---- SQL shared by several oracles -------------------------------------------------------------------------

M = ctes("market")
#: Prices, comparability and leave-one-out samples in the plain, quadratic form.
PRICED = f"""{M},
priced AS (SELECT *, CASE WHEN area_m2 > 0 THEN price_eur / area_m2 END AS ppm2, CASE WHEN private_rooms > 0 THEN price_eur / CAST(private_rooms AS DOUBLE) END AS ppr FROM market WHERE status = 'active'),
comp AS (SELECT * FROM priced WHERE coalesce(risk <> 'Critical', true) AND ppm2 >= 100 AND ppm2 <= 10000)"""
STEPS = "CASE WHEN {p} IS NULL OR {m} IS NULL THEN NULL WHEN {m} <= 0 THEN 50.0 WHEN {p} / {m} <= 0.75 THEN 95.0 WHEN {p} / {m} <= 0.9 THEN 80.0 WHEN {p} / {m} <= 1.0 THEN 65.0 WHEN {p} / {m} <= 1.15 THEN 50.0 WHEN {p} / {m} <= 1.35 THEN 30.0 ELSE 10.0 END"
CITY = """,
city AS (SELECT t.listing_id, count(c.ppm2) AS city_n, median(c.ppm2) AS city_median, count(c.ppr) AS room_n, median(c.ppr) AS room_median,
  count(CASE WHEN c.price_eur > 0 THEN 1 END) AS price_n, median(CASE WHEN c.price_eur > 0 THEN CAST(c.price_eur AS DOUBLE) END) AS price_median
  FROM priced t JOIN comp c ON c.listing_id <> t.listing_id GROUP BY t.listing_id)"""
LEVELS = """,
near AS (SELECT t.listing_id, c.ppm2, coalesce(t.series <> '' AND c.series = t.series, false) AS same_series, coalesce(c.private_rooms = t.private_rooms, false) AS same_private
  FROM priced t JOIN comp c ON c.district = t.district AND c.listing_id <> t.listing_id
  WHERE t.district <> '' AND (coalesce(t.area_m2, 0) = 0 OR c.area_m2 / t.area_m2 BETWEEN 0.8 AND 1.2)
    AND (coalesce(t.declared_rooms, 0) = 0 OR coalesce(c.declared_rooms, 0) = 0 OR abs(c.declared_rooms - t.declared_rooms) <= 1)),
levels AS (SELECT listing_id, count(*) FILTER (WHERE same_series) AS series_n, median(ppm2) FILTER (WHERE same_series) AS series_median,
  count(*) FILTER (WHERE same_private) AS ai_n, median(ppm2) FILTER (WHERE same_private) AS ai_median, count(*) AS district_n, median(ppm2) AS district_median FROM near GROUP BY listing_id),
based AS (SELECT p.*, room_n, room_median, price_n, price_median,
  CASE WHEN series_n >= 5 THEN 'series_building' WHEN ai_n >= 5 THEN 'ai_adjusted' WHEN district_n >= 5 THEN 'district' WHEN city_n >= 1 THEN 'riga' END AS baseline_level,
  CASE WHEN series_n >= 5 THEN series_n WHEN ai_n >= 5 THEN ai_n WHEN district_n >= 5 THEN district_n WHEN city_n >= 1 THEN city_n END AS baseline_n,
  round(CASE WHEN series_n >= 5 THEN series_median WHEN ai_n >= 5 THEN ai_median WHEN district_n >= 5 THEN district_median WHEN city_n >= 1 THEN city_median END, 2) AS baseline_median
  FROM priced p LEFT JOIN city USING (listing_id) LEFT JOIN levels USING (listing_id))"""
VALUE = f""",
parts AS (SELECT *, {STEPS.format(p="ppm2", m="baseline_median")} AS ppm2_score,
  CASE WHEN baseline_median IS NOT NULL AND ppm2 IS NOT NULL AND room_n >= 3 THEN {STEPS.format(p="ppr", m="room_median")} END AS room_score,
  CASE WHEN baseline_median IS NOT NULL AND ppm2 IS NOT NULL AND price_n >= 3 THEN {STEPS.format(p="price_eur", m="price_median")} END AS absolute_score FROM based),
valued AS (SELECT *, round((ppm2_score * 8 + coalesce(room_score * 2, 0) + coalesce(absolute_score, 0)) / (8 + CASE WHEN room_score IS NULL THEN 0 ELSE 2 END + CASE WHEN absolute_score IS NULL THEN 0 ELSE 1 END), 2) AS price_value_score,
  coalesce(baseline_n >= 5 AND ppm2 < baseline_median * 0.65, false) AS suspicious FROM parts)"""
BLOCKS = """,
mid AS (SELECT median(area_m2) AS m FROM priced WHERE area_m2 > 0),
blocks AS (SELECT *, price_value_score AS b_price_value,
  CASE WHEN private_rooms IS NULL THEN 45.0 WHEN private_rooms <= 0 THEN 0.0 WHEN private_rooms = 2 THEN 100.0 WHEN private_rooms < 2 THEN 45.0 ELSE 85.0 END AS b_room_privacy,
  CASE layout_label WHEN 'Confirmed' THEN 100.0 WHEN 'Likely' THEN 80.0 WHEN 'Unclear' THEN 45.0 WHEN 'Conflict' THEN 35.0 END AS b_layout_confidence,
  CASE coalesce(risk, 'Unknown') WHEN 'Low' THEN 100.0 WHEN 'Medium' THEN 70.0 WHEN 'High' THEN 35.0 WHEN 'Critical' THEN 5.0 ELSE 50.0 END AS b_mortgage_suitability,
  rtu_score AS b_rtu_accessibility, transport_score AS b_transport_connectivity, station_score AS b_central_station_accessibility, shop_score AS b_shops_infrastructure,
  CASE WHEN area_m2 IS NULL OR area_m2 <= 0 OR m IS NULL OR m <= 0 THEN NULL WHEN area_m2 / m >= 1.3 THEN 95.0 WHEN area_m2 / m >= 1.05 THEN 80.0 WHEN area_m2 / m >= 0.8 THEN 65.0 WHEN area_m2 / m >= 0.6 THEN 45.0 ELSE 25.0 END AS b_useful_area,
  CASE WHEN series <> '' THEN 55.0 END AS b_building_series FROM valued, mid)"""


def _overall(profile: str) -> str:
    used = {b: w for b, w in zip(scoring.BLOCKS, scoring.PROFILES[profile], strict=True) if w > 0}
    total = " + ".join(f"coalesce(least(100.0, greatest(0.0, CAST(b_{b} AS DOUBLE))) * {w}, 0)" for b, w in used.items())
    weight = " + ".join(f"CASE WHEN b_{b} IS NULL THEN 0 ELSE {w} END" for b, w in used.items())
    return f"floor(({total}) / nullif({weight}, 0) * 100 + 0.500001) / 100"


SCORED = PRICED + CITY + LEVELS + VALUE + BLOCKS

# ---- market and scores -------------------------------------------------------------------------------------


@query(f"{PRICED} SELECT listing_id, district, round(ppm2, 4) AS ppm2, round(ppr, 4) AS ppr FROM comp")
def market_candidates(spark, sf):
    rows = market.candidates(bind(spark, sf, "market"))
    return rows.select("listing_id", "district", F.round("ppm2", 4).alias("ppm2"), F.round("ppr", 4).alias("ppr"))


@query(f"{PRICED}{CITY} SELECT listing_id, city_n, round(city_median, 6) AS city_median, room_n, round(room_median, 6) AS room_median, price_n, round(price_median, 6) AS price_median FROM city")
def baseline_city_loo(spark, sf):
    rows = market.city_medians(bind(spark, sf, "market").where("status = 'active'"))
    return rows.select("listing_id", *(x for k in ("city", "room", "price") for x in (F.col(f"{k}_n").cast("long").alias(f"{k}_n"), F.round(f"{k}_median", 6).alias(f"{k}_median"))))


@query(f"{PRICED}{CITY}{LEVELS} SELECT listing_id, baseline_level, baseline_n, baseline_median FROM based")
def baseline_levels(spark, sf):
    return market.baselines(bind(spark, sf, "market").where("status = 'active'")).select("listing_id", "baseline_level", "baseline_n", "baseline_median")


@query(f"{PRICED}{CITY}{LEVELS}{VALUE} SELECT listing_id, baseline_level, CAST(ppm2_score AS DOUBLE) AS ppm2_score, CAST(room_score AS DOUBLE) AS room_score, CAST(absolute_score AS DOUBLE) AS absolute_score, CAST(price_value_score AS DOUBLE) AS price_value_score, suspicious FROM valued")
def price_value(spark, sf):
    rows = market.price_value(bind(spark, sf, "market").where("status = 'active'"))
    return rows.select("listing_id", "baseline_level", "ppm2_score", "room_score", "absolute_score", "price_value_score", "suspicious")


@query(f"{PRICED}{CITY}{LEVELS}{VALUE} SELECT suspicious, baseline_level, count(*) AS n FROM valued GROUP BY ALL")
def suspicious_low_price(spark, sf):
    rows = market.price_value(bind(spark, sf, "market").where("status = 'active'"))
    return rows.groupBy("suspicious", "baseline_level").agg(F.count("*").alias("n"))


@query(f"{M} SELECT listing_id, CASE WHEN area_m2 / m >= 1.3 THEN 95.0::DOUBLE WHEN area_m2 / m >= 1.05 THEN 80.0 WHEN area_m2 / m >= 0.8 THEN 65.0 WHEN area_m2 / m >= 0.6 THEN 45.0 ELSE 25.0 END AS score FROM market, (SELECT median(area_m2) AS m FROM market WHERE status = 'active' AND area_m2 > 0)")
def useful_area_score(spark, sf):
    rows = bind(spark, sf, "market")
    return rows.select("listing_id", scores.useful_area("area_m2", F.lit(scoring.median_area(rows)).cast("double")).cast("double").alias("score"))


_LONG = " UNION ALL ".join(f"SELECT listing_id, '{b}' AS block_key, CAST(b_{b} AS DOUBLE) AS score FROM blocks" for b in ("price_value", "room_privacy", "layout_confidence", "mortgage_suitability", "rtu_accessibility", "transport_connectivity", "central_station_accessibility", "shops_infrastructure", "useful_area", "building_series"))


@query(f"{SCORED} SELECT * FROM ({_LONG})")
def block_scores_long(spark, sf):
    return scoring.blocks_long(scoring.with_blocks(bind(spark, sf, "market")))


@query(f"{SCORED} " + " UNION ALL ".join(f"SELECT listing_id, '{p}' AS profile_key, {_overall(p)} AS score FROM blocks" for p in scoring.PROFILES))
def profile_scores_all(spark, sf):
    return scoring.scores_by_profile(bind(spark, sf, "market"))


@query(f"{SCORED}, long AS ({_LONG}), w(block_key, weight) AS (VALUES ('price_value', 5), ('useful_area', 1), ('room_privacy', 1)) SELECT listing_id, floor(sum(score * weight) / sum(weight) * 100 + 0.500001) / 100 AS score, sum(weight)::BIGINT AS weight, 'Weighted score calculated from ' || sum(weight)::BIGINT || ' total profile weight.' AS explanation FROM long JOIN w USING (block_key) WHERE score IS NOT NULL GROUP BY listing_id")
def profile_scores_by_table(spark, sf):
    weights = scoring.profile_weights(spark).where("profile_key = 'best_price'")
    return scoring.scores_by_weights(scoring.blocks_long(scoring.with_blocks(bind(spark, sf, "market"))), weights).drop("profile_key")


@query("WITH given(name, block, level) AS (VALUES ('My Best Picks!', 'price_value', 'Critical'), ('My Best Picks!', 'floor', 'Huge'), ('  ', 'shops_infrastructure', 'Weak')), keys(profile_key, name) AS (VALUES ('custom_my_best_picks', 'My Best Picks!'), ('custom_profile', '  ')), b(block_key) AS (VALUES " + ", ".join(f"('{b}')" for b in scoring.BLOCKS) + ") SELECT k.profile_key, b.block_key, CASE WHEN level IN ('Ignore', 'Weak', 'Medium', 'Strong', 'Critical') THEN level ELSE 'Ignore' END AS importance, CASE level WHEN 'Weak' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Strong' THEN 3 WHEN 'Critical' THEN 5 ELSE 0 END AS weight FROM keys k CROSS JOIN b LEFT JOIN given g ON g.name = k.name AND g.block = b.block_key")
def custom_profile(spark, sf):
    raw = spark.createDataFrame([("My Best Picks!", {"price_value": "Critical", "floor": "Huge", "attic": "Weak"}), ("  ", {"shops_infrastructure": "Weak"})], "name string, importance map<string,string>")
    return scoring.custom_weights(raw)


# ---- filters, ranking, summaries ---------------------------------------------------------------------------

_ORDER = "score IS NULL, coalesce(score, 0) DESC, coalesce(price_eur, 1000000000000), listing_id"
_BASE = "status = 'active' AND NOT coalesce(is_rejected, false)"


@query(f"{SCORED}, s AS (SELECT *, {_overall('for_living_mortgage')} AS score FROM blocks WHERE {_BASE}) SELECT CAST(row_number() OVER (ORDER BY {_ORDER}) AS INT) AS position, listing_id, score, price_eur FROM s ORDER BY position LIMIT 20")
def ranking_default(spark, sf):
    rows = scoring.score(bind(spark, sf, "market"))
    return ranking.ranked(rows, FilterSpec(), 20).select("position", "listing_id", "score", "price_eur")


SPEC = FilterSpec(price_min=95_000, area_max=60.0, districts=frozenset(("Brand#11", "Brand#12", "Brand#21", "Brand#23", "Brand#34")), declared_rooms=frozenset((2, 3, 4)), only_without_room_conflict=True, hide_high_mortgage_risk=True, hide_stove_heating=True)


@query(f"{SCORED}, s AS (SELECT *, {_overall('best_transport')} AS score FROM blocks WHERE {_BASE} AND price_eur >= 95000 AND area_m2 <= 60 AND district IN ('Brand#11', 'Brand#12', 'Brand#21', 'Brand#23', 'Brand#34') AND declared_rooms IN (2, 3, 4) AND NOT coalesce(room_conflict, false) AND coalesce(risk, '') NOT IN ('High', 'Critical') AND NOT coalesce(stove, false)) SELECT CAST(row_number() OVER (ORDER BY {_ORDER}) AS INT) AS position, listing_id, score FROM s")
def ranking_filtered(spark, sf):
    rows = scoring.score(bind(spark, sf, "market"), "best_transport")
    return ranking.positions(filters.apply(rows, SPEC)).select("position", "listing_id", "score")


_NULL_ORDERS = {"transport": "transport_score DESC NULLS LAST", "cheap": "price_eur ASC NULLS LAST", "dear": "price_eur DESC NULLS LAST", "area": "area_m2 DESC NULLS LAST"}


@query(f"{M} " + " UNION ALL ".join(f"SELECT '{k}' AS view, listing_id, CAST(row_number() OVER (ORDER BY {o}, listing_id) AS INT) AS position FROM market" for k, o in _NULL_ORDERS.items()))
def ranking_null_last_sorts(spark, sf):
    """Every row of each re-sort, those with nulls too."""
    rows, out = bind(spark, sf, "market").withColumn("score", F.col("transport_score")), None
    for k, name in (("transport", "score"), ("cheap", "price_asc"), ("dear", "price_desc"), ("area", "area")):
        part = ranking.positions(rows, [*ranking.VIEW_ORDERS[name](), F.col("listing_id").asc()]).select(F.lit(k).alias("view"), "listing_id", "position")
        out = part if out is None else out.unionByName(part)
    return out


_FLAGS = {
    "hide_rejected": "NOT coalesce(is_rejected, false)", "rejected_only": "coalesce(is_rejected, false)", "favorites_only": "coalesce(is_favorite, false)", "hide_viewed": "NOT coalesce(is_viewed, false)",
    "only_without_room_conflict": "NOT coalesce(room_conflict, false)", "only_confirmed_layout": "coalesce(layout_label = 'Confirmed', false)", "hide_high_mortgage_risk": "coalesce(risk, '') NOT IN ('High', 'Critical')",
    "hide_stove_heating": "NOT coalesce(stove, false)", "hide_wooden_buildings": "NOT coalesce(wooden, false)", "only_with_floor_plan": "coalesce(has_floor_plan, false)", "only_good_transport": "coalesce(transport_score, 0) >= 70",
    "only_near_rtu": "coalesce(rtu_score, 0) >= 70", "only_near_central_station": "coalesce(station_score, 0) >= 70", "inactive_only": "status <> 'active'", "active_only": "status = 'active'",
}


@query(f"{M} " + " UNION ALL ".join(f"SELECT '{k}' AS filter, count(*) AS n, CAST(sum(listing_id) AS BIGINT) AS ids FROM market WHERE {p}" for k, p in _FLAGS.items()))
def filter_null_matrix(spark, sf):
    rows, off = bind(spark, sf, "market"), {"active_only": False, "hide_rejected": False}
    kept = [F.struct(F.lit(k).alias("filter"), filters.matches(FilterSpec(**(off | {k: True}))).alias("ok")) for k in _FLAGS]
    long = rows.select("listing_id", F.explode(F.array(*kept)).alias("x")).where("x.ok")
    return long.groupBy("x.filter").agg(F.count("*").alias("n"), F.sum("listing_id").alias("ids"))


_TABS = {"all": _BASE, "new": f"{_BASE} AND NOT coalesce(is_viewed, false)", "favorites": "coalesce(is_favorite, false)", "rejected": "coalesce(is_rejected, false)", "inactive": "status <> 'active'"}


@query(f"{M} " + " UNION ALL ".join(f"SELECT '{k}' AS tab, listing_id FROM market WHERE price_eur <= 150000 AND {p}" for k, p in _TABS.items()))
def workflow_tabs(spark, sf):
    rows, base = bind(spark, sf, "market"), FilterSpec(price_max=150_000)
    kept = [F.when(filters.matches(filters.for_tab(t, base)), F.lit(t)) for t in _TABS]
    return rows.select(F.explode(F.array_compact(F.array(*kept))).alias("tab"), "listing_id")


@query(f"{M} SELECT listing_id FROM market WHERE lower(coalesce(street, '')) LIKE '%al%' OR lower(coalesce(district, '')) LIKE '%al%' OR CAST(listing_id AS VARCHAR) = 'al'")
def text_search(spark, sf):
    return filters.search(bind(spark, sf, "market"), " AL ").select("listing_id")


@query(f"{SCORED}, s AS (SELECT *, {_overall('for_living_mortgage')} AS score FROM blocks WHERE {_BASE}) SELECT count(*) AS shown, (SELECT CAST(count(*) AS INT) FROM market) AS total, CAST(round(max(score)) AS INT) AS top_score, round(avg(price_eur), 2) AS avg_price, round(avg(area_m2), 1) AS avg_area, count(*) FILTER (WHERE risk IN ('High', 'Critical')) AS high_risk FROM s")
def view_summary(spark, sf):
    rows = bind(spark, sf, "market")
    shown = filters.apply(scoring.score(rows), FilterSpec())
    return ranking.summary(shown, F.lit(rows.count()))


@query(f"{M}, a AS (SELECT * FROM market WHERE status = 'active') SELECT CAST(floor(min(price_eur) / 5000.0) * 5000 AS BIGINT) AS price_low, CAST(floor((max(price_eur) + 4999) / 5000.0) * 5000 AS BIGINT) AS price_high, CAST(floor(min(area_m2) / 5) * 5 AS BIGINT) AS area_low, CAST(floor((max(area_m2) + 4) / 5) * 5 AS BIGINT) AS area_high, CAST(min(declared_rooms) AS BIGINT) AS rooms_low, CAST(max(declared_rooms) AS BIGINT) AS rooms_high, CAST(CASE WHEN min(private_rooms) = 0 THEN 1 ELSE min(private_rooms) END AS BIGINT) AS private_low, CAST(max(private_rooms) AS BIGINT) AS private_high FROM a")
def filter_bounds(spark, sf):
    return ranking.bounds(bind(spark, sf, "market"))


@query(f"{M} SELECT DISTINCT district FROM market WHERE district <> ''")
def districts(spark, sf):
    return ranking.districts(bind(spark, sf, "market"))


@query("WITH r AS (SELECT o_orderkey, o_totalprice, n_name, CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'inactive' END AS status FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) SELECT CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS position, o_orderkey, n_name, round(o_totalprice, 2) AS price FROM r WHERE status = 'active' AND n_name < 'NATION_2' ORDER BY position LIMIT 20")
def star_ranking_large(spark, sf):
    orders, customer, nation = (load(spark, sf, t) for t in ("orders", "customer", "nation"))
    rows = orders.where("o_orderstatus = 'O'").join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation.where("n_name < 'NATION_2'"), F.col("c_nationkey") == F.col("n_nationkey"))
    top = ranking.top(rows, 20, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()])
    return top.select("position", "o_orderkey", "n_name", F.round("o_totalprice", 2).alias("price"))


# ---- star joins, existence, latest -------------------------------------------------------------------------

S = ctes("listings", "states", "analyses")
_LATEST = ", latest AS (SELECT listing_id, max(version) AS version, arg_max(explanation, version) AS explanation FROM analyses WHERE state = 'finished' GROUP BY listing_id)"


@query(f"{S}{_LATEST} SELECT l.listing_id, l.district, coalesce(s.is_favorite, false) AS is_favorite, coalesce(s.is_rejected, false) AS is_rejected, coalesce(s.is_viewed, false) AS is_viewed, CASE WHEN s.is_rejected THEN 'rejected' WHEN s.is_favorite THEN 'favorite' WHEN s.is_viewed THEN 'viewed' ELSE 'unseen' END AS user_status, a.version AS analysis_version, sha256(a.explanation) AS explanation FROM listings l LEFT JOIN states s USING (listing_id) LEFT JOIN latest a USING (listing_id)")
def candidate_star_join(spark, sf):
    rows = star.candidate_star(bind(spark, sf, "listings"), bind(spark, sf, "states"), bind(spark, sf, "analyses"))
    return rows.select("listing_id", "district", "is_favorite", "is_rejected", "is_viewed", "user_status", "analysis_version", F.sha2("explanation", 256).alias("explanation"))


@query(f"{S}, sc AS (SELECT listing_id, CASE listing_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS profile_key, CAST(price_eur % 101 AS DOUBLE) AS score FROM listings) SELECT l.listing_id, sc.score FROM listings l LEFT JOIN sc ON sc.listing_id = l.listing_id AND sc.profile_key = 'a'")
def outer_join_profile(spark, sf):
    rows = bind(spark, sf, "listings")
    sc = rows.select("listing_id", F.when(F.col("listing_id") % 2 == 0, "a").otherwise("b").alias("profile_key"), (F.col("price_eur") % 101).cast("double").alias("score"))
    return star.candidate_star(rows, bind(spark, sf, "states"), bind(spark, sf, "analyses"), sc, "a").select("listing_id", "score")


@query(f"{S}{_LATEST} SELECT listing_id, version, sha256(explanation) AS digest FROM latest")
def latest_analysis(spark, sf):
    return star.latest_analysis(bind(spark, sf, "analyses")).select("listing_id", "version", F.sha2("explanation", 256).alias("digest"))


@query(f"{S} SELECT listing_id FROM listings l WHERE needs_ai OR NOT EXISTS (SELECT 1 FROM analyses a WHERE a.listing_id = l.listing_id AND a.state = 'finished')")
def pending_exists_or(spark, sf):
    return star.pending(bind(spark, sf, "listings"), bind(spark, sf, "analyses")).select("listing_id")


@query(f"{S} SELECT listing_id, EXISTS (SELECT 1 FROM states s WHERE s.listing_id = l.listing_id AND is_rejected) AS flagged FROM listings l")
def existence_flag(spark, sf):
    return star.with_flag(bind(spark, sf, "listings"), bind(spark, sf, "states").where("is_rejected"), "listing_id", "flagged").select("listing_id", "flagged")


@query(f"{S} SELECT listing_id, sha256(arg_min(explanation, version)) AS first_text FROM analyses GROUP BY listing_id")
def first_match_scalar(spark, sf):
    return star.first_by(bind(spark, sf, "analyses"), "listing_id", "explanation", "version", "t").select("listing_id", F.sha2("t", 256).alias("first_text"))


@query(f"{S} SELECT listing_id FROM listings WHERE (district <> '' OR street <> '') AND listing_id NOT IN (SELECT listing_id FROM states) ORDER BY listing_id LIMIT 100")
def ungeocoded_anti(spark, sf):
    return star.ungeocoded(bind(spark, sf, "listings"), bind(spark, sf, "states"), 100).select("listing_id")


@query(f"{S}, q AS (SELECT listing_id, 0 AS q, listing_id AS p FROM listings WHERE needs_ai UNION ALL SELECT listing_id, 1, -listing_id FROM states WHERE is_rejected), f AS (SELECT listing_id, min((q, p)) AS place FROM (SELECT listing_id, q, p FROM q) GROUP BY listing_id) SELECT listing_id, CAST(row_number() OVER (ORDER BY place, listing_id) AS INT) AS position FROM f")
def queue_order(spark, sf):
    first = bind(spark, sf, "listings").where("needs_ai").select("listing_id", F.col("listing_id").alias("pos"))
    second = bind(spark, sf, "states").where("is_rejected").select("listing_id", (-F.col("listing_id")).alias("pos"))
    return ranking.ordered_unique(first, second)


_PRIOR_VALUES = ", ".join(f"({i}, '{p[0]}', '{p[1]}', {p[3]}, {p[4]}, {p[5]})" for i, p in enumerate(star.PRIORS))


@query(f"{M}, l AS (SELECT *, CASE listing_id % 5 WHEN 0 THEN '602' WHEN 1 THEN ' LT proj.' WHEN 2 THEN 'stalin' WHEN 3 THEN '' END AS s, CASE listing_id % 3 WHEN 0 THEN 'Panel' WHEN 1 THEN 'brick' END AS b FROM market), p(i, name, kind, low, high, rooms) AS (VALUES {_PRIOR_VALUES}), r AS (SELECT listing_id, i, name, CASE WHEN s <> '' AND (contains(name, lower(trim(s))) OR contains(lower(trim(s)), name)) THEN 5 ELSE 0 END + CASE WHEN b <> '' AND contains(kind, lower(trim(b))) THEN 3 ELSE 0 END + CASE WHEN declared_rooms = rooms THEN 2 ELSE 0 END + CASE WHEN area_m2 BETWEEN low AND high THEN 2 ELSE 0 END AS relevance FROM l, p) SELECT listing_id, CAST(row_number() OVER (PARTITION BY listing_id ORDER BY relevance DESC, i) AS INT) AS position, name AS prior, relevance FROM r WHERE relevance > 0 QUALIFY position <= 6")
def layout_priors_top6(spark, sf):
    rows = bind(spark, sf, "market").selectExpr("listing_id", "area_m2", "declared_rooms", "CASE listing_id % 5 WHEN 0 THEN '602' WHEN 1 THEN ' LT proj.' WHEN 2 THEN 'stalin' WHEN 3 THEN '' END AS series", "CASE listing_id % 3 WHEN 0 THEN 'Panel' WHEN 1 THEN 'brick' END AS building_type")
    return star.prior_matches(rows)


# ---- places ------------------------------------------------------------------------------------------------

P = ctes("places", "pois")
_HAV = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"
_PAIR = _HAV.format(a="lat", b="poi_lat", c="lon", d="poi_lon")
_PRECISION = "CASE WHEN street <> '' AND house <> '' THEN 'exact_house' WHEN street <> '' THEN 'street_approx' WHEN district <> '' THEN 'district_approx' ELSE 'unknown' END"


def _piece(d: str, points) -> str:
    from itertools import pairwise

    steps = " ".join(f"WHEN {d} <= {x1} THEN {y0} + ({y1 - y0}) * (({d} - {x0}) / {float(x1 - x0)})" for (x0, y0), (x1, y1) in pairwise(points))
    return f"CASE WHEN {d} IS NULL THEN NULL WHEN {d} <= {points[0][0]} THEN {float(points[0][1])} {steps} ELSE {float(points[-1][1])} END"


_TO_CAMPUS = _HAV.format(a="lat", b=places.CAMPUS[0], c="lon", d=places.CAMPUS[1])
_TO_STATION = _HAV.format(a="lat", b=places.STATION[0], c="lon", d=places.STATION[1])


@query(f"{P}, e AS (SELECT *, {_PRECISION} AS precision FROM places), x AS (SELECT *, precision = 'exact_house' AND coalesce(confidence = 'high', false) AS enabled FROM e), y AS (SELECT *, CASE WHEN enabled THEN {_TO_CAMPUS} END AS dr, CASE WHEN enabled THEN {_TO_STATION} END AS ds FROM x) SELECT listing_id, precision, enabled, CASE WHEN NOT enabled THEN CASE precision WHEN 'street_approx' THEN 'Approximate address' WHEN 'district_approx' THEN 'District-level address' WHEN 'unknown' THEN 'Address unknown' ELSE 'Geocode confidence is not high' END || ' - location scores not calculated' END AS reason, round(dr, 1) AS rtu_distance, round({_piece('dr', geo.CAMPUS)}, 2) AS rtu_score, round(ds, 1) AS station_distance, round({_piece('ds', geo.STATION)}, 2) AS station_score FROM y")
def haversine_destinations(spark, sf):
    return places.location_scores(bind(spark, sf, "places")).select("listing_id", "precision", "enabled", "reason", "rtu_distance", "rtu_score", "station_distance", "station_score")


@query(f"{P} SELECT listing_id, poi_id, category, round(d, 1) AS distance_m FROM (SELECT listing_id, poi_id, category, {_PAIR} AS d FROM places, pois) WHERE d <= 1800")
def poi_distance_join(spark, sf):
    rows = bind(spark, sf, "places").select("listing_id", "lat", "lon")
    return places.near(rows, bind(spark, sf, "pois").drop("poi_name")).select("listing_id", "poi_id", "category", F.round("distance_m", 1).alias("distance_m"))


_BONUS = "least(s300 * 8 + greatest(0, s700 - s300) * 3 + greatest(0, s1200 - s700), 20)"


@query(f"{P}, k AS (SELECT listing_id, category, round(d, 1) AS d FROM (SELECT listing_id, category, {_PAIR} AS d FROM places, pois) WHERE d <= 1800), g AS (SELECT listing_id, min(d) FILTER (WHERE category = 'grocery_shop') AS ns, count(*) FILTER (WHERE category = 'grocery_shop' AND d <= 300) AS s300, count(*) FILTER (WHERE category = 'grocery_shop' AND d <= 700) AS s700, count(*) FILTER (WHERE category = 'grocery_shop' AND d <= 1200) AS s1200, min(d) FILTER (WHERE category = 'transport_stop') AS nt, count(*) FILTER (WHERE category = 'transport_stop' AND d <= 900) AS t900 FROM k GROUP BY listing_id), j AS (SELECT p.listing_id, fetched, ns, coalesce(s300, 0) AS s300, coalesce(s700, 0) AS s700, coalesce(s1200, 0) AS s1200, nt, coalesce(t900, 0) AS t900 FROM places p LEFT JOIN g USING (listing_id)) SELECT listing_id, CASE WHEN fetched THEN ns END AS nearest_shop, CASE WHEN fetched THEN s300 END AS shops_300, CASE WHEN fetched THEN s700 END AS shops_700, CASE WHEN fetched THEN s1200 END AS shops_1200, CASE WHEN fetched THEN nt END AS nearest_stop, CASE WHEN fetched THEN t900 END AS stops_900, round(CASE WHEN fetched THEN coalesce(CASE WHEN ns IS NOT NULL THEN least(100.0, {_piece('ns', geo.SHOP)} + {_BONUS}) END, 0) END, 2) AS shop_score, round(CASE WHEN fetched THEN coalesce(CASE WHEN nt IS NOT NULL THEN least(100.0, {_piece('nt', geo.STOP)} + least(t900 * 3, 18)) END, 0) END, 2) AS transport_score FROM j")
def infrastructure_summary(spark, sf):
    rows = bind(spark, sf, "places").select("listing_id", "lat", "lon", "fetched")
    return places.infrastructure_of(rows, bind(spark, sf, "pois")).drop("fetched", "lat", "lon")


@query(f"{P} SELECT DISTINCT poi_id, poi_name FROM (SELECT poi_id, poi_name, {_PAIR} AS d FROM places, pois WHERE status = 'active' AND category = 'grocery_shop') WHERE d <= 1800")
def poi_distinct_visible(spark, sf):
    visible = bind(spark, sf, "places").where("status = 'active'")
    return places.with_near(visible, bind(spark, sf, "pois").where("category = 'grocery_shop'")).select("poi_id", "poi_name").distinct()


@query(f"{P} SELECT listing_id, lat, lon, CASE WHEN status = 'inactive' THEN 'inactive' WHEN is_rejected THEN 'rejected' WHEN is_favorite THEN 'favorite' WHEN {_PRECISION} = 'street_approx' THEN 'approximate' WHEN {_PRECISION} = 'district_approx' THEN 'district' ELSE 'normal' END AS state, CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 80 THEN 'high' WHEN score >= 60 THEN 'medium' WHEN score >= 40 THEN 'low' ELSE 'very_low' END AS bucket FROM places")
def map_markers(spark, sf):
    return places.markers(bind(spark, sf, "places"))


@query(f"{P} SELECT listing_id, CASE {_PRECISION} WHEN 'exact_house' THEN street || ' ' || house || ', ' WHEN 'street_approx' THEN street || ', ' WHEN 'district_approx' THEN district || ', ' ELSE '' END || 'Riga, Latvia' AS lookup FROM places")
def geocode_queries(spark, sf):
    rows = bind(spark, sf, "places").withColumn("precision", geo.address_precision("district", "street", "house"))
    return rows.select("listing_id", places.geocode_query("precision", "district", "street", "house").alias("lookup"))


# ---- changes -----------------------------------------------------------------------------------------------

C = ctes("snapshots")
_CHANGED = """
  SELECT {k}, 'description_changed' AS event_type, sha256(o_description) AS old_value, sha256(description) AS new_value, CAST(NULL AS VARCHAR) AS delta_value FROM {t} WHERE has_detail AND o_description IS DISTINCT FROM description
  UNION ALL SELECT {k}, 'image_count_changed', CAST(o_images AS VARCHAR), CAST(coalesce(images, 0) AS VARCHAR), NULL FROM {t} WHERE has_detail AND o_images IS DISTINCT FROM images
  UNION ALL SELECT {k}, 'price_changed', CAST(o_price_eur AS VARCHAR), CAST(price_eur AS VARCHAR), CAST(price_eur - o_price_eur AS VARCHAR) FROM {t} WHERE o_price_eur IS DISTINCT FROM price_eur
  UNION ALL SELECT {k}, 'unique_visits_changed', CAST(o_visits AS VARCHAR), CAST(visits AS VARCHAR), CAST(visits - o_visits AS VARCHAR) FROM {t} WHERE visits IS NOT NULL AND o_visits IS DISTINCT FROM visits"""
_LAGGED = ", ".join(f"lag({c}) OVER w AS o_{c}" for c in ("price_eur", "visits", "description", "images"))


@query(f"{C}, lagged AS (SELECT *, {_LAGGED}, row_number() OVER w AS nth FROM snapshots WINDOW w AS (PARTITION BY listing_id ORDER BY checked_at)), pairs AS (SELECT * FROM lagged WHERE nth > 1), e AS ({_CHANGED.format(k='listing_id, checked_at', t='pairs')}) SELECT * FROM e")
def snapshot_changes(spark, sf):
    return changes.history_events(bind(spark, sf, "snapshots"))


@query(f"{C}, k AS (SELECT listing_id, arg_min(price_eur, checked_at) AS oldest, arg_max(price_eur, checked_at) AS latest, count(*) AS n FROM snapshots WHERE price_eur IS NOT NULL GROUP BY listing_id) SELECT listing_id, oldest, latest, CAST(round((latest - oldest) / CAST(oldest AS DOUBLE) * 100) AS BIGINT) AS change, CASE WHEN latest < oldest THEN 'good' ELSE 'risk' END AS kind FROM k WHERE n >= 2 AND oldest > 0 AND latest <> oldest")
def price_trend(spark, sf):
    return changes.price_trend(bind(spark, sf, "snapshots"))


_SPLIT = f"{C}, cut AS (SELECT max(checked_at) - INTERVAL 8 HOURS AS mid FROM snapshots), stored AS (SELECT * FROM snapshots, cut WHERE checked_at < mid QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY checked_at DESC) = 1), incoming AS (SELECT * FROM snapshots, cut WHERE checked_at >= mid QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY checked_at) = 1)"


def _halves(spark, sf):
    rows = bind(spark, sf, "snapshots")
    last = rows.agg(F.max("checked_at")).first()[0]
    return changes.split_at(rows, last - timedelta(hours=8))


_UPSERT = f"""{_SPLIT},
both_sides AS (SELECT coalesce(o.listing_id, n.listing_id) AS listing_id, o.listing_id IS NOT NULL AS has_o, n.listing_id IS NOT NULL AS has_n, n.has_detail,
  o.price_eur AS o_price_eur, n.price_eur, o.visits AS o_visits, n.visits, o.description AS o_description, n.description, o.images AS o_images, n.images FROM stored o FULL JOIN incoming n ON o.listing_id = n.listing_id),
pairs AS (SELECT * FROM both_sides WHERE has_o AND has_n), e AS ({_CHANGED.format(k='listing_id', t='pairs')}),
ev AS (SELECT listing_id, string_agg(event_type, ',' ORDER BY event_type) AS events FROM e GROUP BY listing_id)
SELECT listing_id, CASE WHEN NOT has_n THEN 'missing' WHEN NOT has_o THEN 'new' WHEN events IS NOT NULL THEN 'changed' ELSE 'unchanged' END AS outcome,
  CASE WHEN has_n THEN price_eur ELSE o_price_eur END AS price_eur, CASE WHEN has_n AND (has_detail OR NOT has_o) THEN visits ELSE o_visits END AS visits,
  CASE WHEN has_n AND (has_detail OR NOT has_o) THEN images ELSE o_images END AS images, CASE WHEN has_n THEN 'active' ELSE 'inactive' END AS status,
  coalesce(NOT has_o OR contains(events, 'description_changed') OR contains(events, 'image_count_changed'), false) AS needs_ai, coalesce(events, '') AS events
FROM both_sides LEFT JOIN ev USING (listing_id)"""


@query(_UPSERT)
def upsert_state(spark, sf):
    rows = changes.upsert(*_halves(spark, sf))
    return rows.select("listing_id", "outcome", "price_eur", "visits", "images", "status", "needs_ai", F.array_join("events", ",").alias("events"))


@query(f"WITH r AS ({_UPSERT}) SELECT count(*) FILTER (WHERE outcome <> 'missing') AS seen, count(*) FILTER (WHERE outcome = 'new') AS new, count(*) FILTER (WHERE outcome = 'changed') AS changed, count(*) FILTER (WHERE outcome = 'missing') AS inactive FROM r")
def run_counters(spark, sf):
    return changes.run_counters(changes.upsert(*_halves(spark, sf)))


@query(f"{_SPLIT} SELECT listing_id, CAST(NULL AS BIGINT) AS price_eur, false AS is_active, 'listing_became_inactive' AS event_type FROM stored WHERE listing_id NOT IN (SELECT listing_id FROM incoming)")
def missing_inactive(spark, sf):
    stored, incoming = _halves(spark, sf)
    return changes.missing(stored, incoming)


@query(f"{C} SELECT listing_id, count(*)::INT AS n, sha256(string_agg(coalesce(CAST(price_eur AS VARCHAR), '-'), ',' ORDER BY checked_at DESC, event_id DESC)) AS prices FROM snapshots GROUP BY listing_id")
def history_nested(spark, sf):
    rows = changes.nested_history(bind(spark, sf, "snapshots"))
    prices = F.array_join(F.transform("history", lambda x: F.coalesce(x["price_eur"].cast("string"), F.lit("-"))), ",")
    return rows.select("listing_id", "n", F.sha2(prices, 256).alias("prices"))


#: Actions by event: purchases mark favorites, refunds and every 7th event reject, the rest view.
_ACTION = "CASE WHEN event_id % 5 = 0 THEN 'favorite' WHEN event_id % 7 = 0 THEN 'rejected' ELSE 'viewed' END"


@query(f"WITH a AS (SELECT user_id AS listing_id, ts AS t, {_ACTION} AS action, event_id % 2 = 0 AS value FROM events), l AS (SELECT listing_id, bool_or(action = 'viewed') AS is_viewed, coalesce(arg_max(value, t) FILTER (WHERE action = 'favorite'), false) AS is_favorite, coalesce(arg_max(value, t) FILTER (WHERE action = 'rejected'), false) AS is_rejected FROM a GROUP BY listing_id) SELECT * FROM l")
def user_marks(spark, sf):
    rows = load(spark, sf, "events").selectExpr("user_id AS listing_id", "ts AS at", f"{_ACTION} AS action", "event_id % 2 = 0 AS value")
    return changes.user_states(rows).drop("user_status")


_STEP = (
    "CASE a.action WHEN 'viewed' THEN {'v': true, 'f': x.f, 'r': x.r, 's': CASE WHEN x.f OR x.r THEN x.s ELSE 'viewed' END, 'action': '', 'value': false}"
    " WHEN 'favorite' THEN {'v': x.v, 'f': a.value, 'r': x.r, 's': CASE WHEN a.value THEN 'favorite' WHEN x.r THEN 'rejected' WHEN x.v THEN 'viewed' ELSE 'unseen' END, 'action': '', 'value': false}"
    " ELSE {'v': x.v, 'f': x.f, 'r': a.value, 's': CASE WHEN a.value THEN 'rejected' WHEN x.f THEN 'favorite' WHEN x.v THEN 'viewed' ELSE 'unseen' END, 'action': '', 'value': false} END"
)


@query(f"WITH a AS (SELECT user_id AS listing_id, ts, {_ACTION} AS action, event_id % 2 = 0 AS value FROM events), l AS (SELECT listing_id, list_prepend({{'v': false, 'f': false, 'r': false, 's': 'unseen', 'action': '', 'value': false}}, list({{'v': false, 'f': false, 'r': false, 's': '', 'action': action, 'value': value}} ORDER BY ts, action, value)) AS todo FROM a GROUP BY listing_id), d AS (SELECT listing_id, list_reduce(todo, lambda x, a: {_STEP}) AS x FROM l) SELECT listing_id, x.v AS is_viewed, x.f AS is_favorite, x.r AS is_rejected, x.s AS user_status FROM d")
def user_state_machine(spark, sf):
    rows = load(spark, sf, "events").selectExpr("user_id AS listing_id", "ts AS at", f"{_ACTION} AS action", "event_id % 2 = 0 AS value")
    return changes.user_states(rows)


# ---- texts -------------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def stable_hash(spark, sf):
    return load(spark, sf, "documents").select("doc_id", text.stable_hash("text").alias("digest"))


#: DuckDB decodes no entities: the ones that the tables hold, in the order in which a later one cannot make an earlier one.
_ENTITIES = {"&nbsp;": "chr(160)", "&lt;": "'<'", "&gt;": "'>'", "&quot;": "chr(34)", "&#39;": "chr(39)", "&amp;": "'&'"}


def _decoded(v: str) -> str:
    for name, char in _ENTITIES.items():
        v = f"replace({v}, '{name}', {char})"
    return v


@query(f"SELECT doc_id, sha256(nullif(trim(regexp_replace(regexp_replace(replace({_decoded('text')}, chr(160), ' '), '[ \\t\\r\\f\\x0B]+', ' ', 'g'), '\\n\\s+', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)), '')) AS digest FROM documents")
def clean_text(spark, sf):
    """All documents, with entities to decode and null ones too."""
    return load(spark, sf, "documents").select("doc_id", F.sha2(text.clean_text("text"), 256).alias("digest"))


_NUMBERS = "CASE p_partkey % 6 WHEN 0 THEN 'ca. ' || (p_partkey * 37) || ' 500 €' WHEN 1 THEN p_size || ',5 m2' WHEN 2 THEN p_size || '.25/9' WHEN 3 THEN p_size || ' / 12' WHEN 4 THEN 'none' ELSE '1 200 € (2 909.09 € / m2)' END"


@query(f"WITH t AS (SELECT p_partkey, {_NUMBERS} AS s FROM part), r AS (SELECT *, nullif(regexp_replace(regexp_extract(s, '[0-9][0-9\\s,.]*'), '[^0-9]', '', 'g'), '') AS i, nullif(replace(replace(regexp_extract(s, '[0-9][0-9\\s]*(?:[,.][0-9]+)?'), ' ', ''), ',', '.'), '') AS f, nullif(regexp_replace(regexp_extract(split_part(s, '€', 1), '[0-9][0-9\\s,.]*'), '[^0-9]', '', 'g'), '') AS p FROM t) SELECT p_partkey, try_cast(i AS BIGINT) AS whole, try_cast(f AS DOUBLE) AS number, try_cast(p AS BIGINT) AS price, CASE WHEN s LIKE '1 200%' THEN 2909.09::DOUBLE END AS per_m2, CASE WHEN regexp_matches(s, '[0-9]+\\s*/\\s*[0-9]+') THEN try_cast(regexp_extract(s, '([0-9]+)\\s*/\\s*([0-9]+)', 1) AS BIGINT) ELSE try_cast(i AS BIGINT) END AS floor, try_cast(nullif(regexp_extract(s, '([0-9]+)\\s*/\\s*([0-9]+)', 2), '') AS BIGINT) AS total FROM r")
def parse_numbers(spark, sf):
    rows = load(spark, sf, "part").selectExpr("p_partkey", f"{_NUMBERS} AS s")
    f = text.floors("s")
    return rows.select("p_partkey", text.parse_int("s").alias("whole"), text.parse_float("s").alias("number"), text.price_eur("s").alias("price"), text.price_per_m2("s").alias("per_m2"), f["floor"].alias("floor"), f["total"].alias("total"))


_ADDRESS = "CASE s_suppkey % 4 WHEN 0 THEN 'Stabu iela ' || s_suppkey || '-' || s_nationkey || ' [Karte]' WHEN 1 THEN 'Brivibas  gatve ' || s_suppkey || 'a' WHEN 2 THEN 'Katlakalna iela' ELSE '  ' END"


@query(f"WITH t AS (SELECT s_suppkey, s_nationkey FROM supplier) SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Stabu iela' WHEN 1 THEN 'Brivibas gatve' WHEN 2 THEN 'Katlakalna iela' END AS street, CASE s_suppkey % 4 WHEN 0 THEN s_suppkey || '-' || s_nationkey WHEN 1 THEN s_suppkey || 'a' END AS number FROM t")
def split_address(spark, sf):
    rows = load(spark, sf, "supplier").selectExpr("s_suppkey", f"{_ADDRESS} AS s").withColumn("a", text.address_parts("s"))
    return rows.select("s_suppkey", "a.street", "a.number")


@query("SELECT doc_id, contains(lower(coalesce(text, '')), 'stove') OR contains(lower(coalesce(text, '')), 'krāsns') AS stove_risk, contains(lower(coalesce(text, '')), 'koka') OR contains(lower(coalesce(text, '')), 'wooden') AS wooden_risk, CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 END AS effective_rooms FROM documents")
def keyword_risk(spark, sf):
    rows = load(spark, sf, "documents").selectExpr("doc_id", "text AS description", "doc_id % 4 AS declared_rooms")
    return analysis.stand_in(rows).select("doc_id", "stove_risk", "wooden_risk", "effective_rooms")


_T = "coalesce(district, 'Unknown district') || ' - ' || coalesce(street, 'Unknown street') || ' - AI: ' || coalesce(private_rooms || ' private' || CASE WHEN kitchen_living THEN ' + kitchen-living' ELSE '' END, 'unclear') || ' / SS: ' || coalesce(CAST(declared_rooms AS VARCHAR), 'unknown') || ' - ' || CAST(CAST(area_m2 AS BIGINT) AS VARCHAR) || ' m2 - ' || replace(format('{:,}', price_eur), ',', ' ') || ' EUR'"


@query(f"{M} SELECT listing_id, {_T} AS title FROM market")
def titles(spark, sf):
    return views.titles(bind(spark, sf, "market"))


_KEY = {
    "Favorite": "is_favorite", "Note": "has_notes", "Room conflict": "room_conflict", "Layout confirmed": "layout_label = 'Confirmed'", "Floor plan": "has_floor_plan", "Kitchen-living": "kitchen_living",
    "Good price": "price_value_score >= 80", views.SUSPICIOUS: "suspicious", "High mortgage risk": "risk IN ('High', 'Critical')", "Stove heating": "stove", "Wooden building": "wooden",
}


@query(f"{SCORED} SELECT listing_id, concat_ws(', ', {', '.join(f'''CASE WHEN {c} THEN '{k}' END''' for k, c in _KEY.items())}) AS flags FROM blocks")
def key_flags(spark, sf):
    rows = scoring.with_blocks(bind(spark, sf, "market"))
    return rows.select("listing_id", F.array_join(views.key_flags(), ", ").alias("flags"))


#: What the tables lack for a comparison: distances, shops near by, building type and overall score.
_APART = {
    "rtu_distance": "CASE WHEN listing_id % 13 <> 0 THEN CAST(listing_id * 371 % 40000 AS DOUBLE) / 10 END", "station_distance": "CASE WHEN listing_id % 11 <> 0 THEN CAST(listing_id * 173 % 30000 AS DOUBLE) / 10 END",
    "shops_1200": "CASE WHEN listing_id % 9 <> 8 THEN CAST(listing_id % 12 AS INT) END", "building_type": "CASE WHEN listing_id % 2 = 0 THEN 'Panel' END", "score": "CASE WHEN listing_id % 5 <> 3 THEN CAST(listing_id * 29 % 1000 AS DOUBLE) / 10 END",
}


def _compared(spark, sf):
    return market.with_prices(bind(spark, sf, "market")).withColumns({k: F.expr(v) for k, v in _APART.items()})


_UNKNOWN = lambda v: f"coalesce({v}, 'unknown')"


@query(f"{M}, c AS (SELECT *, price_eur / area_m2 AS ppm2, {', '.join(f'{v} AS {k}' for k, v in _APART.items())} FROM market WHERE listing_id IN (3, 8, 12, 26, 44)), r AS (" + " UNION ALL ".join(f"SELECT listing_id, {i} AS row, '{n}' AS label, {v} AS value FROM c" for i, (n, v) in enumerate((
    ("Price", "replace(format('{:,}', price_eur), ',', ' ') || ' EUR'"), ("EUR/m2", "replace(format('{:,.2f}', ppm2), ',', ' ') || ' EUR/m2'"), ("Area", "CAST(CAST(area_m2 AS BIGINT) AS VARCHAR) || ' m2'"),
    ("Effective private rooms", _UNKNOWN("CAST(private_rooms AS VARCHAR)")), ("SS-declared rooms", "CAST(declared_rooms AS VARCHAR)"), ("Layout confidence", _UNKNOWN("layout_label")), ("Mortgage risk", _UNKNOWN("risk")),
    ("RTU distance", _UNKNOWN("printf('%.0f m', rtu_distance)")), ("Transport score", _UNKNOWN("printf('%.1f', transport_score)")), ("Central station distance", _UNKNOWN("printf('%.0f m', station_distance)")),
    ("Shops within 1200 m", _UNKNOWN("CAST(shops_1200 AS VARCHAR)")), ("Building / series", _UNKNOWN("coalesce(series, building_type)")), ("Score", _UNKNOWN("printf('%.1f', score)")),
    ("Flags", "coalesce(nullif(concat_ws(', ', CASE WHEN is_favorite THEN 'Favorite' END, CASE WHEN private_rooms <> declared_rooms THEN 'Room conflict' END, CASE WHEN kitchen_living THEN 'Kitchen-living' END, CASE WHEN risk IN ('High', 'Critical') THEN 'High mortgage risk' END), ''), 'none')"),
))) + ") SELECT row, label, " + ", ".join(f"max(value) FILTER (WHERE listing_id = {k}) AS l{i}" for i, k in enumerate((26, 3, 44, 8, 12), 1)) + " FROM r GROUP BY row, label")
def comparison_transpose(spark, sf):
    """All 14 attribute rows."""
    return views.comparison(_compared(spark, sf), [26, 3, 44, 8, 12])


@query(f"{SCORED}, long AS ({_LONG}), v AS (SELECT listing_id, block_key AS block, CAST(round(score) AS INT) AS value FROM long WHERE score IS NOT NULL) SELECT listing_id, CAST(row_number() OVER (PARTITION BY listing_id ORDER BY abs(value - 50) DESC, block) AS INT) AS place, block, value FROM v QUALIFY place <= 5")
def breakdown_top5(spark, sf):
    return views.top_blocks(scoring.with_blocks(bind(spark, sf, "market")))


@query(f"{M} SELECT listing_id, CASE WHEN n > 0 THEN CAST(round(total / n) AS INT) END AS location FROM (SELECT listing_id, coalesce(rtu_score, 0) + coalesce(transport_score, 0) + coalesce(station_score, 0) + coalesce(shop_score, 0) AS total, (rtu_score IS NOT NULL)::INT + (transport_score IS NOT NULL)::INT + (station_score IS NOT NULL)::INT + (shop_score IS NOT NULL)::INT AS n FROM market)")
def location_value(spark, sf):
    return bind(spark, sf, "market").select("listing_id", views.location_value().alias("location"))


@query(f"{M} SELECT listing_id, coalesce(risk, 'Unknown') AS level, CASE risk WHEN 'Low' THEN 'risk-low' WHEN 'Medium' THEN 'risk-medium' WHEN 'High' THEN 'risk-high' WHEN 'Critical' THEN 'risk-high' ELSE 'neutral' END AS kind FROM market")
def mortgage_badges(spark, sf):
    rows = bind(spark, sf, "market").withColumn("m", views.mortgage())
    return rows.select("listing_id", F.col("m.level").alias("level"), F.col("m.type").alias("kind"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def json_props(spark, sf):
    return load(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT label, count(*) AS n FROM (SELECT CASE WHEN raw IN ('Confirmed', 'Likely', 'Unclear', 'Conflict') THEN raw END AS label FROM (SELECT CASE c_custkey % 6 WHEN 0 THEN 'Confirmed' WHEN 1 THEN 'likely' WHEN 2 THEN 'Unclear' WHEN 3 THEN 'Conflict' WHEN 4 THEN '' END AS raw FROM customer)) GROUP BY label")
def enum_parse(spark, sf):
    raw = load(spark, sf, "customer").selectExpr("CASE c_custkey % 6 WHEN 0 THEN 'Confirmed' WHEN 1 THEN 'likely' WHEN 2 THEN 'Unclear' WHEN 3 THEN 'Conflict' WHEN 4 THEN '' END AS raw")
    return raw.groupBy(enum("raw", ("Confirmed", "Likely", "Unclear", "Conflict")).alias("label")).agg(F.count("*").alias("n"))


# ---- read models and small steps ---------------------------------------------------------------------------

_ROOMS = "coalesce(CAST(private_rooms AS VARCHAR) || CASE WHEN kitchen_living THEN '+K' ELSE '' END, '—')"


@query(f"{M}, r AS (SELECT *, CAST(row_number() OVER (ORDER BY transport_score IS NULL, coalesce(transport_score, 0) DESC, price_eur, listing_id) AS INT) AS position FROM market WHERE {_BASE}) SELECT position, listing_id, CAST(round(transport_score) AS INT) AS score, CASE WHEN transport_score IS NULL THEN 'unknown' WHEN transport_score >= 80 THEN 'high' WHEN transport_score >= 60 THEN 'medium' WHEN transport_score >= 40 THEN 'low' ELSE 'very_low' END AS bucket, district, coalesce(street, 'Unknown street') AS address, {_ROOMS} AS ai_rooms, CASE WHEN coalesce(room_conflict, false) THEN 'mismatch' WHEN kitchen_living OR private_rooms IS NULL THEN 'neutral' ELSE 'ai' END AS rooms_type, CAST(declared_rooms AS VARCHAR) AS ss_rooms, CAST(CAST(area_m2 AS BIGINT) AS VARCHAR) || ' m²' AS area, replace(format('{{:,}}', price_eur), ',', ' ') || ' €' AS price FROM r WHERE position <= 100")
def ranking_rows(spark, sf):
    rows = bind(spark, sf, "market").withColumn("score", F.col("transport_score")).withColumn("price_value_score", F.lit(None).cast("double")).withColumn("suspicious", F.lit(False))
    return views.ranking_rows(ranking.ranked(rows, FilterSpec(), 100)).drop("flags")


_DETAIL = [
    ("Favorite", "is_favorite"), ("Rejected", "is_rejected"), ("Inactive", "status = 'inactive'"), ("Room conflict", "room_conflict"), ("Layout unclear", "layout_label = 'Unclear'"),
    ("Layout confirmed by floor plan", "has_floor_plan AND coalesce(layout_label = 'Confirmed', false)"), ("Floor plan", "has_floor_plan AND NOT coalesce(layout_label = 'Confirmed', false)"),
    ("Kitchen-living is not counted as private room", "kitchen_living"), ("High mortgage risk", "risk IN ('High', 'Critical')"), ("Stove heating risk", "stove"), ("Wooden building risk", "wooden"),
]


@query(f"{M} SELECT listing_id, coalesce(nullif(concat_ws('; ', {', '.join(f"""CASE WHEN {c} THEN '{k}' END""" for k, c in _DETAIL)}, CASE WHEN private_rooms IS NOT NULL THEN 'AI: ' || private_rooms || ' private' || CASE WHEN kitchen_living THEN ' + kitchen-living' ELSE '' END || ' / SS: ' || declared_rooms END), ''), 'No major flags') AS flags FROM market")
def detail_flags(spark, sf):
    rows = bind(spark, sf, "market").withColumn("suspicious", F.lit(False))
    return rows.select("listing_id", F.array_join(views.detail_flags(), "; ").alias("flags"))


@query(f"{SCORED} SELECT listing_id, concat_ws(', ', CASE WHEN price_value_score >= 80 THEN 'Good price' END, CASE WHEN transport_score >= 70 THEN 'Strong transport' END, CASE WHEN layout_label = 'Confirmed' THEN 'Layout confirmed' END, CASE WHEN is_favorite THEN 'Favorite' END, CASE WHEN room_conflict THEN 'Room conflict' END, CASE WHEN risk IN ('High', 'Critical') THEN 'High mortgage risk' END) AS badges FROM blocks")
def detail_badges(spark, sf):
    return scoring.with_blocks(bind(spark, sf, "market")).select("listing_id", F.array_join(views.badges(), ", ").alias("badges"))


@query(f"{S} SELECT listing_id, is_favorite, is_rejected, is_viewed FROM states UNION ALL SELECT listing_id, false, false, false FROM listings WHERE listing_id NOT IN (SELECT listing_id FROM states)")
def insert_missing_states(spark, sf):
    fresh = bind(spark, sf, "listings").select("listing_id", *(F.lit(False).alias(c) for c in ("is_favorite", "is_rejected", "is_viewed")))
    return changes.insert_missing(bind(spark, sf, "states"), fresh, "listing_id")


@query("SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def latest_wins(spark, sf):
    rows = load(spark, sf, "events").select("user_id", "event_type", "event_id", "ts")
    return changes.latest_wins(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), ["user_id"], "ts")


@query("WITH s AS (SELECT p_partkey AS ss_id, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS district, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS rooms FROM part), d AS (SELECT p_partkey AS ss_id, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_type END AS district, CASE WHEN p_partkey % 5 = 0 THEN 0 END AS rooms FROM part WHERE p_partkey % 7 <> 0) SELECT s.ss_id, coalesce(nullif(d.district, ''), nullif(s.district, '')) AS district, coalesce(d.rooms, s.rooms) AS rooms FROM s LEFT JOIN d USING (ss_id)")
def summary_detail_merge(spark, sf):
    part = load(spark, sf, "part")
    summary = part.selectExpr("p_partkey AS ss_id", "CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS district", "CASE WHEN p_partkey % 3 = 0 THEN p_size END AS rooms")
    detail = part.where("p_partkey % 7 <> 0").selectExpr("p_partkey AS ss_id", "CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_type END AS district", "CASE WHEN p_partkey % 5 = 0 THEN 0 END AS rooms")
    return star.merged_listing(summary, detail, text=("district",), plain=("rooms",))


@query(f"{P}, top AS (SELECT listing_id FROM places WHERE status = 'active' ORDER BY score DESC NULLS LAST, listing_id LIMIT 25) SELECT listing_id, lat, lon FROM places WHERE listing_id IN (SELECT listing_id FROM top)")
def visible_markers(spark, sf):
    rows = bind(spark, sf, "places")
    shown = rows.where("status = 'active'").orderBy(F.col("score").desc_nulls_last(), "listing_id").limit(25)
    return filters.by_ids(places.markers(rows), shown).select("listing_id", "lat", "lon")


@query(f"{P} SELECT poi_id, poi_name, category, CAST(row_number() OVER (ORDER BY poi_name NULLS FIRST, poi_id) AS INT) AS position FROM pois")
def poi_order(spark, sf):
    """All points of interest in order."""
    return ranking.positions(bind(spark, sf, "pois"), [F.col("poi_name").asc_nulls_first(), F.col("poi_id").asc()]).select("poi_id", "poi_name", "category", "position")


@query(f"{C}, k AS (SELECT listing_id, arg_min(price_eur, checked_at) AS o, arg_max(price_eur, checked_at) AS l, count(*) AS n FROM snapshots WHERE price_eur IS NOT NULL GROUP BY listing_id) SELECT listing_id, CASE WHEN l < o THEN '-' ELSE '+' END || abs(CAST(round((l - o) / CAST(o AS DOUBLE) * 100) AS BIGINT)) || '%' AS text, CASE WHEN l < o THEN 'good' ELSE 'risk' END AS kind FROM k WHERE n >= 2 AND o > 0 AND l <> o")
def price_trend_text(spark, sf):
    return views.history_lines(changes.price_trend(bind(spark, sf, "snapshots")))


@query(f"{M} SELECT listing_id, 'Price: ' || replace(format('{{:,}}', price_eur), ',', ' ') || ' EUR' AS price, 'Area: ' || CAST(CAST(area_m2 AS BIGINT) AS VARCHAR) || ' m2' AS area, 'Street: ' || coalesce(street, 'unknown') AS street, 'Building series: ' || coalesce(series, 'unknown') AS series FROM market")
def detail_lines(spark, sf):
    rows = market.with_prices(bind(spark, sf, "market")).select("listing_id", views.top_lines().alias("x"))
    return rows.select("listing_id", F.col("x")[0].alias("price"), F.col("x")[1].alias("area"), F.col("x")[4].alias("street"), F.col("x")[5].alias("series"))


@query("SELECT page_id, coalesce(try_cast(nullif(regexp_extract(url, '/page([0-9]+)\\.html(?:$|[?#])', 1), '') AS INT), 1) AS page FROM pages")
def page_numbers(spark, sf):
    return load(spark, sf, "pages").select("page_id", text.page_number("url").alias("page"))


@query("SELECT conv_id, sha256(coalesce(nullif(trim(max(text) FILTER (WHERE role = 'tool')), ''), nullif(trim(min(text) FILTER (WHERE role = 'user')), ''), '')) AS said FROM conversations GROUP BY conv_id")
def first_text(spark, sf):
    rows = load(spark, sf, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("role") == "tool", F.col("text"))).alias("a"), F.min(F.when(F.col("role") == "user", F.col("text"))).alias("b"))
    return rows.select("conv_id", F.sha2(text.first_text("a", "b"), 256).alias("said"))


_BREAKDOWN = " || ',' || ".join(f"""'"{b}":{{' || coalesce('"score":' || CAST(CAST(b_{b} AS DOUBLE) AS VARCHAR) || ',', '') || '"weight":{w}}}'""" for b, w in sorted((b, w) for b, w in zip(scoring.BLOCKS, scoring.PROFILES[scoring.DEFAULT_PROFILE], strict=True) if b not in ("floor", "condition")))


@query(f"{SCORED} SELECT listing_id, '{{' || {_BREAKDOWN} || '}}' AS breakdown FROM blocks")
def score_breakdown(spark, sf):
    return scoring.breakdown_json(scoring.with_blocks(bind(spark, sf, "market")))


@query()
def page_links(spark, sf):
    return pages.page_links(load(spark, sf, "pages"))


__all__ = ["filled", "flagship", "oracle_sql", "queries"]
