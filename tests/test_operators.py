"""Operators on small relations: levels, filters, ranking, places, changes, pages, analyses."""

import json
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from homeledger.operators import analysis, changes, filters, market, pages, places, ranking, scoring, star, views
from homeledger.operators import order_stats
from homeledger.operators.filters import FilterSpec
from homeledger.sources import stores

MARKET = "listing_id long, price_eur long, area_m2 double, district string, declared_rooms int, private_rooms int, series string, risk string, status string"


def listing(i, price=100_000, area=50.0, district="centre", rooms=2, private=2, series="602", risk=None, status="active"):
    return (i, price, area, district, rooms, private, series, risk, status)


def test_specific_level_wins(spark):
    rows = [listing(0, 90_000)] + [listing(i, 100_000 + 1000 * (i - 1)) for i in range(1, 7)]
    got = market.baselines(spark.createDataFrame(rows, MARKET)).where("listing_id = 0").first()
    assert (got.baseline_level, got.baseline_n, got.baseline_median) == ("series_building", 6, 2050.0)


def test_exclusions(spark):
    rows = [listing(0), listing(1, risk="Critical"), listing(2, status="inactive"), listing(3, 110_000), listing(4, 120_000), listing(5, 1), listing(6, area=None)]
    got = market.baselines(spark.createDataFrame(rows, MARKET), 10).where("listing_id = 0").first()
    assert (got.baseline_level, got.baseline_n, got.baseline_median) == ("riga", 2, 2300.0)


def test_suspicious(spark):
    rows = [listing(0, 50_000)] + [listing(i) for i in range(1, 7)]
    got = market.price_value(spark.createDataFrame(rows, MARKET)).where("listing_id = 0").first()
    assert got.suspicious and got.price_value_score == 95


def python_baseline(target, rows, least=5):
    ppm2 = lambda r: r[1] / r[2] if r[1] is not None and r[2] else None
    comp = [r for r in rows if r[0] != target[0] and r[8] == "active" and r[7] != "Critical" and ppm2(r) is not None and 100 <= ppm2(r) <= 10_000]

    def near(r):
        if not target[3] or r[3] != target[3]:
            return False
        if target[2] and r[2] and not 0.8 <= r[2] / target[2] <= 1.2:
            return False
        return not (target[4] and r[4] and abs(r[4] - target[4]) > 1)

    for level, ok in (("series_building", lambda r: near(r) and target[6] and r[6] == target[6]), ("ai_adjusted", lambda r: near(r) and target[5] is not None and r[5] == target[5]), ("district", near)):
        found = [ppm2(r) for r in comp if ok(r)]
        if len(found) >= least:
            return level, len(found), median(found)
    found = [ppm2(r) for r in comp]
    return ("riga", len(found), median(found)) if found else (None, None, None)


def test_baselines_at_random(spark):
    rng = random.Random(4)
    pick = lambda *x: rng.choice(x)
    rows = [listing(i, pick(None, 80_000, 90_000, 100_000, rng.randrange(20_000, 300_000)), pick(None, 0.0, 20.0, 25.0, 30.0, rng.uniform(15, 120)), pick("a", "b", "", None), pick(None, 0, 1, 2, 3, 5), pick(None, 0, 1, 2), pick(None, "", "602", "119"), pick(None, "Low", "Critical"), pick("active", "active", "inactive")) for i in range(300)]
    got = {r.listing_id: r for r in market.baselines(spark.createDataFrame(rows, MARKET)).collect()}
    for r in rows:
        level, n, mid = python_baseline(r, rows)
        g = got[r[0]]
        assert (g.baseline_level, g.baseline_n) == (level, n), r
        assert mid is None or abs(g.baseline_median - mid) <= 0.0051


def test_order_statistics(spark, monkeypatch):
    rng = random.Random(7)
    values = [float(rng.randrange(50_000)) for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ranks = order_stats.middle_ranks(len(values))
    want = {k: sorted(values)[k - 1] for k in ranks}
    assert order_stats.order_statistics(df, F.col("v"), ranks, len(values)) == want
    monkeypatch.setattr(order_stats, "MOST", 500)
    assert order_stats.order_statistics(df, F.col("v"), ranks, len(values)) == want


CANDIDATE = "listing_id long, score double, status string, is_favorite boolean, is_rejected boolean, is_viewed boolean, price_eur long"


def test_workflow_tabs(spark):
    t, f = True, False
    rows = [(1, 1.0, "active", f, f, f, 1), (2, 1.0, "active", f, f, t, 1), (3, 1.0, "active", t, f, t, 1), (4, 1.0, "active", f, t, None, 1), (5, 1.0, "inactive", f, None, f, 1), (6, 1.0, "inactive", t, f, f, 1)]
    df = spark.createDataFrame(rows, CANDIDATE)
    got = {tab: {r.listing_id for r in filters.apply(df, filters.for_tab(tab)).collect()} for tab in filters.TABS}
    assert got == {"all": {1, 2, 3}, "new": {1}, "favorites": {3, 6}, "rejected": {4}, "inactive": {5, 6}}
    with pytest.raises(ValueError):
        filters.for_tab("other")


def test_filter_specs():
    spec = FilterSpec(price_min=1, districts=frozenset(("b", "a")), declared_rooms=frozenset((3, 1)))
    text = filters.to_json(spec)
    assert filters.from_json(text) == spec and filters.from_json(json.dumps(json.loads(text) | {"new": 1})) == spec
    made = filters.from_payload({"price_min": 0, "price_max": "200", "district": "a", "declared_rooms_min": 3, "declared_rooms_max": 1, "hide_viewed": 1})
    assert made == FilterSpec(price_max=200, districts=frozenset("a"), declared_rooms=frozenset((1, 2, 3)), hide_viewed=True)
    assert filters.to_slider(made)["declared_rooms"] == (1, 3) and filters.to_slider(FilterSpec())["district"] is None


def test_ranking(spark):
    rows = [(1, 80.0, "active", None, None, None, 5), (2, 95.0, "active", None, True, None, 5), (3, 90.0, "active", None, None, None, 5), (4, None, "active", None, None, None, 1), (5, 80.0, "active", None, None, None, 4), (6, 80.0, "active", None, None, None, None)]
    df = spark.createDataFrame(rows, CANDIDATE)
    assert [r.listing_id for r in ranking.ranked(df, FilterSpec(), 10).orderBy("position").collect()] == [3, 5, 1, 6, 4]
    many = spark.range(1000).selectExpr("id AS listing_id", "CAST(id % 7 AS double) AS score", "id % 11 AS price_eur")
    a = {r.listing_id: r.position for r in ranking.positions(many).collect()}
    b = {r.listing_id: r.position for r in ranking.top(many, 1000).collect()}
    assert a == b and sorted(a.values()) == list(range(1, 1001))


def test_profiles(spark):
    weights = {(r.profile_key, r.block_key): r.weight for r in scoring.profile_weights(spark).collect()}
    assert len(weights) == 9 * 12 and weights["best_price", "price_value"] == 5
    df = spark.createDataFrame([(1, 120.0, None), (2, None, None), (3, -5.0, 50.0)], "listing_id long, b_price_value double, b_room_privacy double")
    got = [r.s for r in df.select(scoring.overall({"price_value": 5, "room_privacy": 1}).alias("s")).collect()]
    assert got == [100.0, None, 8.33]
    assert df.select(scoring.overall({"price_value": 0}).alias("s")).first().s is None


def test_grid_join(spark):
    rng = random.Random(3)
    left = spark.createDataFrame([(i, 56.9 + rng.random() / 5, 24 + rng.random() / 5) for i in range(40)], "listing_id long, lat double, lon double")
    right = spark.createDataFrame([(i, 56.9 + rng.random() / 5, 24 + rng.random() / 5) for i in range(200)], "poi_id long, poi_lat double, poi_lon double")
    got = {(r.listing_id, r.poi_id) for r in places.near(left, right).collect()}
    plain = left.crossJoin(right).where(places.geo.haversine_m("lat", "lon", "poi_lat", "poi_lon") <= places.RADIUS_M)
    assert got == {(r.listing_id, r.poi_id) for r in plain.collect()} and got


def test_poi_payload(spark):
    node = {"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"shop": "supermarket", "public_transport": "platform", "brand": "B"}}
    payload = {"elements": [node, {"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}, "tags": {"railway": "halt", "name": "N"}}, {"type": "node", "id": 3, "lat": 1.0, "lon": 1.0, "tags": {"amenity": "cafe"}}, {"type": "way", "id": 4, "tags": {"shop": "grocery"}}, node | {"lat": 9.0}]}
    rows = places.poi_rows(spark.createDataFrame([(json.dumps(payload),)], "payload string")).orderBy("first", "category").collect()
    assert [(r.element_id, r.category, r.lat, r.name) for r in rows] == [(1, "grocery_shop", 9.0, "B"), (1, "transport_stop", 9.0, "B"), (2, "transport_stop", 3.0, "N")]


def test_freshness(spark):
    rows = [(1, 1.0, 1.0, 1.0, 1.0, 1800.0, "default", "2024-01-07T00:00:00"), (2, 1.0, 1.0, 1.1, 1.0, 1800.0, "default", "2024-01-07T00:00:00"), (3, 1.0, 1.0, 1.0, 1.0, 900.0, "default", "2024-01-07T00:00:00"), (4, 1.0, 1.0, 1.0, 1.0, 1800.0, "default", "2023-12-01T00:00:00"), (5, 1.0, 1.0, 1.0, 1.0, 1800.0, "default", "?"), (6, 1.0, 1.0, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "listing_id long, lat double, lon double, c_lat double, c_lon double, radius_m double, endpoint string, fetched_at string")
    assert [r.fresh for r in places.fresh(df, "2024-01-08 00:00:00").orderBy("listing_id").collect()] == [True, False, False, False, False, False]


SNAP = "listing_id long, checked_at timestamp_ntz, price_eur long, visits long, description string, images long, has_detail boolean, status string"


def test_upsert(spark):
    from datetime import datetime

    at = datetime(2024, 1, 1)
    old = [(1, at, 100, 5, "a", 2, True, "active"), (2, at, 100, 5, "a", 2, True, "inactive"), (3, at, 100, 5, "a", 2, True, "active"), (4, at, None, None, "a", None, True, "active")]
    new = [(1, at, 90, None, None, None, False, None), (2, at, 100, 5, "b", None, True, None), (4, at, None, 7, "a", None, True, None), (5, at, 1, 1, "x", 1, True, None)]
    got = {r.listing_id: r for r in changes.upsert(spark.createDataFrame(old, SNAP), spark.createDataFrame(new, SNAP)).collect()}
    assert (got[1].outcome, got[1].price_eur, got[1].visits, got[1].description, got[1].events, got[1].needs_ai) == ("changed", 90, 5, "a", ["price_changed"], False)
    assert got[2].reactivated and got[2].events == ["description_changed", "image_count_changed"] and got[2].needs_ai and got[2].images is None
    assert (got[3].outcome, got[3].status, got[3].price_eur) == ("missing", "inactive", 100)
    assert got[4].events == ["unique_visits_changed"] and (got[5].outcome, got[5].needs_ai, got[5].events) == ("new", True, [])


def test_user_states(spark):
    def status(*actions):
        df = spark.createDataFrame([(1, i, a, v) for i, (a, v) in enumerate(actions)], "listing_id long, at int, action string, value boolean")
        return changes.user_states(df).first().user_status

    seen, fav, no = ("viewed", True), ("favorite", True), ("rejected", True)
    assert status(seen) == "viewed" and status(seen, fav, seen) == "favorite" and status(fav, no) == "rejected"
    assert status(fav, no, ("rejected", False)) == "favorite" and status(seen, fav, ("favorite", False)) == "viewed" and status(fav, ("favorite", False)) == "unseen"


HTML = """<html><body><table><tr id="tr_51"><td><input></td><td><a href="/msg/en/51.html"><img></a></td><td><a class="am" href="/msg/en/51.html">Nice&nbsp;flat</a></td>
<td>centrs<br>Stabu 87</td><td>2</td><td>44</td><td>1/5</td><td>602</td><td>128 000 €</td></tr><tr id="tr_52"><td>short</td></tr></table>
<button class="navia">9</button><a name="nav_id" rel="prev" href="page8.html">Iepriekšējie</a><a name="nav_id" href="page10.html">10</a><a name="nav_id" href="page11.html">11</a></body></html>"""
DETAIL = """<div id="msg_div_msg">Text of<br>the message<table class="options_list"><tr><td>Iela:</td><td>Stabu iela 87 [Karte]</td></tr><tr><td>Cena:</td><td>128 000 € (2 909.09 €/m²)</td></tr></table></div>
<p>Datums: 01.02.2024 10:00 <b>Unikālo apmeklējumu skaits: 37</p><br><a href="https://h/gallery/1/a.jpg">1</a><a href="https://h/gallery/1/a.jpg">1</a><a href="/x.png">no</a>"""


def test_pages(spark):
    df = spark.createDataFrame([("http://h/page9.html", HTML)], "url string, html string")
    (r,) = pages.parse_list_pages(df).collect()
    assert (r.ss_id, r.url, r.title, r.district, r.street, r.price_text, r.cells["series"]) == ("51", "http://h/msg/en/51.html", "Nice flat", "centrs", "Stabu 87", "128 000 €", "602")
    assert pages.navigation(HTML, "http://h/page9.html") == {"next_url": "http://h/page10.html", "max_page": 11}
    (d,) = pages.parse_detail_pages(spark.createDataFrame([("u", DETAIL)], "url string, html string")).collect()
    assert (d.description, d.address_text, d.visits, d.images, d.date_text) == ("Text of\nthe message", "Stabu iela 87", 37, ["https://h/gallery/1/a.jpg"], "01.02.2024 10:00")


def test_crawl(spark):
    row = lambda i: f'<tr id="tr_{i}">' + "<td>x</td>" * 7 + f'<td><a href="/msg/{i}">t</a></td></tr>'
    sizes = {"http://h": range(30), "http://h/page2.html": range(20, 50), "http://h/page3.html": range(50, 51)}

    def get(url):
        return "<table>" + "".join(map(row, sizes[url])) + "</table>"

    got = stores.crawl(spark, "http://h", stores.Client(get))
    assert got.count() == 51 and got.where("ss_id = '25'").first().page == 1
    failing = stores.Client(lambda u: 1 / 0, attempts=2).fetch("u")
    assert failing[0] is None and "division" in failing[1]


def test_analysis(spark):
    ok = json.dumps({"images": [{"image_id": "1", "category": "kitchen", "likely_room_group": "r"}], "floor_plan_image_ids": [" 1 ", ""]})
    bad = json.dumps({"images": [{"image_id": "1", "category": "cellar"}]})
    rows = analysis.validated_pass1(spark.createDataFrame([(1, ok), (2, bad), (3, "[]"), (4, "{")], "listing_id long, raw string")).orderBy("listing_id").collect()
    assert [r.errors for r in rows] == [[], ["images.category: not in its domain"], ["not an object"], ["not an object"]] and rows[0].floor_plan_image_ids == ["1"]
    two = json.dumps({"effective_private_rooms": 2, "layout_confidence_label": "Sure", "mortgage_risk_level": "Low", "layout_explanation_user": "x"})
    (r,) = analysis.validated_pass2(spark.createDataFrame([(1, two)], "listing_id long, raw string")).collect()
    assert r.effective_private_rooms == 2 and r.errors == ["layout_confidence_label: not in its domain", "mortgage_explanation_user: text missing"]
    df = spark.createDataFrame([(1, ["1", "2"], ["2", "1"], ["1"]), (2, ["1"], ["1", "1"], []), (3, ["1"], ["1"], ["9"])], "listing_id long, e array<string>, c array<string>, f array<string>")
    assert [r.error is None for r in star.checked_ids(df, "e", "c", "f").orderBy("listing_id").collect()] == [True, False, False]
    ids = spark.createDataFrame([('[3, "2", 3, -1, "x", 5]',)], "v string").select(analysis.positive_ids("v").alias("x")).first().x
    assert ids == [3, 2, 5]


def test_views(spark):
    kinds = spark.createDataFrame([("Good price",), ("Wooden building",), ("Wooden building risk",), ("Floor plan",)], "v string").select(views.chip_kind(F.col("v")).alias("k")).collect()
    assert [r.k for r in kinds] == ["good", "neutral", "risk", "ai"]
    with pytest.raises(ValueError):
        views.comparison(spark.range(1).withColumnRenamed("id", "listing_id"), [1])


def test_priors(spark):
    df = spark.createDataFrame([(1, "602", "panel", 55.0, 3), (2, None, None, None, None)], "listing_id long, series string, building_type string, area_m2 double, declared_rooms int")
    got = star.prior_matches(df).orderBy("listing_id", "position").collect()
    assert got[0].prior == "602" and {r.listing_id for r in got} == {1} and len(got) == 6
