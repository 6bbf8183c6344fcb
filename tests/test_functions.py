"""Column functions against plain Python, at every boundary."""

import math

import pytest
from pyspark.sql import functions as F

from homeledger.functions import geo, nulls, scores, text


def one(spark, column, **values):
    kinds = {int: "bigint", float: "double", str: "string", bool: "boolean"}
    row = spark.createDataFrame([tuple(v for v, _ in values.values())], ", ".join(f"{k} {t}" for k, (_, t) in values.items())) if values else spark.range(1)
    del kinds
    return row.select(column.alias("x")).first().x


def column(spark, c, values, kind):
    return [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(c.alias("x")).collect()]


def test_market_score(spark):
    ratios = [0.5, 0.75, 0.7501, 0.9, 0.91, 1.0, 1.01, 1.15, 1.16, 1.35, 1.36]
    got = column(spark, scores.market_score("v", F.lit(1.0)), ratios, "double")
    assert got == [95, 95, 80, 80, 65, 65, 50, 50, 30, 30, 10]
    assert one(spark, scores.market_score(F.lit(3.0), F.lit(0.0))) == 50 and one(spark, scores.market_score(F.lit(None).cast("double"), F.lit(1.0))) is None


def test_block_scores(spark):
    assert column(spark, scores.room_privacy("v"), [None, -1, 0, 1, 2, 3], "int") == [45, 0, 0, 45, 100, 85]
    assert column(spark, scores.layout_confidence("v"), ["Confirmed", "Likely", "Unclear", "Conflict", "x", None], "string") == [100, 80, 45, 35, None, None]
    assert column(spark, scores.mortgage_suitability("v"), ["Low", "Medium", "High", "Critical", "Unknown", None], "string") == [100, 70, 35, 5, 50, 50]
    assert column(spark, scores.useful_area("v", F.lit(100.0)), [130.0, 105.0, 104.9, 80.0, 60.0, 59.0, 0.0, None], "double") == [95, 80, 65, 65, 45, 25, None, None]
    assert column(spark, scores.building_series("v"), ["602", "", None], "string") == [55, None, None]
    assert one(spark, scores.suspiciously_low(F.lit(64.9), F.lit(100.0), F.lit(5))) and not one(spark, scores.suspiciously_low(F.lit(64.9), F.lit(100.0), F.lit(4)))


def test_weighted_mean(spark):
    none = F.lit(None).cast("double")
    assert one(spark, scores.weighted_mean([(F.lit(10.0), 1), (none, 5), (F.lit(20.0), 3)])) == 17.5
    assert one(spark, scores.weighted_mean([(none, 5)])) is None


def test_geo(spark):
    d = one(spark, geo.haversine_m(F.lit(56.9496), F.lit(24.1052), F.lit(56.9496), F.lit(24.1152)))
    assert 500 < d < 700
    assert column(spark, geo.piecewise("v", geo.CAMPUS), [0.0, 1000.0, 1500.0, 2000.0, 10000.0, 20000.0, None], "double") == [100, 100, 90, 80, 0, 0, None]
    assert one(spark, geo.shop_score(F.lit(300.0), F.lit(2), F.lit(4), F.lit(5))) == 100
    assert math.isclose(one(spark, geo.shop_score(F.lit(700.0), F.lit(0), F.lit(1), F.lit(2))), 74)
    assert one(spark, geo.shop_score(F.lit(None).cast("double"), F.lit(0), F.lit(0), F.lit(0))) is None
    assert one(spark, geo.transport_score(F.lit(500.0), F.lit(9))) == 93
    rows = [("D", "S", "1"), ("D", "S", ""), ("D", None, "1"), (None, "", None)]
    got = spark.createDataFrame(rows, "d string, s string, h string").select(geo.address_precision("d", "s", "h").alias("p")).collect()
    assert [r.p for r in got] == list(geo.PRECISIONS)
    assert column(spark, geo.score_bucket("v"), [80.0, 79.9, 60.0, 40.0, 39.0, None], "double") == ["high", "medium", "medium", "low", "very_low", "unknown"]


@pytest.mark.parametrize(("value", "want"), [("44.5 m2", 445), ("1 200 €", 1200), ("none", None), (None, None), ("", None), ("3/5", 3)])
def test_parse_int(spark, value, want):
    assert one(spark, text.parse_int("v"), v=(value, "string")) == want


def test_parsers(spark):
    assert column(spark, text.parse_float("v"), ["44,5 m2", "1 200.25", "x", None], "string") == [44.5, 1200.25, None, None]
    assert column(spark, text.price_eur("v"), ["128 000 € (2 909.09 €/m²)", "none"], "string") == [128000, None]
    assert column(spark, text.price_per_m2("v"), ["128 000 € (2 909.09 €/m²)", "128 000 €"], "string") == [2909.09, None]
    assert [tuple(x) for x in column(spark, text.floors("v"), ["1/5/lift", "4", "x"], "string")] == [(1, 5), (4, None), (None, None)]
    assert [tuple(x) for x in column(spark, text.address_parts("v"), ["Stabu iela 87 [Karte]", "Ģertrūdes iela", "Brīvības 1a-2", " ", None], "string")] == [("Stabu iela", "87"), ("Ģertrūdes iela", None), ("Brīvības", "1a-2"), (None, None), (None, None)]
    assert column(spark, text.clean_text("v"), ["a\xa0 b &amp; c\n   d ", " \n ", None], "string") == ["a b & c\nd", None, None]
    assert column(spark, text.page_number("v"), ["/x/page12.html", "/x/", None], "string") == [12, 1, 1]
    assert column(spark, text.profile_slug("v"), ["My Best Picks!", "--", "ātri 2"], "string") == ["custom_my_best_picks", "custom_profile", "custom_ātri_2"]


def test_formats(spark):
    assert column(spark, text.money("v"), [110000, 999, None], "bigint") == ["110 000 EUR", "999 EUR", "unknown"]
    assert column(spark, text.area("v"), [44.0, 44.5, None], "double") == ["44 m2", "44.5 m2", "unknown"]
    assert column(spark, text.distance("v"), [999.4, 1000.0, 1540.0, None], "double") == ["999 m", "1.0 km", "1.5 km", "—"]
    assert column(spark, text.compact_number("v"), [12300.0, 950.0], "double") == ["12.3k", "950"]


def test_null_rules(spark):
    assert column(spark, nulls.keep_unless(F.col("v")), [True, False, None], "boolean") == [False, True, True]
    assert column(spark, nulls.require(F.col("v")), [True, False, None], "boolean") == [True, False, False]
    assert column(spark, nulls.enum("v", nulls.RISK_LEVELS), ["Low", "low", None], "string") == ["Low", None, None]
    assert column(spark, nulls.ratio("v", F.lit(2)), [3, None], "int") == [1.5, None] and one(spark, nulls.ratio(F.lit(1), F.lit(0))) is None
