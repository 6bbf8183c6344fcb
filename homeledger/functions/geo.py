"""Distances, piecewise-linear scores and address precision."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col, filled

EARTH_RADIUS_M = 6_371_000.0
#: Fixed values: (distance in metres, score) of each score's bends.
CAMPUS = ((0, 100), (1000, 100), (2000, 80), (4000, 55), (7000, 25), (10000, 0))
STATION = ((0, 100), (1000, 100), (3000, 80), (6000, 50), (10000, 20), (14000, 0))
SHOP = ((0, 100), (300, 100), (700, 70), (1200, 35), (1800, 0))
STOP = ((0, 100), (250, 100), (500, 75), (900, 40), (1500, 0))
PRECISIONS = ("exact_house", "street_approx", "district_approx", "unknown")


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(col, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def piecewise(c: str | Column, points: tuple[tuple[float, float], ...]) -> Column:
    """Linear between the points, constant beyond the first and the last; null stays null."""
    d = col(c)
    found = F.when(d <= points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in pairwise(points):
        found = found.when(d <= x1, y0 + (y1 - y0) * ((d - x0) / float(x1 - x0)))
    return found.when(d.isNotNull(), F.lit(float(points[-1][1])))


def shop_score(nearest: str, n300: str, n700: str, n1200: str) -> Column:
    extra = col(n300) * 8 + F.greatest(F.lit(0), col(n700) - col(n300)) * 3 + F.greatest(F.lit(0), col(n1200) - col(n700))
    return F.least(F.lit(100.0), piecewise(nearest, SHOP) + F.least(extra, F.lit(20))) + F.when(col(nearest).isNotNull(), 0.0)


def transport_score(nearest: str, n900: str) -> Column:
    return F.least(F.lit(100.0), piecewise(nearest, STOP) + F.least(col(n900) * 3, F.lit(18))) + F.when(col(nearest).isNotNull(), 0.0)


def address_precision(district: str, street: str, house: str) -> Column:
    d, s, h = map(filled, (district, street, house))
    return F.when(s.isNotNull() & h.isNotNull(), PRECISIONS[0]).when(s.isNotNull(), PRECISIONS[1]).when(d.isNotNull(), PRECISIONS[2]).otherwise(PRECISIONS[3])


def scores_enabled(precision: str, confidence: str) -> Column:
    return F.coalesce((col(precision) == PRECISIONS[0]) & (col(confidence) == "high"), F.lit(False))


def disabled_reason(precision: str, confidence: str) -> Column:
    """Why location scores are off; null where they are on."""
    tail = " - location scores not calculated"
    said = F.when(col(precision) == PRECISIONS[1], "Approximate address" + tail).when(col(precision) == PRECISIONS[2], "District-level address" + tail)
    said = said.when(col(precision) == PRECISIONS[3], "Address unknown" + tail).otherwise("Geocode confidence is not high" + tail)
    return F.when(~scores_enabled(precision, confidence), said)


def score_bucket(c: str | Column) -> Column:
    v = col(c)
    return F.when(v.isNull(), "unknown").when(v >= 80, "high").when(v >= 60, "medium").when(v >= 40, "low").otherwise("very_low")


def marker_state(status: str, rejected: str, favorite: str, precision: str) -> Column:
    yes = lambda c: F.coalesce(col(c), F.lit(False))
    return (
        F.when(col(status) == "inactive", "inactive").when(yes(rejected), "rejected").when(yes(favorite), "favorite")
        .when(col(precision) == PRECISIONS[1], "approximate").when(col(precision) == PRECISIONS[2], "district").otherwise("normal")
    )
