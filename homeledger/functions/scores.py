"""Scores of single properties of a listing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col, filled

#: Score by label.
LAYOUT = {"Confirmed": 100.0, "Likely": 80.0, "Unclear": 45.0, "Conflict": 35.0}
MORTGAGE = {"Low": 100.0, "Medium": 70.0, "High": 35.0, "Critical": 5.0, "Unknown": 50.0}
#: Upper bound of price over market, score; lower bound of area over median, score.
MARKET_STEPS = ((0.75, 95.0), (0.9, 80.0), (1.0, 65.0), (1.15, 50.0), (1.35, 30.0))
AREA_STEPS = ((1.3, 95.0), (1.05, 80.0), (0.8, 65.0), (0.6, 45.0))


def by_label(c: str | Column, scores: dict[str, float]) -> Column:
    found = F.lit(None).cast("double")
    for label, score in reversed(scores.items()):
        found = F.when(col(c) == label, score).otherwise(found)
    return found


def market_score(price: str | Column, market: str | Column) -> Column:
    """By price over market price; 50 if that is not positive, null if either is null."""
    q = F.when(col(market) > 0, col(price) / col(market))
    found = F.when(col(price).isNull() | col(market).isNull(), None).when(col(market) <= 0, 50.0)
    for most, score in MARKET_STEPS:
        found = found.when(q <= most, score)
    return found.otherwise(10.0)


def suspiciously_low(price: str | Column, median: str | Column, n: str | Column) -> Column:
    return F.coalesce((col(n) >= 5) & (col(price) < col(median) * 0.65), F.lit(False))


def room_privacy(c: str | Column) -> Column:
    r = col(c)
    return F.when(r.isNull(), 45.0).when(r <= 0, 0.0).when(r == 2, 100.0).when(r < 2, 45.0).otherwise(85.0)


def layout_confidence(c: str | Column) -> Column:
    return by_label(c, LAYOUT)


def mortgage_suitability(c: str | Column) -> Column:
    return F.coalesce(by_label(c, MORTGAGE), F.lit(MORTGAGE["Unknown"]))


def useful_area(area: str | Column, median: str | Column) -> Column:
    q = col(area) / col(median)
    found = F.when(~F.coalesce((col(area) > 0) & (col(median) > 0), F.lit(False)), None)
    for least, score in AREA_STEPS:
        found = found.when(q >= least, score)
    return found.otherwise(25.0)


def building_series(c: str | Column) -> Column:
    return F.when(filled(c).isNotNull(), 55.0)


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Mean of the scores that are not null, by weight."""
    total = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in parts), F.lit(0.0))
    weight = sum((F.when(s.isNotNull(), w).otherwise(0) for s, w in parts), F.lit(0))
    return F.when(weight > 0, total / weight)
