"""Flags, badges, texts and side-by-side comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions.nulls import HIGH_RISK, compact, flag

#: Labels by kind of chip; others are neutral.
CHIPS = {
    "risk": ("Room conflict", "High mortgage risk", "Stove heating", "Stove heating risk", "Wooden building risk", "Suspiciously low price - check carefully"),
    "good": ("Good price", "Layout confirmed", "Layout confirmed by floor plan", "Strong transport"),
    "ai": ("Floor plan", "Kitchen-living", "Layout unclear"),
}
SUSPICIOUS = "Suspiciously low price - check carefully"


def chip_kind(label: Column) -> Column:
    found = F.when(F.lit(False), "")
    for kind, labels in CHIPS.items():
        found = found.when(label.isin(*labels), kind)
    return found.otherwise("neutral")


def _risky() -> Column:
    return F.col("risk").isin(*HIGH_RISK)


def key_flags() -> Column:
    """The short flags of a row in a ranked view, in fixed order."""
    c = F.col
    return compact(
        flag(c("is_favorite"), "Favorite"), flag(c("has_notes"), "Note"), flag(c("room_conflict"), "Room conflict"), flag(c("layout_label") == "Confirmed", "Layout confirmed"),
        flag(c("has_floor_plan"), "Floor plan"), flag(c("kitchen_living"), "Kitchen-living"), flag(c("price_value_score") >= 80, "Good price"), flag(c("suspicious"), SUSPICIOUS),
        flag(_risky(), "High mortgage risk"), flag(c("stove"), "Stove heating"), flag(c("wooden"), "Wooden building"),
    )


def detail_flags() -> Column:
    """The flags of a listing's own page; one that says so if there is none."""
    c = F.col
    confirmed = c("layout_label") == "Confirmed"
    both = c("declared_rooms").isNotNull() & c("private_rooms").isNotNull()
    rooms = F.when(both, F.concat(F.lit("AI: "), text.rooms_label("private_rooms", "kitchen_living"), F.lit(" / SS: "), c("declared_rooms").cast("string")))
    found = compact(
        flag(c("is_favorite"), "Favorite"), flag(c("is_rejected"), "Rejected"), flag(c("status") == "inactive", "Inactive"), flag(c("room_conflict"), "Room conflict"),
        flag(c("layout_label") == "Unclear", "Layout unclear"),
        F.when(F.coalesce(c("has_floor_plan"), F.lit(False)), F.when(F.coalesce(confirmed, F.lit(False)), "Layout confirmed by floor plan").otherwise("Floor plan")),
        flag(c("kitchen_living"), "Kitchen-living is not counted as private room"), flag(_risky(), "High mortgage risk"), flag(c("stove"), "Stove heating risk"),
        flag(c("wooden"), "Wooden building risk"), flag(c("suspicious"), SUSPICIOUS), rooms,
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("No major flags")))


def comparison_flags() -> Column:
    """Flags of a compared listing; the room conflict is told by the counts themselves."""
    c = F.col
    return compact(flag(c("is_favorite"), "Favorite"), flag(c("private_rooms") != c("declared_rooms"), "Room conflict"), flag(c("kitchen_living"), "Kitchen-living"), flag(_risky(), "High mortgage risk"))


def badges() -> Column:
    c = F.col
    return compact(
        flag(c("price_value_score") >= 80, "Good price"), flag(c("transport_score") >= 70, "Strong transport"), flag(c("layout_label") == "Confirmed", "Layout confirmed"),
        flag(c("is_favorite"), "Favorite"), flag(c("room_conflict"), "Room conflict"), flag(_risky(), "High mortgage risk"),
    )


TITLE = {"district": "district", "street": "street", "private_rooms": "private_rooms", "declared_rooms": "declared_rooms", "kitchen_living": "kitchen_living", "area": "area_m2", "price": "price_eur"}


def titles(df: DataFrame) -> DataFrame:
    return df.select("listing_id", text.title(TITLE).alias("title"))


def chips(labels: Column) -> Column:
    """array<struct<label, type>>."""
    return F.transform(labels, lambda x: F.struct(x.alias("label"), chip_kind(x).alias("type")))


def rooms_type() -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes("room_conflict"), "mismatch").when(yes("kitchen_living") | F.col("private_rooms").isNull(), "neutral").otherwise("ai")


def mortgage() -> Column:
    """struct(level, type) of a listing's mortgage risk."""
    kind = F.when(F.col("risk") == "Low", "risk-low").when(F.col("risk") == "Medium", "risk-medium").when(_risky(), "risk-high").otherwise("neutral")
    return F.struct(F.coalesce("risk", F.lit("Unknown")).alias("level"), F.coalesce(kind, F.lit("neutral")).alias("type"))


def location_value() -> Column:
    """Mean of the location scores there are, as a whole number."""
    parts = F.filter(F.array("rtu_score", "transport_score", "station_score", "shop_score"), lambda x: x.isNotNull())
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(parts) > 0, F.round(total / F.size(parts)).cast("int"))


def ranking_rows(ranked: DataFrame) -> DataFrame:
    """Rows of a ranked view: texts beside raw values, buckets and chips."""
    return ranked.select(
        "position", "listing_id", F.round("score").cast("int").alias("score"), geo.score_bucket("score").alias("bucket"), F.coalesce("district", F.lit("Unknown district")).alias("district"),
        F.coalesce("street", F.lit("Unknown street")).alias("address"), text.short_rooms("private_rooms", "kitchen_living").alias("ai_rooms"), rooms_type().alias("rooms_type"),
        text.or_unknown("declared_rooms", text.DASH).alias("ss_rooms"), text.area("area_m2", text.DASH, " m²").alias("area"), text.money("price_eur", text.DASH, " €").alias("price"),
        chips(key_flags()).alias("flags"),
    )


def _number(digits: int, c: str, tail: str = "") -> Column:
    return F.when(F.col(c).isNull(), F.lit("unknown")).otherwise(F.concat(text.fixed(c, digits), F.lit(tail)))


#: Attribute rows of a comparison, in order.
COMPARED = (
    ("Price", lambda: text.money("price_eur")),
    ("EUR/m2", lambda: F.coalesce(F.concat(F.replace(F.format_number("ppm2", 2), F.lit(","), F.lit(" ")), F.lit(" EUR/m2")), F.lit("unknown"))),
    ("Area", lambda: text.area("area_m2")),
    ("Effective private rooms", lambda: text.or_unknown("private_rooms")),
    ("SS-declared rooms", lambda: text.or_unknown("declared_rooms")),
    ("Layout confidence", lambda: text.or_unknown("layout_label")),
    ("Mortgage risk", lambda: text.or_unknown("risk")),
    ("RTU distance", lambda: _number(0, "rtu_distance", " m")),
    ("Transport score", lambda: _number(1, "transport_score")),
    ("Central station distance", lambda: _number(0, "station_distance", " m")),
    ("Shops within 1200 m", lambda: text.or_unknown("shops_1200")),
    ("Building / series", lambda: F.coalesce(F.nullif("series", F.lit("")), F.nullif("building_type", F.lit("")), F.lit("unknown"))),
    ("Score", lambda: _number(1, "score")),
    ("Flags", lambda: F.when(F.size(comparison_flags()) > 0, F.array_join(comparison_flags(), ", ")).otherwise("none")),
)


def comparison(df: DataFrame, ids: list[int]) -> DataFrame:
    """Attributes as rows, 2 to 5 listings as columns l1, l2, ... in the order asked for."""
    if not 2 <= len(ids) <= 5:
        raise ValueError("2 to 5 listings can be compared")
    rows = df.where(F.col("listing_id").isin(*ids))
    cells = F.array(*(F.struct(F.lit(i).alias("row"), F.lit(n).alias("label"), v().alias("value")) for i, (n, v) in enumerate(COMPARED)))
    long = rows.select("listing_id", F.explode(cells).alias("x")).select("listing_id", "x.*")
    wide = long.groupBy("row", "label").agg(*(F.max(F.when(F.col("listing_id") == k, F.col("value"))).alias(f"l{i}") for i, k in enumerate(ids, 1)))
    return wide


def top_blocks(scored: DataFrame, n: int = 5) -> DataFrame:
    """(listing_id, place, block, value): the n blocks farthest from 50, ties by the block's key."""
    own = sorted(c for c in scored.columns if c.startswith("b_"))
    value = lambda c: F.round(c).cast("int")
    cells = F.filter(F.array(*(F.struct((-F.abs(value(c) - 50)).alias("o"), F.lit(c[2:]).alias("block"), value(c).alias("value")) for c in own)), lambda x: x["value"].isNotNull())
    rows = scored.select("listing_id", F.posexplode(F.slice(F.array_sort(cells), 1, n)).alias("place", "x"))
    return rows.select("listing_id", (F.col("place") + 1).alias("place"), "x.block", "x.value")


def top_lines() -> Column:
    c = F.col
    said = lambda name, v: F.concat(F.lit(f"{name}: "), v)
    per = F.coalesce(F.concat(F.replace(F.format_number("ppm2", 2), F.lit(","), F.lit(" ")), F.lit(" EUR/m2")), F.lit("unknown"))
    return F.array(said("Price", text.money("price_eur")), said("Area", text.area("area_m2")), said("Price per m2", per), said("District", F.coalesce(c("district"), F.lit("unknown"))), said("Street", F.coalesce(c("street"), F.lit("unknown"))), said("Building series", F.coalesce(c("series"), F.lit("unknown"))))


def history_lines(trend: DataFrame) -> DataFrame:
    sign = F.when(F.col("latest") < F.col("oldest"), "-").otherwise("+")  # a change that rounds to 0 keeps its sign
    return trend.select("listing_id", F.concat(sign, F.abs("change").cast("string"), F.lit("%")).alias("text"), "kind")
