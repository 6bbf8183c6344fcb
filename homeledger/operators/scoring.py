"""Block scores, profiles and weighted overall scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.text import profile_slug
from . import market
from .order_stats import order_statistics

#: Blocks and importance levels.
BLOCKS = (
    "price_value", "useful_area", "room_privacy", "layout_confidence", "mortgage_suitability", "rtu_accessibility", "transport_connectivity",
    "central_station_accessibility", "shops_infrastructure", "building_series", "floor", "condition",
)
IMPORTANCE = {"Ignore": 0, "Weak": 1, "Medium": 2, "Strong": 3, "Critical": 5}
#: Weights of the built-in profiles in the order of BLOCKS.
PROFILES = {
    "for_living_mortgage": (5, 1, 3, 1, 3, 2, 2, 1, 1, 1, 0, 0),
    "mortgage_first": (3, 1, 2, 1, 5, 0, 0, 0, 0, 2, 0, 0),
    "maximum_opportunity": (5, 2, 2, 0, 1, 1, 1, 0, 0, 0, 0, 0),
    "only_two_private_rooms": (3, 1, 5, 2, 2, 0, 0, 0, 0, 0, 0, 0),
    "best_price": (5, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0),
    "best_transport": (2, 0, 0, 0, 0, 2, 5, 3, 2, 0, 0, 0),
    "closer_to_rtu": (2, 0, 2, 0, 0, 5, 2, 0, 0, 0, 0, 0),
    "cash_purchase": (5, 2, 3, 1, 0, 2, 2, 0, 0, 0, 0, 0),
    "investment_option": (5, 0, 2, 0, 1, 0, 3, 3, 2, 0, 0, 0),
}
DEFAULT_PROFILE = "for_living_mortgage"
NO_BLOCKS = "No enabled scoring blocks have values."


def profile_weights(spark: SparkSession) -> DataFrame:
    """(profile_key, block_key, weight) of the built-in profiles."""
    rows = [(p, b, w) for p, ws in PROFILES.items() for b, w in zip(BLOCKS, ws, strict=True)]
    return spark.createDataFrame(rows, "profile_key string, block_key string, weight int")


def custom_weights(raw: DataFrame) -> DataFrame:
    """(profile_key, block_key, importance, weight) from (name, importance map); what is unknown is ignored."""
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in IMPORTANCE.items() for x in kv)), F.coalesce("given", F.lit("Ignore")))
    rows = raw.select(profile_slug("name").alias("profile_key"), "importance", F.explode(F.array(*map(F.lit, BLOCKS))).alias("block_key"))
    rows = rows.withColumn("given", F.col("importance")[F.col("block_key")])
    rows = rows.withColumn("given", F.when(F.col("given").isin(*IMPORTANCE), F.col("given")))
    return rows.select("profile_key", "block_key", F.coalesce("given", F.lit("Ignore")).alias("importance"), weight.alias("weight"))


def median_area(listings: DataFrame) -> float | None:
    """Exact median of positive areas of active listings, from the order statistics in the middle."""
    rows = listings.where("status = 'active' AND area_m2 > 0")
    n = rows.count()
    ranks = sorted({(n + 1) // 2, n // 2 + 1})
    found = order_statistics(rows, F.col("area_m2"), ranks, n) if n else {}
    return sum(found[k] for k in ranks) / len(ranks) if found else None


def block_columns(area: float | None) -> dict[str, Column]:
    """Score of each block that is produced, from priced listings."""
    return {
        "price_value": F.col("price_value_score"),
        "room_privacy": scores.room_privacy("private_rooms"),
        "layout_confidence": scores.layout_confidence("layout_label"),
        "mortgage_suitability": scores.mortgage_suitability("risk"),
        "rtu_accessibility": F.col("rtu_score"),
        "transport_connectivity": F.col("transport_score"),
        "central_station_accessibility": F.col("station_score"),
        "shops_infrastructure": F.col("shop_score"),
        "useful_area": scores.useful_area("area_m2", F.lit(area).cast("double")),
        "building_series": scores.building_series("series"),
    }


def with_blocks(listings: DataFrame) -> DataFrame:
    """Active listings with their price value and a column b_<block> for each block."""
    active = listings.where("status = 'active'")
    rows = market.price_value(active)
    return rows.select("*", *(c.cast("double").alias(f"b_{b}") for b, c in block_columns(median_area(listings)).items()))


def blocks_long(scored: DataFrame) -> DataFrame:
    """(listing_id, block_key, score): one row a listing and block."""
    own = [c for c in scored.columns if c.startswith("b_")]
    rows = scored.select("listing_id", F.explode(F.array(*(F.struct(F.lit(c[2:]).alias("block_key"), F.col(c).alias("score")) for c in own))).alias("x"))
    return rows.select("listing_id", "x.block_key", "x.score")


def cents(c: Column) -> Column:
    """Rounded to cents, halves up; the margin keeps halves from hanging on the order of summation."""
    return F.floor(c * 100 + 0.500001) / 100.0


def overall(weights: dict[str, int], penalties: float = 0.0, prefix: str = "b_") -> Column:
    """Weighted mean of clamped block scores less penalties, at least 0, rounded to cents; null without any."""
    used = {b: w for b, w in weights.items() if w > 0}
    clamp = lambda b: F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col(prefix + b)))
    parts = [(F.when(F.col(prefix + b).isNotNull(), clamp(b)), w) for b, w in used.items()]
    mean = scores.weighted_mean(parts) if parts else F.lit(None).cast("double")
    return cents(F.when(mean.isNotNull(), F.greatest(F.lit(0.0), mean - max(0.0, penalties))))


def _weights(profile: str) -> dict[str, int]:
    made = ("floor", "condition")
    return {b: w for b, w in zip(BLOCKS, PROFILES[profile], strict=True) if b not in made}


def score(listings: DataFrame, profile: str = DEFAULT_PROFILE) -> DataFrame:
    """Blocks and the overall score by one profile: row-local, without another shuffle."""
    return with_blocks(listings).withColumn("score", overall(_weights(profile)))


def scores_by_profile(listings: DataFrame) -> DataFrame:
    """(listing_id, profile_key, score) for every built-in profile."""
    rows = with_blocks(listings)
    each = F.array(*(F.struct(F.lit(p).alias("profile_key"), overall(_weights(p)).alias("score")) for p in PROFILES))
    return rows.select("listing_id", F.explode(each).alias("x")).select("listing_id", "x.profile_key", "x.score")


def scores_by_weights(long: DataFrame, weights: DataFrame) -> DataFrame:
    """The same for any table of weights (profile_key, block_key, weight); it is small beside the listings."""
    used = weights.where("weight > 0")
    clamped = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("score")))
    parts = long.where("score IS NOT NULL").join(used, "block_key").groupBy("listing_id", "profile_key")
    found = parts.agg(cents(F.greatest(F.lit(0.0), F.sum(clamped * F.col("weight")) / F.sum("weight"))).alias("score"), F.sum("weight").alias("weight"))
    return found.withColumn("explanation", F.format_string("Weighted score calculated from %d total profile weight.", "weight"))


def breakdown_json(scored: DataFrame, profile: str = DEFAULT_PROFILE) -> DataFrame:
    """(listing_id, breakdown): a JSON object of block -> score, if there is one, and the profile's weight; keys in order."""
    weights = _weights(profile)
    own = sorted(c for c in scored.columns if c.startswith("b_") and c[2:] in weights)
    pairs = F.map_from_arrays(F.array(*(F.lit(c[2:]) for c in own)), F.array(*(F.struct(F.col(c).alias("score"), F.lit(weights[c[2:]]).alias("weight")) for c in own)))
    return scored.select("listing_id", F.to_json(pairs).alias("breakdown"))
