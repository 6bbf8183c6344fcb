"""Read models: listings with their latest analysis, user state, location and scores; pending work; existence tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nulls


def latest_analysis(analyses: DataFrame) -> DataFrame:
    """One row a listing: the finished analysis of the highest version, by one partial aggregate."""
    rest = [c for c in analyses.columns if c != "listing_id"]
    done = analyses.where("state = 'finished'").groupBy("listing_id").agg(F.max_by(F.struct(*rest), "version").alias("x"))
    return done.select("listing_id", *(f"x.{c}" for c in rest))


def candidate_star(listings: DataFrame, states: DataFrame, analyses: DataFrame, scores: DataFrame | None = None, profile: str | None = None) -> DataFrame:
    """Listings left-joined to user state (with defaults), latest analysis and the scores of one profile.

    The profile is a condition on the scores, not on the result: listings without a score stay.
    """
    latest = latest_analysis(analyses).select("listing_id", "version", "explanation")
    state = states.select("listing_id", *(F.col(c).alias(f"s_{c}") for c in ("is_favorite", "is_rejected", "is_viewed")), F.lit(True).alias("s_known"))
    rows = listings.join(state, "listing_id", "left").join(latest, "listing_id", "left")
    flags = [F.coalesce(f"s_{c}", F.lit(False)).alias(c) for c in ("is_favorite", "is_rejected", "is_viewed")]
    status = F.when(F.coalesce("s_is_rejected", F.lit(False)), "rejected").when(F.coalesce("s_is_favorite", F.lit(False)), "favorite").when(F.coalesce("s_is_viewed", F.lit(False)), "viewed").otherwise("unseen")
    out = rows.select(*listings.columns, *flags, F.when(F.col("s_known"), status).otherwise("unseen").alias("user_status"), F.col("version").alias("analysis_version"), "explanation")
    if scores is None:
        return out
    own = scores.where(F.col("profile_key") == profile).select("listing_id", "score")
    return out.join(own, "listing_id", "left")


def pending(listings: DataFrame, analyses: DataFrame, forced: bool = False) -> DataFrame:
    """Listings to analyse: forced, marked, or without any finished analysis."""
    done = analyses.where("state = 'finished'").select("listing_id").distinct().withColumn("done", F.lit(True))
    rows = listings.join(done, "listing_id", "left")
    return rows.where(F.lit(forced) | nulls.require(F.col("needs_ai")) | F.col("done").isNull()).drop("done")


def with_flag(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """left with whether right has its key: an existence test as a column."""
    marks = right.select(key).distinct().withColumn(name, F.lit(True))
    return left.join(marks, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def first_by(df: DataFrame, key: str, value: str, order: str, name: str) -> DataFrame:
    """(key, name): the value of the first row by order, one partial aggregate a key."""
    return df.groupBy(key).agg(F.min_by(value, order).alias(name))


def without_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def ungeocoded(listings: DataFrame, located: DataFrame, n: int | None = None) -> DataFrame:
    """Listings with a district or street that were never located, by id."""
    known = nulls.filled("district").isNotNull() | nulls.filled("street").isNotNull()
    rows = without_match(listings.where(known), located, "listing_id").orderBy("listing_id")
    return rows if n is None else rows.limit(n)


def merged_listing(summary: DataFrame, detail: DataFrame, key: str = "ss_id", text: tuple[str, ...] = (), plain: tuple[str, ...] = ()) -> DataFrame:
    """Summaries with what the detail page says better: `text` columns if not empty, `plain` ones if not null."""
    own = detail.select(key, *(F.col(c).alias(f"d_{c}") for c in (*text, *plain)))
    rows = summary.join(own, key, "left")
    for c in text:
        rows = rows.withColumn(c, F.coalesce(nulls.filled(f"d_{c}"), nulls.filled(c)))
    for c in plain:
        rows = rows.withColumn(c, F.coalesce(f"d_{c}", c))
    return rows.drop(*(f"d_{c}" for c in (*text, *plain)))


def positional_join(df: DataFrame, *arrays: str) -> DataFrame:
    """Rows of arrays side by side; unequal lengths are an error, as a column."""
    same = F.lit(True)
    for a in arrays[1:]:
        same = same & (F.size(a) == F.size(arrays[0]))
    return df.withColumn("pairs", F.when(same, F.arrays_zip(*arrays))).withColumn("error", F.when(~F.coalesce(same, F.lit(False)), "lengths differ"))


def checked_ids(df: DataFrame, expected: str, classified: str, referenced: str) -> DataFrame:
    """Why an analysis does not fit its listing's images; null if it does."""
    once = (F.size(classified) == F.size(expected)) & (F.size(F.array_except(classified, expected)) == 0) & (F.size(F.array_except(expected, classified)) == 0)
    unknown = F.array_sort(F.array_except(referenced, expected))
    error = F.when(~F.coalesce(once, F.lit(False)), "Pass 1 must classify every listing image exactly once.")
    error = error.when(F.size(unknown) > 0, F.concat(F.lit("AI output references unknown floor plan image IDs: "), F.array_join(unknown, ", ")))
    return df.withColumn("error", error)


#: Bundled layout priors (series, building type, period, area from and to, rooms, walkthrough, isolated, confidence).
PRIORS = (
    ("467", "panel", "1960s-70s", 30.0, 48.0, 2, 0.70, 0.30, "medium"),
    ("602", "panel", "1980s", 45.0, 65.0, 3, 0.20, 0.80, "medium"),
    ("119", "panel", "1980s", 50.0, 70.0, 3, 0.25, 0.75, "medium"),
    ("103", "panel", "1970s-80s", 40.0, 60.0, 2, 0.30, 0.70, "medium"),
    ("lt", "panel", "1970s-80s", 45.0, 70.0, 3, 0.25, 0.75, "medium"),
    ("stalinka", "brick", "1940s-50s", 45.0, 90.0, 3, 0.40, 0.60, "low"),
    ("pre-war", "wooden", "pre-1940", 30.0, 80.0, 2, 0.60, 0.40, "low"),
    ("new project", "monolith", "2000s-", 40.0, 120.0, 3, 0.10, 0.90, "medium"),
)


def area_range(low: str, high: str):
    """"30-48", "from 30" or "up to 48"; null without either."""
    whole = lambda c: F.round(c).cast("long").cast("string")
    both = F.concat_ws("-", whole(low), whole(high))
    return F.when(F.col(low).isNull() & F.col(high).isNull(), None).when(F.col(low).isNull(), F.concat(F.lit("up to "), whole(high))).when(F.col(high).isNull(), F.concat(F.lit("from "), whole(low))).otherwise(both)


def prior_prompts(spark: SparkSession) -> DataFrame:
    """The bundled priors as a provider is told of them: hypotheses that evidence overrides."""
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(PRIORS)], "prior int, series string, building_type string, construction_period string, low double, high double, typical_room_count int, walkthrough_probability double, isolated_rooms_probability double, confidence string")
    note = F.lit("Hypothesis only. Real listing evidence overrides this prior.")  # fixed value
    return rows.withColumn("typical_area_range_m2", area_range("low", "high")).withColumn("note", note).drop("low", "high")


def prior_matches(listings: DataFrame, most: int = 6, series: str = "series", building: str = "building_type", area: str = "area_m2", rooms: str = "declared_rooms") -> DataFrame:
    """(listing_id, position, series, relevance): the most relevant priors of each listing.

    The priors are eight constants, so each listing scores them in an array of its own: no join and no shuffle.
    """
    norm = lambda c: F.lower(F.trim(c))
    each = []
    for i, (s, b, _, low, high, n, *_rest) in enumerate(PRIORS):
        own, own_b = norm(F.col(series)), norm(F.col(building))
        alike = F.col(series).isNotNull() & (F.col(series) != "") & (F.contains(F.lit(s), own) | F.contains(own, F.lit(s)))
        built = F.col(building).isNotNull() & (F.col(building) != "") & F.contains(F.lit(b), own_b)
        points = F.when(nulls.require(alike), 5).otherwise(0) + F.when(nulls.require(built), 3).otherwise(0)
        points = points + F.when(nulls.require(F.col(rooms) == n), 2).otherwise(0) + F.when(nulls.require(F.col(area).between(low, high)), 2).otherwise(0)
        each.append(F.struct((-points).alias("order"), F.lit(i).alias("prior"), F.lit(s).alias("name")))
    best = F.slice(F.array_sort(F.filter(F.array(*each), lambda x: x["order"] < 0)), 1, most)
    rows = listings.select("listing_id", F.posexplode(best).alias("i", "x"))
    return rows.select("listing_id", (F.col("i") + 1).alias("position"), F.col("x.name").alias("prior"), (-F.col("x.order")).alias("relevance"))
