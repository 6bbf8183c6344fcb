"""Changes of stored tables as DataFrame -> DataFrame steps: children, notes, analyses, sessions, profiles, runs, scores.

Plain files have no UPDATE: each step takes the stored table and what is to change, and returns the new table. A step
that touches some keys only joins on these keys; the rest of the table passes through without a shuffle of its own
where the change is small enough for the optimiser to broadcast it. Times are given by the caller, one for a job.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nulls
from . import scoring, star


def now_text(at: datetime | None = None) -> str:
    """UTC time in ISO form to the second: taken once a job and passed on, never once a row."""
    at = datetime.now(timezone.utc) if at is None else at
    return at.replace(microsecond=0).isoformat()


def children_replaced(children: DataFrame, given: DataFrame, key: str = "listing_id") -> DataFrame:
    """All children of the given parents replaced by the given rows; other parents keep theirs.

    A parent that is to lose all its children is given by a row that has only its key.
    """
    rest = [c for c in children.columns if c != key]
    kept = children.join(given.select(key).distinct(), key, "left_anti")
    filled = F.lit(False)
    for c in rest:
        filled = filled | F.col(c).isNotNull()
    return kept.unionByName(given.where(filled).select(*children.columns))


def notes_updated(states: DataFrame, notes: DataFrame) -> DataFrame:
    """States with new notes (listing_id, notes); blank ones become null, states that lack are made."""
    given = notes.select("listing_id", nulls.filled(F.trim("notes")).alias("_notes"), F.lit(True).alias("_given"))
    rows = states.join(given, "listing_id", "full")
    return rows.select(
        "listing_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("is_favorite", "is_rejected", "is_viewed")), F.coalesce("user_status", F.lit("unseen")).alias("user_status"),
        F.when(F.col("_given"), F.col("_notes")).otherwise(F.col("notes")).alias("notes"),
    )


def _status(favorite: Column, rejected: Column, viewed: Column, first: str) -> Column:
    """Status after a mark was set or cleared: the mark itself, else the others."""
    order = (("favorite", favorite), ("rejected", rejected)) if first == "favorite" else (("rejected", rejected), ("favorite", favorite))
    return F.when(order[0][1], order[0][0]).when(order[1][1], order[1][0]).when(viewed, "viewed").otherwise("unseen")


def opened(states: DataFrame, listings: DataFrame) -> DataFrame:
    """States after the details of listings were opened: viewed, unless they are favorites or rejected."""
    rows = states.join(listings.select("listing_id").distinct().withColumn("_open", F.lit(True)), "listing_id", "full")
    fresh = {c: F.coalesce(c, F.lit(False)) for c in ("is_favorite", "is_rejected", "is_viewed", "_open")} | {"user_status": F.coalesce("user_status", F.lit("unseen"))}
    rows = rows.withColumns(fresh).withColumn("_open", F.col("_open") & ~F.col("is_favorite") & ~F.col("is_rejected"))
    return rows.withColumns({"is_viewed": F.col("is_viewed") | F.col("_open"), "user_status": F.when(F.col("_open"), "viewed").otherwise(F.col("user_status"))}).drop("_open")


def toggled(states: DataFrame, listings: DataFrame, mark: str) -> DataFrame:
    """States with a mark (favorite or rejected) of listings negated; states that lack start unseen."""
    rows = states.join(listings.select("listing_id").distinct().withColumn("_own", F.lit(True)), "listing_id", "full")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_favorite", "is_rejected", "is_viewed", "_own")}).withColumn("user_status", F.coalesce("user_status", F.lit("unseen")))
    own = F.col("_own")
    rows = rows.withColumn(f"is_{mark}", F.when(own, ~F.col(f"is_{mark}")).otherwise(F.col(f"is_{mark}")))
    status = _status(F.col("is_favorite"), F.col("is_rejected"), F.col("is_viewed"), mark)
    return rows.withColumn("user_status", F.when(own, status).otherwise(F.col("user_status"))).drop("_own")


def analyses_saved(analyses: DataFrame, finished: DataFrame, failed: DataFrame) -> DataFrame:
    """Stored analyses with finished ones and failures appended; a failure has its message and no values."""
    rows = analyses.unionByName(finished.withColumn("state", F.lit("finished")), allowMissingColumns=True)
    return rows.unionByName(failed.withColumn("state", F.lit("failed")), allowMissingColumns=True)


def marks_cleared(listings: DataFrame, finished: DataFrame) -> DataFrame:
    """Listings without the mark of a needed analysis where one finished; after a failure the mark stays."""
    rows = star.with_flag(listings, finished, "listing_id", "_done")
    return rows.withColumn("needs_ai", F.coalesce("needs_ai", F.lit(False)) & ~F.col("_done")).drop("_done")


def images_classified(images: DataFrame, classified: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """Images with their category; a floor plan stays one.

    classified: (listing_id, image_id as text, category); ids that are no whole numbers, or that belong to another
    listing, change nothing. hashes: (listing_id, image_id, content_hash).
    """
    own = classified.where(F.col("image_id").rlike("^[0-9]+$")).select("listing_id", F.col("image_id").cast("long").alias("image_id"), F.col("category").alias("_category")).dropDuplicates(["listing_id", "image_id"])
    rows = images.join(own, ["listing_id", "image_id"], "left")
    rows = rows.withColumn("category", F.coalesce("_category", "category") if "category" in images.columns else F.col("_category"))
    rows = rows.withColumn("is_floor_plan", F.col("is_floor_plan") | F.coalesce(F.col("_category") == "floor_plan", F.lit(False))).drop("_category")
    if hashes is None:
        return rows
    rows = rows.join(hashes.select("listing_id", "image_id", F.col("content_hash").alias("_hash")).dropDuplicates(["listing_id", "image_id"]), ["listing_id", "image_id"], "left")
    return rows.withColumn("content_hash", F.coalesce("_hash", "content_hash") if "content_hash" in images.columns else F.col("_hash")).drop("_hash")


def sessions_saved(sessions: DataFrame, given: DataFrame) -> DataFrame:
    """Sessions by name: those given overwrite their namesakes, which keep id and creation time; new ones get the next ids.

    given: (session_name, profile_key, filters, sort_mode, hidden, at), one row a name.
    """
    top = sessions.agg(F.max("session_id")).first()[0] or 0
    new = given.join(sessions.select("session_name"), "session_name", "left_anti")
    # ids follow the order of names; a user's own sessions are few
    ranked = new.agg(F.array_sort(F.collect_list(F.struct("session_name", "profile_key", "filters", "sort_mode", "hidden", "at"))).alias("x")).select(F.posexplode("x").alias("i", "x"))
    ranked = ranked.select((F.lit(top) + F.col("i") + 1).alias("session_id"), "x.session_name", "x.profile_key", "x.filters", "x.sort_mode", "x.hidden", F.col("x.at").alias("created_at"), F.col("x.at").alias("updated_at"))
    old = sessions.join(given.select("session_name", *(F.col(c).alias(f"_{c}") for c in ("profile_key", "filters", "sort_mode", "hidden", "at"))), "session_name", "left")
    known = F.col("_at").isNotNull()
    old = old.select("session_id", "session_name", *(F.when(known, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("profile_key", "filters", "sort_mode", "hidden")), "created_at", F.coalesce("_at", "updated_at").alias("updated_at"))
    return old.unionByName(ranked)


def session_order() -> list[Column]:
    """Last changed first, the later id first."""
    return [F.col("updated_at").desc(), F.col("session_id").desc()]


def profile_deleted(profiles: DataFrame, scores: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(profiles, scores) without a profile: built-in ones stay, but the scores of the key go in any case."""
    return profiles.where((F.col("profile_key") != key) | F.col("is_builtin")), scores.where(F.col("profile_key") != key)


def profile_renamed(profiles: DataFrame, key: str, name: str) -> DataFrame:
    """Profiles with another name for a custom one; its key stays."""
    own = (F.col("profile_key") == key) & ~F.col("is_builtin")
    return profiles.withColumn("profile_name", F.when(own, F.lit(name)).otherwise(F.col("profile_name")))


def seeded(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows for a table that is empty; any other is left alone."""
    return rows if table.isEmpty() else table


def run_log(started: DataFrame, ended: DataFrame) -> DataFrame:
    """(run_id, started_at, finished_at, status, error): the start of each run with its end, if it came to one."""
    rows = started.join(ended, "run_id", "left")
    status = F.when(F.col("finished_at").isNull(), "running").when(F.col("error").isNotNull(), "failed").otherwise("finished")
    return rows.select("run_id", "started_at", "finished_at", status.alias("status"), "error")


def scores_replaced(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored scores (listing_id, profile_key, ...) with fresh ones laid over them; others stay, also of listings no longer active."""
    return stored.join(fresh.select("listing_id", "profile_key"), ["listing_id", "profile_key"], "left_anti").unionByName(fresh.select(*stored.columns))


def rescored(listings: DataFrame, changed: DataFrame, profile: str = scoring.DEFAULT_PROFILE) -> DataFrame:
    """(listing_id, profile_key, score) of changed listings against the whole market as it is now."""
    rows = scoring.score(listings, profile).join(changed.select("listing_id").distinct(), "listing_id", "left_semi")
    return rows.select("listing_id", F.lit(profile).alias("profile_key"), "score")
