"""Snapshots against stored state: upserts with partial payloads, change events, missing listings, user states.

Tables have no MERGE here, so a step is one full outer join that yields the new state and the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of event types within one step.
EVENTS = ("description_changed", "image_count_changed", "price_changed", "unique_visits_changed")
#: Kept from the stored row when a payload has no detail page; all other columns are overwritten, even with null.
DETAIL_COLUMNS = ("description", "images", "visits")


def _event(when: Column, kind: str, old: Column, new: Column, delta: Column | None = None) -> Column:
    return F.when(
        F.coalesce(when, F.lit(False)),
        F.struct(F.lit(kind).alias("event_type"), old.cast("string").alias("old_value"), new.cast("string").alias("new_value"), (delta if delta is not None else F.lit(None)).cast("string").alias("delta_value")),
    )


def events(old: str = "o", new: str = "n") -> Column:
    """Array of change events between a stored row and a payload, in order of type.

    Prices always count (null is a value), visits only if the payload has them, texts and images only with a
    detail page.
    """
    o, n = (lambda c: F.col(f"{old}.{c}")), (lambda c: F.col(f"{new}.{c}"))
    differ = lambda c: ~o(c).eqNullSafe(n(c))
    detail = n("has_detail")
    hashed = lambda c: F.sha2(c, 256)
    return F.array_compact(F.array(
        _event(detail & differ("description"), "description_changed", hashed(o("description")), hashed(n("description"))),
        _event(detail & differ("images"), "image_count_changed", o("images"), F.coalesce(n("images"), F.lit(0))),
        _event(differ("price_eur"), "price_changed", o("price_eur"), n("price_eur"), n("price_eur") - o("price_eur")),
        _event(n("visits").isNotNull() & differ("visits"), "unique_visits_changed", o("visits"), n("visits"), n("visits") - o("visits")),
    ))


def history_events(snapshots: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Events between each snapshot and the one before it, by listing, time and, at equal times, id."""
    before = Window.partitionBy("listing_id").orderBy("checked_at", "event_id")
    now = F.struct("price_eur", "visits", "description", "images", "has_detail")
    rows = snapshots.select("listing_id", "checked_at", "event_id", now.alias("n")).withColumn("o", F.lag("n").over(before))
    rows = rows.where("o IS NOT NULL").select("listing_id", "checked_at", *keep, F.explode(events()).alias("e"))
    return rows.select("listing_id", "checked_at", *keep, "e.*")


def split_at(snapshots: DataFrame, cut) -> tuple[DataFrame, DataFrame]:
    """(stored, incoming): the last row of each listing before the cut, and its first one from then on."""
    rest = [c for c in snapshots.columns if c != "listing_id"]
    pick = lambda df, by: df.groupBy("listing_id").agg(by(F.struct(*rest), "checked_at").alias("x")).select("listing_id", *(f"x.{c}" for c in rest))
    before = F.col("checked_at") < F.lit(cut)
    return pick(snapshots.where(before), F.max_by), pick(snapshots.where(~before), F.min_by)


def upsert(stored: DataFrame, incoming: DataFrame, columns: tuple[str, ...] = ("price_eur", "visits", "description", "images"), full: bool = True) -> DataFrame:
    """New state: outcome (new, changed, unchanged, missing), the columns, status, needs_ai and event types.

    Without a detail page the stored DETAIL_COLUMNS stay; everything else is overwritten. A listing that is
    not in the payloads is missing: inactive, its columns as they were. New listings have no events. A mark that an
    analysis is needed stays until one is saved. A listing that was inactive and comes again is `reactivated`; this is
    no change by itself (reactivations() has its event). Where the payloads are no full crawl, missing listings keep their status.
    """
    marks = {"status": F.lit("active"), "needs_ai": F.lit(False)}
    o = stored.select("listing_id", F.struct(*columns, *(F.col(c) if c in stored.columns else v.alias(c) for c, v in marks.items())).alias("o"))
    n = incoming.select("listing_id", F.struct(*columns, "has_detail").alias("n"))
    rows = o.join(n, "listing_id", "full")
    rows = rows.withColumn("events", F.when(F.col("o").isNotNull() & F.col("n").isNotNull(), F.transform(events(), lambda e: e["event_type"])).otherwise(F.array().cast("array<string>")))
    gone, new = F.col("n").isNull(), F.col("o").isNull()
    out = {}
    for c in columns:
        kept = F.when(F.col("n.has_detail") | new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in DETAIL_COLUMNS else F.col(f"n.{c}")
        out[c] = F.when(gone, F.col(f"o.{c}")).otherwise(kept)
    outcome = F.when(gone, "missing").when(new, "new").when(F.size("events") > 0, "changed").otherwise("unchanged")
    again = F.coalesce(~gone & (F.col("o.status") == "inactive"), F.lit(False))
    return rows.select(
        "listing_id", outcome.alias("outcome"), *(v.alias(c) for c, v in out.items()), F.when(gone, F.lit("inactive") if full else F.col("o.status")).otherwise("active").alias("status"), again.alias("reactivated"),
        (new | F.coalesce("o.needs_ai", F.lit(False)) | F.array_contains("events", "description_changed") | F.array_contains("events", "image_count_changed")).alias("needs_ai"), "events",
    )


def reactivations(upserted: DataFrame, at) -> DataFrame:
    """(listing_id, event_type, reactivated_at) of listings that came again."""
    return upserted.where("reactivated").select("listing_id", F.lit("listing_reactivated").alias("event_type"), F.lit(at).cast("timestamp").alias("reactivated_at"))


def all_counters(upserted: DataFrame, failed: DataFrame) -> DataFrame:
    """Counters of a run with what was stored, came again, and how many detail pages failed (listing_id, error)."""
    rows = upserted.select("outcome", "reactivated").unionByName(failed.where("error IS NOT NULL").select(F.lit("failed").alias("outcome"), F.lit(False).alias("reactivated")))
    c = lambda *x: F.count_if(F.col("outcome").isin(*x))
    seen = ("new", "changed", "unchanged")
    return rows.agg(c(*seen).alias("seen"), c(*seen).alias("stored"), c("new").alias("new"), c("changed").alias("changed"), c("missing").alias("inactive"), F.count_if("reactivated").alias("reactivated"), c("failed").alias("failed"))


def run_counters(upserted: DataFrame) -> DataFrame:
    """How many listings were seen, new, changed and missing."""
    c = lambda x: F.count_if(F.col("outcome") == x)
    return upserted.agg(F.count_if(F.col("outcome") != "missing").alias("seen"), c("new").alias("new"), c("changed").alias("changed"), c("missing").alias("inactive"))


def missing(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Active listings that a full crawl did not see, as inactive snapshots without a price."""
    rows = stored.join(seen.select("listing_id"), "listing_id", "left_anti")
    return rows.select("listing_id", F.lit(None).cast("long").alias("price_eur"), F.lit(False).alias("is_active"), F.lit("listing_became_inactive").alias("event_type"))


def price_trend(snapshots: DataFrame) -> DataFrame:
    """(listing_id, oldest, latest, change): first and last known price and the change in percent.

    Only where there are two prices, the oldest is positive and they differ.
    """
    known = snapshots.where("price_eur IS NOT NULL").groupBy("listing_id").agg(F.min_by("price_eur", "checked_at").alias("oldest"), F.max_by("price_eur", "checked_at").alias("latest"), F.count("*").alias("n"))
    rows = known.where("n >= 2 AND oldest > 0 AND latest <> oldest")
    return rows.select("listing_id", "oldest", "latest", F.round((F.col("latest") - F.col("oldest")) / F.col("oldest") * 100).cast("long").alias("change"), F.when(F.col("latest") < F.col("oldest"), "good").otherwise("risk").alias("kind"))


def nested_history(snapshots: DataFrame, most: int | None = None) -> DataFrame:
    """(listing_id, n, history): snapshots of a listing as an array, newest first."""
    rows = snapshots.groupBy("listing_id").agg(F.sort_array(F.collect_list(F.struct("checked_at", "event_id", "price_eur")), asc=False).alias("history"))
    history = F.col("history") if most is None else F.slice("history", 1, most)
    return rows.select("listing_id", F.size("history").alias("n"), history.alias("history"))


def user_states(actions: DataFrame) -> DataFrame:
    """State of each listing after its actions in order: (listing_id, is_viewed, is_favorite, is_rejected, user_status).

    actions: (listing_id, at, action, value) with action viewed, favorite or rejected. A viewing changes the
    status only of listings that are neither favorite nor rejected; clearing a mark falls back on the others.
    """
    start = "named_struct('v', false, 'f', false, 'r', false, 's', 'unseen')"
    after = """
      CASE a.action
        WHEN 'viewed' THEN named_struct('v', true, 'f', x.f, 'r', x.r, 's', CASE WHEN x.f OR x.r THEN x.s ELSE 'viewed' END)
        WHEN 'favorite' THEN named_struct('v', x.v, 'f', a.value, 'r', x.r, 's', CASE WHEN a.value THEN 'favorite' WHEN x.r THEN 'rejected' WHEN x.v THEN 'viewed' ELSE 'unseen' END)
        WHEN 'rejected' THEN named_struct('v', x.v, 'f', x.f, 'r', a.value, 's', CASE WHEN a.value THEN 'rejected' WHEN x.f THEN 'favorite' WHEN x.v THEN 'viewed' ELSE 'unseen' END)
        ELSE x END"""
    rows = actions.groupBy("listing_id").agg(F.sort_array(F.collect_list(F.struct("at", "action", "value"))).alias("todo"))
    rows = rows.select("listing_id", F.expr(f"aggregate(todo, {start}, (x, a) -> {after})").alias("x"))
    return rows.select("listing_id", F.col("x.v").alias("is_viewed"), F.col("x.f").alias("is_favorite"), F.col("x.r").alias("is_rejected"), F.col("x.s").alias("user_status"))


def latest_wins(current: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """current with updates laid over it: of the rows of a key the one of the highest order."""
    rest = [c for c in current.columns if c not in keys]
    rows = current.unionByName(updates).groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x"))
    return rows.select(*keys, *(f"x.{c}" for c in rest))


def insert_missing(current: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """current and those rows whose key it does not have."""
    return current.unionByName(rows.join(current.select(key), key, "left_anti").select(*current.columns))
