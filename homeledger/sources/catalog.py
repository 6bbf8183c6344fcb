"""The stored tables with their declared columns and seed rows, and views of all relations for Spark SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import market, profiles, scoring, star
from .bindings import BINDINGS, bind

#: Stored tables by name: their columns. A later version adds columns at the end; older files then lack them and read as null.
TABLES = {
    "listings": "listing_id long, ss_id string, url string, title string, district string, street string, house string, price_eur long, area_m2 double, declared_rooms int, floor int, floors int, series string, building_type string, status string, description string, images long, visits long, needs_ai boolean, first_seen timestamp, last_seen timestamp, updated timestamp",
    "snapshots": "listing_id long, event_id long, checked_at timestamp, price_eur long, visits long, description string, images long, has_detail boolean",
    "change_events": "listing_id long, event_id long, detected_at timestamp, event_type string, old_value string, new_value string, delta_value string",
    "images": "listing_id long, image_id long, source_url string, category string, is_floor_plan boolean, path string, content_hash string",
    "user_states": "listing_id long, is_favorite boolean, is_rejected boolean, is_viewed boolean, user_status string, notes string",
    "scores": "listing_id long, profile_key string, score double, weight long, explanation string, breakdown string",
    "sessions": "session_id long, session_name string, profile_key string, filters string, sort_mode string, hidden string, created_at timestamp, updated_at timestamp",
    "profiles": "profile_key string, profile_name string, base_profile_key string, weights string, is_builtin boolean",
    "layout_priors": "prior int, series string, building_type string, construction_period string, typical_room_count int, walkthrough_probability double, isolated_rooms_probability double, confidence string, typical_area_range_m2 string, note string",
    "runs": "run_id long, started_at timestamp, finished_at timestamp, status string, error string",
}


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table by its declared columns."""
    return spark.read.schema(TABLES[name]).parquet(f"{folder.rstrip('/')}/{name}")


def bootstrap(spark: SparkSession, folder: str) -> list[str]:
    """Makes the tables that are not there yet, with the bundled profiles and priors; tables that are there stay. Returns the new ones."""
    seeds, made = {"profiles": profiles.builtin, "layout_priors": star.prior_prompts}, []
    for name, columns in TABLES.items():
        at = f"{folder.rstrip('/')}/{name}"
        if _exists(spark, at):
            continue
        empty = spark.createDataFrame([], columns)
        rows = seeds[name](spark).select(*empty.columns) if name in seeds else empty
        rows.coalesce(1).write.parquet(at)
        made.append(name)
    return made


def register(spark: SparkSession, sf_dir: str) -> list[str]:
    """Temporary views of all bindings, and latest_analyses, price_values and scores over them."""
    for name in BINDINGS:
        bind(spark, sf_dir, name).createOrReplaceTempView(name)
    star.latest_analysis(spark.table("analyses")).createOrReplaceTempView("latest_analyses")
    market.price_value(spark.table("market").where("status = 'active'")).createOrReplaceTempView("price_values")
    scoring.scores_by_profile(spark.table("market")).createOrReplaceTempView("scores")
    scoring.profile_weights(spark).createOrReplaceTempView("profile_weights")
    return [*BINDINGS, "latest_analyses", "price_values", "scores", "profile_weights"]
