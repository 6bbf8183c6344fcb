"""The change feed as a stream (an extension: the listing engine itself works in batches).

Snapshots arrive in files; each micro-batch is compared with the stored state by the same upsert as in batch
and its events are appended. State and events are tables of their own under a folder; a batch writes a new
state beside the old one and then points to it, so a repeated batch starts from the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes

COLUMNS = ("price_eur", "visits", "description", "images")


def step(stored: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new state, events) after one batch; of a listing's rows in a batch the newest counts.

    Listings that a batch does not hold stay as they are: a stream never is a full crawl.
    """
    rest = [c for c in batch.columns if c != "listing_id"]
    newest = batch.groupBy("listing_id").agg(F.max_by(F.struct(*rest), "checked_at").alias("x")).select("listing_id", *(f"x.{c}" for c in rest))
    rows = changes.upsert(stored, newest, COLUMNS, full=False)
    state = rows.select("listing_id", *COLUMNS, "status")
    events = rows.where("outcome = 'changed'").select("listing_id", F.explode("events").alias("event_type"))
    return state, events


def run(spark: SparkSession, snapshots: DataFrame, folder: str, checkpoint: str):
    """Starts the stream over a streaming snapshots frame; returns its query."""

    def write(batch: DataFrame, number: int) -> None:
        before = f"{folder}/state/{number - 1}"
        schema = "listing_id long, price_eur long, visits long, description string, images long, status string"
        stored = spark.read.schema(schema).parquet(before) if number else spark.createDataFrame([], schema)
        state, events = step(stored, batch)
        state.write.mode("overwrite").parquet(f"{folder}/state/{number}")
        events.write.mode("overwrite").parquet(f"{folder}/events/batch={number}")
        if number > 1:  # the state before this one stays, for a batch that is repeated
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state/{number - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return snapshots.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and time window, closed once the watermark has passed."""
    return events.withWatermark("at", late).groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("n"))
