"""Closed spells of a stream of sightings: session windows over index time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def index_time(run_idx: Column) -> Column:
    """Run indices as timestamps, one day apart."""
    return F.timestamp_seconds(run_idx.cast("long") * 86400)


def closed_spells(seen: DataFrame, grace: int) -> DataFrame:
    """(key, start_idx, last_seen_idx, sightings) of spells that no later run can continue, in append mode.

    A spell goes on if the next sighting is at most `grace` runs on, as a session window of that gap does; the watermark
    closes exactly the spells that are not right-censored. Batches work too, and give all spells.
    """
    timed = seen.withColumn("ts", index_time(F.col("run_idx"))).withWatermark("ts", "0 seconds")
    w = timed.groupBy("key", F.session_window("ts", f"{grace} days")).agg(F.min("run_idx").alias("start_idx"), F.max("run_idx").alias("last_seen_idx"), F.count("*").alias("sightings"))
    return w.drop("session_window")
