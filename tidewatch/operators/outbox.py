"""A queue of notifications: idempotent events, numbered parts, due parts, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.times import retry_seconds


def fresh_events(events: DataFrame, known: DataFrame) -> DataFrame:
    """Events whose key is not known yet, one of each key."""
    return events.dropDuplicates(["event_key"]).join(known.select("event_key"), "event_key", "left_anti")


def numbered_parts(events: DataFrame, parts: str = "parts") -> DataFrame:
    """(event_key, part_no, part), from 0, pending and due at once."""
    return events.select("event_key", F.posexplode(parts).alias("part_no", "part")).withColumn("status", F.lit("pending")).withColumn("attempts", F.lit(0))


def due(parts: DataFrame, events: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Pending parts whose time has come, with their events, in the order of the queue."""
    rows = parts.filter((F.col("status") == "pending") & (F.col("next_attempt_at") <= now)).join(events, "event_id").orderBy("event_id", "part_no")
    return rows if limit is None else rows.limit(limit)


def after_failure(parts: DataFrame, error: Column) -> DataFrame:
    """Parts with one more attempt, their next one put off, the error cut to 1000 characters."""
    delay = retry_seconds(F.col("attempts"))
    return parts.withColumn("delay_seconds", delay).withColumn("next_attempt_at", F.timestamp_add("SECOND", delay, F.col("next_attempt_at"))).withColumn("attempts", F.col("attempts") + 1).withColumn("last_error", F.left(error, F.lit(1000)))


def after_delivery(parts: DataFrame, sent: DataFrame) -> DataFrame:
    """Status of parts after `sent` (event_id, part_no) went out."""
    marked = sent.select("event_id", "part_no").distinct().withColumn("__sent", F.lit(True))
    return parts.join(marked, ["event_id", "part_no"], "left").withColumn("status", F.when(F.col("__sent"), "sent").otherwise(F.col("status"))).drop("__sent")
