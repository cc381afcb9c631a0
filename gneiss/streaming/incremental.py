"""Incremental history as Structured Streaming: partial aggregates by day that merge to the batch result (2.15).

Sums, minima, maxima and sets of authors merge in any order, so late commits need no watermark.  Recency is anchored
on the last event seen, so the sink keeps a row a path and day and counts the last 90 days when it is read.  Every
micro-batch writes a folder named by its number, so a batch that runs twice replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gneiss.functions import predicates as P

DAILY = "path string, day date, changes long, fixes long, additions long, deletions long, first timestamp, last timestamp, authors array<string>"


def daily(changes: DataFrame) -> DataFrame:
    """(path, day, ...) partial aggregates of (path, ts, author, fix, additions, deletions)."""
    return changes.where(~P.is_noise(F.col("path"))).groupBy("path", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("changes"), F.count_if("fix").alias("fixes"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.collect_set("author").alias("authors")
    )


def merged(parts: DataFrame, recent_days: int = P.RECENT_DAYS) -> DataFrame:
    """File activity out of partial aggregates: (path, changes, recent_changes, fixes, additions, deletions, created, last_changed, authors).

    A day counts as recent if it is at most ``recent_days`` before the day of the last event.
    """
    last = F.broadcast(parts.agg(F.max("day").alias("until")))  # one row
    rows = parts.crossJoin(last)
    return rows.groupBy("path").agg(
        F.sum("changes").alias("changes"),
        F.sum(F.when(F.col("day") >= F.date_sub("until", recent_days), F.col("changes")).otherwise(0)).alias("recent_changes"),
        F.sum("fixes").alias("fixes"),
        F.sum("additions").alias("additions"),
        F.sum("deletions").alias("deletions"),
        F.min("first").alias("created"),
        F.max("last").alias("last_changed"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("authors")))).alias("authors"),
    )


def update(stream: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write each micro-batch's partial aggregates below the folder."""

    def sink(batch: DataFrame, number: int) -> None:
        daily(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def activity(spark: SparkSession, folder: str, recent_days: int = P.RECENT_DAYS) -> DataFrame:
    """The merged state of all batches so far."""
    return merged(spark.read.option("recursiveFileLookup", "true").schema(DAILY).parquet(folder), recent_days)


def compact(spark: SparkSession, folder: str, into: str) -> None:
    """One partial row a path and day, in a new folder, so that the state doesn't grow with the number of batches."""
    parts = spark.read.option("recursiveFileLookup", "true").schema(DAILY).parquet(folder)
    parts.groupBy("path", "day").agg(
        *(F.sum(c).alias(c) for c in ("changes", "fixes", "additions", "deletions")), F.min("first").alias("first"), F.max("last").alias("last"), F.array_distinct(F.flatten(F.collect_list("authors"))).alias("authors")
    ).write.parquet(f"{into}/batch=0")


def event_changes(events: DataFrame) -> DataFrame:
    """Events as changes: the user is the author, the number in props the path, errors and refunds are fixes."""
    return events.select(
        F.concat(F.lit("k/"), F.get_json_object("props", "$.k"), F.lit(".py")).alias("path"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("author"),
        F.col("event_type").isin("error", "refund", "purchase").alias("fix"),
        F.floor("value").cast("long").alias("additions"),
        F.lit(1).cast("long").alias("deletions"),
    )


def windows(events: DataFrame, watermark: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Events and their value by type and tumbling window; works on a stream as well as on a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", watermark)
    by = timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Runs of a user's events with no pause longer than the gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", watermark)
    by = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return by.select("user_id", F.col("w.start").alias("start"), "n")
