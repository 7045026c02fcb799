"""Fixed-window rate limits over request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The default limit.
MAX_REQUESTS, WINDOW = 30, "10 minutes"


def windows(events: DataFrame, max_requests: int = MAX_REQUESTS, width: str = WINDOW) -> DataFrame:
    """Every request with its window, whether it was allowed, what remained and when the window resets.

    Only the first `max_requests` of a window need an exact rank; the group limit cuts the rest before the shuffle and
    they come back by their unique id. A client with a third of all requests never meets in one task.
    """
    placed = events.select("event_id", "client", "ts", F.window("ts", width).alias("w")).select(
        "event_id", "client", "ts", F.col("w.start").alias("window_start"), F.col("w.end").alias("reset_at"))
    rank = F.expr("row_number() OVER (PARTITION BY client, window_start ORDER BY ts, event_id)")
    first = placed.select("event_id", "client", "ts", "window_start").withColumn("rank", rank).where(
        F.col("rank") <= max_requests).select("event_id", "rank")
    return placed.join(first, "event_id", "left").select(
        "event_id", "client", "window_start", F.col("rank").isNotNull().alias("allowed"),
        F.coalesce(F.lit(max_requests) - F.col("rank"), F.lit(0)).cast("bigint").alias("remaining"), "reset_at")


def offenders(events: DataFrame, max_requests: int = MAX_REQUESTS, width: str = WINDOW) -> DataFrame:
    """Clients and windows over the limit with the number of refused requests."""
    return events.groupBy("client", F.window("ts", width).alias("w")).agg(F.count("*").alias("requests")).where(
        F.col("requests") > max_requests).select(
        "client", F.col("w.start").alias("window_start"), "requests", (F.col("requests") - max_requests).alias("refused"))
