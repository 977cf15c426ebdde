"""Speech segmentation of live events: session windows in batch and streaming form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "2 hours", late: str | None = None) -> DataFrame:
    """media_id, start_ts, end_ts, n, spoken: runs of a user's events without a pause of ``gap``.

    On a stream give ``late``, how long an event may come after later ones; a session is emitted once the
    watermark has passed its end (append mode), so the still open ones are missing.
    """
    if late:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy(F.col("user_id").alias("media_id"), F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("spoken_cs")).select("media_id", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n", "spoken_cs")


def pauses(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """media_id, day, n, kinds: a tumbling count of events, for dashboards beside the sessions."""
    if late:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy(F.col("user_id").alias("media_id"), F.window("ts", width).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.approx_count_distinct("event_type").alias("kinds")).select("media_id", F.col("w.start").alias("day"), "n", "kinds")
