"""The hourly trend kept up to date over a stream of curated events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.metrics import counters


def hourly_trend(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Counters per hour of `events(event_time timestamp, event_type, price_minor, user_id)`, final once the watermark passes.

    Distinct users are approximate, as a stream cannot keep every user of an hour.
    """
    hours = events.withWatermark("event_time", lateness).groupBy(F.window("event_time", "1 hour"))
    out = hours.agg(*counters(), F.approx_count_distinct("user_id").alias("distinct_users"))
    return out.select(F.to_date("window.start").alias("event_date"), F.hour("window.start").alias("event_hour"), *[c for c in out.columns if c != "window"])
