"""Counts and visits over a stream of events.

An extra beyond the batch jobs: events arrive with an event time, late ones up
to a watermark; counts of a window, and visits, come out as they close.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def click_rates(events: DataFrame, window: str = "10 minutes", late: str = "5 minutes", time: str = "event_time") -> DataFrame:
    """Events and clicks of each module in event-time windows."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), "module").agg(F.count("*").alias("events"), F.count_if("is_click").alias("clicks")).select(F.col("window.start").alias("window_start"), "module", "events", "clicks")


def session_spans(events: DataFrame, gap: str = "30 minutes", late: str = "5 minutes", time: str = "event_time") -> DataFrame:
    """Visits of each participant: runs of events less than ``gap`` apart."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), "participant").agg(F.count("*").alias("events")).select(F.col("session_window.start").alias("visit_start"), F.col("session_window.end").alias("visit_end"), "participant", "events")
