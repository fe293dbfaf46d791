"""Usage ledger: sums by day, as a batch and as a stream over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"))


def daily_stream(events: DataFrame) -> DataFrame:
    """The same sums of a stream, for complete mode: without a watermark no row is late and no day stays open. The state
    has a row for each day and event type, however many events there are."""
    return daily(events)
