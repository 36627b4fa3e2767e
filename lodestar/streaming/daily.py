"""Structured Streaming over late daily facts: an addition; the batch operators need none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_windows(facts: DataFrame, *, late: str = "3 days", window: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Clicks, impressions and position of each page in sliding weeks of a stream (ts, page, query, clicks, impressions, position_x10).

    A fact of one page, query and time counts once; facts later than `late` are dropped, and so is the state behind them.
    """
    once = facts.withWatermark("ts", late).dropDuplicatesWithinWatermark(["ts", "page", "query"])
    sums = once.groupBy(F.window("ts", window, slide), "page").agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
        F.sum(F.col("impressions") * F.col("position_x10")).alias("w")
    )
    return sums.select(
        F.col("window.start").alias("start"), "page", "clicks", "impressions",
        (F.col("w").cast("double") / (F.col("impressions") * 10.0)).alias("position")
    )
