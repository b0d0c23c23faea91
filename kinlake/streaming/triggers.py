"""When a tenant is due for consolidation, over a stream of completed photos (ST2, L1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlake.config import DEFAULT, Thresholds


def completed_once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each photo's first completion; state is dropped once the watermark has passed."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "photo_id"])


def idle_windows(events: DataFrame, t: Thresholds = DEFAULT, late: str = "1 hour") -> DataFrame:
    """Sessions that have ended: a tenant is due by idle time at the end of each."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", f"{t.idle_hours} hours").alias("w")).agg(F.count("*").alias("photos"))
    return s.select("user_id", F.col("w.start").alias("first_ts"), F.col("w.end").alias("due_since"), "photos")


def count_triggers(events: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """How often each tenant has reached the photo count so far (update mode)."""
    return events.groupBy("user_id").agg(F.count("*").alias("photos"), F.expr(f"count(*) div {t.every_photos}").alias("triggers"))
