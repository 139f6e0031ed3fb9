"""Stream forms: release logs whose revisions arrive late, and running losses of forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_releases(releases: DataFrame, delay: str = "30 days") -> DataFrame:
    """Per feature and day of availability, the release seen last; days older than the delay are dropped from state.

    releases: a stream with feature, available_at (timestamp), observation_time, value.
    """
    held = releases.withWatermark("available_at", delay)
    day = F.window("available_at", "1 day")
    return held.groupBy(day, "feature").agg(F.max(F.struct("available_at", "observation_time", "value")).alias("last")).select(F.col("window.start").cast("date").alias("date"), "feature", "last.value")


def running_losses(outcomes: DataFrame, delay: str = "30 days", width: str = "7 days") -> DataFrame:
    """Squared losses by horizon, model, target and week, over a stream of (ts, horizon, model, target, actual, prediction)."""
    e = F.col("prediction") - F.col("actual")
    held = outcomes.withWatermark("ts", delay)
    return held.groupBy(F.window("ts", width), "horizon", "model", "target").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse")).select(F.col("window.start").alias("start"), "horizon", "model", "target", "n", "rmse")
