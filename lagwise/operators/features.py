"""Past-only anomalies of physical facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.functions.names import slug_column
from lagwise.operators.panel import require
from lagwise.operators.transforms import log1p

METHODS = ("rolling", "seasonal_yoy")


def _order(keys: list[str], date: str):
    return Window.partitionBy(*keys).orderBy(date)


def smooth(df: DataFrame, keys: list[str], days: int = 7, value: str = "value", date: str = "date", out: str = "smooth") -> DataFrame:
    """Trailing mean of log(1 + x) over `days` rows; at least half of them (two) must be there."""
    frame = _order(keys, date).rowsBetween(1 - days, 0)
    df = df.withColumn("__log", log1p(value))
    return df.withColumn(out, F.when(F.count("__log").over(frame) >= max(2, days // 2), F.avg("__log").over(frame))).drop("__log")


def _against_past(x: Column, w, baseline: int, least: int) -> Column:
    frame = w.rowsBetween(-baseline, -1)
    enough = F.count(x).over(frame) >= least
    return F.try_divide(x - F.when(enough, F.avg(x).over(frame)), F.when(enough, F.nullif(F.stddev_samp(x).over(frame), F.lit(0.0))))


def anomaly(df: DataFrame, keys: list[str], method: str = "rolling", smooth_days: int = 7, baseline_days: int = 365, min_periods: int = 90, seasonal_lag: int = 364, value: str = "value", date: str = "date", out: str = "anomaly") -> DataFrame:
    """z-score of the smoothed series, or of its change over a season, against strictly earlier rows.

    Windows count rows. A constant baseline gives a null. All layers share one sort a series.
    """
    if method not in METHODS:
        raise ValueError(f"no method {method!r}; there are {', '.join(METHODS)}")
    w = _order(keys, date)
    df = smooth(df, keys, smooth_days, value, date, "__s")
    if method == "seasonal_yoy":
        df = df.withColumn("__s", F.col("__s") - F.lag("__s", seasonal_lag).over(w))
    return df.withColumn(out, _against_past(F.col("__s"), w, baseline_days, min_periods)).drop("__s")


def feature_panel(facts: DataFrame, metrics: list[str], method: str = "rolling", **options) -> DataFrame:
    """Long features (date, feature, value) of every port and metric, named pw_{port}_{metric}_z."""
    require(facts, "date", "portname", *metrics)
    rows = facts.select("date", "portname", *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(["date", "portname"], metrics, "metric", "value")
    rows = anomaly(rows, ["portname", "metric"], method, **options)
    name = F.concat(F.lit("pw_"), slug_column(F.col("portname")), F.lit("_"), F.col("metric"), F.lit("_z"))
    return rows.select("date", name.alias("feature"), F.col("anomaly").alias("value"))
