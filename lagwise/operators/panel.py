"""Panels: alignment of series, availability, point-in-time joins, resampling and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RELEASE_COLUMNS = ("observation_time", "available_at", "feature", "value", "source", "frequency", "transform")


def require(df: DataFrame, *names: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise KeyError(f"missing columns: {', '.join(missing)}")


def wide(df: DataFrame, names: list[str], key: str = "series", value: str = "value", date: str = "date") -> DataFrame:
    """Full outer alignment by date: one shuffle, a column a series."""
    return df.groupBy(date).pivot(key, names).agg(F.first(value, ignorenulls=True))


def complete(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Rows without a missing cell."""
    return df.dropna("any", subset=names)


def long(df: DataFrame, names: list[str], date: str = "date", key: str = "feature") -> DataFrame:
    """Wide to long, without missing values."""
    return df.unpivot([date], names, key, "value").filter("value is not null")


def numbered(df: DataFrame, keys: list[str], order: str = "date") -> DataFrame:
    """row_id: the position in each series, from 0."""
    return df.withColumn("row_id", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def filled_on_calendar(totals: DataFrame, fill: float = 0.0) -> DataFrame:
    """(series, date, value): every series on every day from the first to the last day of all."""
    days = totals.agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date"))
    spine = days.crossJoin(totals.select("series").distinct())
    return spine.join(totals, ["series", "date"], "left").select("series", "date", F.coalesce("value", F.lit(float(fill))).alias("value"))


def stamped_releases(features: DataFrame, names: list[str], lag_days: int, source: str, transform: str, frequency: str = "daily", date: str = "date") -> DataFrame:
    """Wide features as a release log: each value becomes known lag_days after its date."""
    if lag_days < 0:
        raise ValueError("the availability lag must be 0 or more")
    out = long(features, names, date)
    return out.select(
        F.col(date).alias("observation_time"), F.date_add(date, lag_days).alias("available_at"), "feature", "value", F.lit(source).alias("source"), F.lit(frequency).alias("frequency"), F.lit(transform).alias("transform")
    )


def as_of(releases: DataFrame, times: DataFrame, features: list[str] | None = None, time: str = "date", unit: str = "month") -> DataFrame:
    """(time, feature, value): the release of each feature that was last available at each time.

    Exact matches count. A release whose value is missing hides older ones. Releases available at
    the same moment: the latest observation wins, then the larger value. Times before a feature's
    first release have a null. Releases and times meet in one sort within each feature and `unit`
    of the calendar, so a feature with a long history spreads over tasks; what was last known
    before a unit is carried over by one row a feature and unit. No range join.
    """
    require(releases, "feature", "available_at", "value")
    seen = F.col("observation_time") if "observation_time" in releases.columns else F.lit(None).cast("date")
    log = releases if features is None else releases.filter(F.col("feature").isin(features))
    bin_ = lambda c: F.date_trunc(unit, c).alias("bin")
    left = log.select("feature", bin_("available_at"), F.col("available_at").alias(time), F.lit(0).alias("side"), seen.alias("observed"), F.struct(F.col("value").alias("value")).alias("release"))
    names = log.select("feature").distinct() if features is None else releases.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    asked = times.select(time).distinct().crossJoin(names)
    right = asked.select("feature", bin_(time), F.col(time), F.lit(1).alias("side"), F.lit(None).cast(left.schema["observed"].dataType).alias("observed"), F.lit(None).cast(left.schema["release"].dataType).alias("release"))
    w = Window.partitionBy("feature", "bin").orderBy(time, "side", "observed", F.col("release.value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("last", F.last("release", ignorenulls=True).over(w)).filter("side = 1")
    ends = left.groupBy("feature", "bin").agg(F.max(F.struct(F.col(time).alias("t"), "observed", "release")).getField("release").alias("end"))
    before = Window.partitionBy("feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = right.select("feature", "bin").distinct().join(ends, ["feature", "bin"], "full").withColumn("carried", F.last("end", ignorenulls=True).over(before))
    out = both.join(carried.select("feature", "bin", "carried"), ["feature", "bin"])
    return out.select(time, "feature", F.coalesce("last", "carried").getField("value").alias("value"))


def as_of_panel(releases: DataFrame, times: DataFrame, features: list[str], time: str = "date") -> DataFrame:
    """The as-of values with a column a feature, for each of the times."""
    found = as_of(releases, times, features, time).groupBy(time).pivot("feature", features).agg(F.first("value"))
    return times.select(time).join(found, time, "left")


def public_panel(finance: DataFrame, releases: DataFrame, features: list[str], date: str = "date") -> DataFrame:
    """Finance with what was known of each feature on its dates; incomplete rows stay."""
    return finance.join(as_of_panel(releases, finance.select(date), features, date), date, "left")


def resample(df: DataFrame, unit: str, how: str = "sum", value: str = "value", keys: list[str] | None = None, date: str = "date") -> DataFrame:
    """Calendar bins of each series by date_trunc; bins without a value are there, missing."""
    if how not in ("sum", "mean"):
        raise ValueError("how must be sum or mean")
    keys = keys or ["series"]
    step = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}[unit]
    bins = df.withColumn("bin", F.date_trunc(unit, date).cast("date")).groupBy(*keys, "bin").agg((F.sum if how == "sum" else F.avg)(value).alias(value))
    spine = bins.groupBy(*keys).agg(F.explode(F.sequence(F.min("bin"), F.max("bin"), F.expr(step))).alias("bin"))
    return spine.join(bins, [*keys, "bin"], "left")


def audit(df: DataFrame, key: str = "series", value: str = "value") -> DataFrame:
    """Per variable: n, missing_fraction, mean, std (sample), min, max, zero_fraction (of the valid)."""
    x = F.col(value)
    n = F.count(value)
    return df.groupBy(F.col(key).alias("variable")).agg(
        n.alias("n"), (1 - n / F.count(F.lit(1))).alias("missing_fraction"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg((x == 0).cast("double")).alias("zero_fraction")
    )


def summary(df: DataFrame, date: str = "date", key: str = "series", value: str = "value") -> DataFrame:
    """One row: start, end, rows, columns, complete_rows, duplicate_dates, max and median gap in days.

    df is long; a date's repeats within a series count as duplicates. An empty panel raises.
    """
    total = df.select(F.countDistinct(key).alias("columns"))
    by_date = df.groupBy(date).agg(F.countDistinct(F.when(F.col(value).isNotNull(), F.col(key))).alias("have"), F.max(F.lit(1)).alias("one"))
    copies = df.groupBy(key, date).agg((F.count(F.lit(1)) - 1).alias("more")).groupBy(date).agg(F.max("more").alias("more"))
    rows = by_date.join(copies, date).join(F.broadcast(total))
    # A row a date: the one window over all dates of the calendar.
    gap = F.datediff(date, F.lag(date).over(Window.orderBy(date)))
    out = rows.withColumn("gap", gap).agg(
        F.min(date).alias("start"), F.max(date).alias("end"), (F.count(F.lit(1)) + F.coalesce(F.sum("more"), F.lit(0))).alias("rows"), F.max("columns").alias("columns"), F.sum((F.col("have") == F.col("columns")).cast("long")).alias("complete_rows"),
        F.coalesce(F.sum("more"), F.lit(0)).alias("duplicate_dates"), F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap_days"), F.coalesce(F.median("gap"), F.lit(0.0)).alias("median_gap_days"),
    )
    return out.withColumn("start", F.when(F.col("start").isNull(), F.raise_error(F.lit("the panel is empty")).cast("date")).otherwise(F.col("start")))
