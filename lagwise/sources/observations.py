"""Observations from services and files: parsing, de-duplication, catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagwise.operators.transforms import coerce

#: Share of dates that must be numbers for all to be epoch milliseconds.
NUMERIC_SHARE = 0.95


def parse_dates(raw: DataFrame, metrics: list[str], date: str = "date") -> DataFrame:
    """Dates from epoch milliseconds or text, whichever the column holds; metrics as numbers, invalid ones null.

    Rows without a readable date go; if none is readable the scan raises.
    """
    number = F.col(date).cast("string").try_cast("double")
    probe = raw.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(number.isNotNull().cast("double")), F.lit(0.0)).alias("share")).first()
    if probe["share"] > NUMERIC_SHARE:
        when = F.to_date(F.timestamp_millis(number.cast("long")))
    else:
        when = F.to_date(F.try_to_timestamp(F.col(date).cast("string")))
    out = raw.withColumn(date, when).withColumns({m: coerce(m) for m in metrics})
    if probe["n"] and not out.filter(F.col(date).isNotNull()).limit(1).count():
        raise ValueError(f"no value of {date} is a date")
    return out.filter(F.col(date).isNotNull())


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the last by `order`."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def catalogue_of(rows: DataFrame, key: str = "portid", name: str = "portname") -> DataFrame:
    """The distinct (key, name) pairs, by name."""
    return rows.select(key, name).dropDuplicates().orderBy(name)
