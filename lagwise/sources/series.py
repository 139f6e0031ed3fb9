"""Series from files and services: date, value frames with missing values kept."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.operators.panel import complete, require, resample, wide
from lagwise.operators.transforms import coerce, transform_by

SERIES = "date date, value double"


def between(df: DataFrame, start: str | None, end: str | None, date: str = "date") -> DataFrame:
    """Both ends count; None is open. On Parquet the bounds reach the scan."""
    if start is not None:
        df = df.filter(F.col(date) >= F.lit(start).cast("date"))
    return df if end is None else df.filter(F.col(date) <= F.lit(end).cast("date"))


def normalised(raw: DataFrame, date: str, value: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(date, value): a value that is no number (a dot, say) is missing and stays; unreadable dates raise."""
    return between(raw.select(F.to_date(F.col(date)).alias("date"), coerce(value).alias("value")), start, end)


def series_csv(spark: SparkSession, path: str, series_id: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """A file with dates in the first column and the series in a column named like it, in any case."""
    raw = spark.read.option("header", True).csv(path)
    value = next((c for c in raw.columns if c.lower() == series_id.lower()), None)
    if value is None:
        raise KeyError(f"{path} has no column {series_id}")
    return normalised(raw, raw.columns[0], value, start, end)


def series_json(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Observations of a service's answer: {"observations": [{"date": ..., "value": ...}]}."""
    raw = spark.read.schema("observations array<struct<date:string,value:string>>").option("multiLine", True).json(path)
    return normalised(raw.select(F.explode("observations").alias("o")).select("o.*"), "date", "value", start, end)


class SeriesClient:
    """Reads series from a service through `fetch(url, params) -> text`, or from a folder of CSV files.

    mode: api (needs a key), csv, or auto: api if there is a key. The key may come from the
    environment variable named by key_variable. Date bounds go to the service where it takes them.
    """

    def __init__(self, spark: SparkSession, fetch: Callable[[str, dict], str] | None = None, folder: str | None = None, key: str | None = None, mode: str = "auto", key_variable: str = "SERIES_API_KEY", url: str = "observations"):
        self.spark, self.fetch, self.folder, self.url = spark, fetch, folder, url
        self.key = key or os.environ.get(key_variable)
        if mode not in ("auto", "api", "csv"):
            raise ValueError("mode must be auto, api or csv")
        self.mode = ("api" if self.key else "csv") if mode == "auto" else mode
        if self.mode == "api" and not self.key:
            raise ValueError("the service needs a key")

    def series(self, series_id: str, start: str | None = None, end: str | None = None) -> DataFrame:
        if self.mode == "csv":
            return series_csv(self.spark, f"{self.folder}/{series_id}.csv", series_id, start, end)
        params = {"series_id": series_id, "api_key": self.key, "file_type": "json"} | ({"observation_start": start} if start else {}) | ({"observation_end": end} if end else {})
        rows = [(o["date"], o["value"]) for o in json.loads(self.fetch(self.url, params))["observations"]]
        return normalised(self.spark.createDataFrame(rows, "date string, value string"), "date", "value", start, end)


def universe(client: SeriesClient, nodes: list[dict], start: str | None = None, end: str | None = None, source: str = "series") -> tuple[DataFrame, DataFrame]:
    """The complete wide panel of the configured nodes, and their metadata.

    A node has id, source, series_id, transform and, if wanted, family and role. Transforms come
    before incomplete rows go; all series meet in one pivot.
    """
    own = [n for n in nodes if n.get("source") == source]
    if not own:
        raise ValueError(f"no node has the source {source}")
    rows = None
    for n in own:
        one = client.series(n["series_id"], start, end).select(F.lit(n["id"]).alias("series"), "date", "value")
        rows = one if rows is None else rows.unionByName(one)
    rows = transform_by(rows, {n["id"]: n.get("transform", "level") for n in own})
    meta = client.spark.createDataFrame([(n["id"], n["source"], n["series_id"], n.get("family"), n.get("transform", "level"), n.get("role")) for n in own], "id string, source string, series_id string, family string, transform string, role string")
    return complete(wide(rows, [n["id"] for n in own])), meta


def physical_csv(spark: SparkSession, path: str, date: str, values: list[str], unit: str | None = None, how: str = "sum") -> DataFrame:
    """(series, date, value) of a file's value columns, resampled to calendar bins if a unit is given. Bad dates raise."""
    raw = spark.read.option("header", True).csv(path)
    require(raw, date, *values)
    rows = raw.select(F.to_date(F.col(date)).alias("date"), *(coerce(v).alias(v) for v in values)).unpivot(["date"], values, "series", "value")
    return rows if unit is None else resample(rows, unit, how).select("series", F.col("bin").alias("date"), "value")


class Retry(Exception):
    """What a transport raises where another try may help (time-outs, lost connections)."""


def pages(ask: Callable[[int, int], dict], size: int = 1000, retries: int = 4, backoff: float = 1.5, sleep: Callable[[float], None] = time.sleep) -> Iterable[dict]:
    """All records of a service that answers ask(offset, size) with features and exceededTransferLimit.

    Ends on an empty or short page, or where the service says there is no more. Only Retry is tried
    again, after backoff * 2**n seconds. An answer with an error raises.
    """
    offset = 0
    while True:
        for n in range(retries + 1):
            try:
                got = ask(offset, size)
                break
            except Retry:
                if n == retries:
                    raise
                sleep(backoff * 2**n)
        if "error" in got:
            raise RuntimeError(f"the service says: {got['error']}")
        rows = [f["attributes"] for f in got.get("features", [])]
        yield from rows
        if not rows or len(rows) < size or got.get("exceededTransferLimit") is False:
            return
        offset += len(rows)


def download(spark: SparkSession, ask_for: Callable[[str, int], Callable[[int, int], dict]], entities: list[str], years: list[int], cache: str, columns: list[str], date: str = "date", key: str = "portid") -> DataFrame:
    """Observations of each entity and year, one cached Parquet part for each; parts that are there are not asked for again.

    Of repeats of a (date, entity) the last one received stays.
    """
    from lagwise.sources.observations import keep_last, parse_dates

    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    schema = ", ".join(f"`{c}` string" for c in columns) + ", seq long"
    parts = []
    for e in entities:
        for y in years:
            path = f"{cache}/{key}={e}/year={y}"
            p = fs_path(f"{path}/_SUCCESS")
            if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
                rows = [tuple(None if r.get(c) is None else str(r[c]) for c in columns) + (n,) for n, r in enumerate(pages(ask_for(e, y)))]
                spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)
            parts.append(path)
    raw = spark.read.schema(schema).parquet(*parts)
    metrics = [c for c in columns if c not in (date, key, "portname")]
    return keep_last(parse_dates(raw, metrics, date), [date, key], "seq").drop("seq")
