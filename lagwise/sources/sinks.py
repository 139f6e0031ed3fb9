"""Results as Parquet or CSV folders, reports as text, and manifests of frozen files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns by which a result's folder is split.
SPLIT = {"forecasts": ("horizon", "model"), "snapshots": ("h",), "contributions": ("h",), "survival": ("h",), "gates": ("h",), "weights": ("horizon",), "losses": ("horizon",)}


def evidence(results: dict[str, DataFrame], folder: str, report: DataFrame | None = None, form: str = "parquet") -> list[str]:
    """Writes each table under folder/name, split by horizon and model where it has them; returns the paths."""
    out = []
    for name, df in results.items():
        if form == "csv":  # which has no arrays
            df = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else c for c, t in df.dtypes))
        split = [c for c in SPLIT.get(name, ()) if c in df.columns]
        writer = df.write.mode("overwrite").partitionBy(*split) if split else df.write.mode("overwrite")
        (writer.option("header", True) if form == "csv" else writer).format(form).save(path := f"{folder}/{name}")
        out.append(path)
    if report is not None:
        report.coalesce(1).sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path := f"{folder}/RESULTS")
        out.append(path)
    return out


def forecasts(spark: SparkSession, folder: str, form: str = "parquet") -> DataFrame:
    """Forecasts that evidence() wrote, horizons and models pruned by folder."""
    reader = spark.read.option("header", True) if form == "csv" else spark.read
    df = reader.format(form).load(f"{folder}/forecasts")
    return df.select(F.col("horizon").cast("int").alias("horizon"), F.col("model").cast("string").alias("model"), F.col("date").cast("date").alias("date"), "target", F.col("actual").cast("double").alias("actual"), F.col("prediction").cast("double").alias("prediction"))


def manifest(spark: SparkSession, paths: list[str], frozen_on: str, prospective_start: str) -> DataFrame:
    """(path, sha256, length, frozen_on, prospective_start) of files, read whole on the executors."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length", F.lit(frozen_on).cast("date").alias("frozen_on"), F.lit(prospective_start).cast("date").alias("prospective_start"))
