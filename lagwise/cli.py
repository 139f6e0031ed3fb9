"""python -m lagwise.cli: experiments on saved panels, pilots from files, and demonstrations."""

from __future__ import annotations

import argparse
import platform

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.operators import metrics
from lagwise.plans import research
from lagwise.sources import sinks
from lagwise.sources.series import SeriesClient, universe

DEMOS = ("demo", "survival-demo", "overlay-demo", "online-demo")
PILOTS = ("fred-pilot", "portwatch-pilot", "public-pilot", "public-research")
EXPERIMENTS = ("empirical-v1", "empirical-v2", "empirical-v3", "empirical-v4")


def scores(out: dict[str, DataFrame]) -> DataFrame:
    rows = out["forecasts"].withColumnRenamed("target", "variable")
    return metrics.skill_against(metrics.metrics(rows, ["horizon", "model", "variable"]), "ar", ["horizon", "variable"])


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A saved panel, Parquet or CSV, long (date, series, x) or wide (a date and a column a series)."""
    df = spark.read.option("header", True).csv(path) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    df = df.withColumnRenamed(df.columns[0], "date").withColumn("date", F.to_date("date")) if "date" not in df.columns else df.withColumn("date", F.to_date("date"))
    if {"series", "x"} <= set(df.columns):
        return df.select("date", "series", F.col("x").cast("double").alias("x"))
    return research.long_panel(df.select("date", *(F.col(c).cast("double").alias(c) for c in df.columns if c != "date")))


def backend(spark: SparkSession) -> DataFrame:
    rows = [("spark", spark.version), ("pyspark", pyspark.__version__), ("python", platform.python_version()), ("lag design", "DataFrame operations"), ("cores", str(spark.sparkContext.defaultParallelism))]
    return spark.createDataFrame(rows, "part string, value string")


def _experiment(version: str, spark: SparkSession, a, panel: DataFrame | None = None, candidates: list[str] | None = None) -> DataFrame:
    cfg = research.config(a.config)
    if version == "v4":
        out = research.run_v4(sinks.forecasts(spark, a.forecasts, a.form), cfg, a.experts)
    else:
        panel = read_panel(spark, a.panel) if panel is None else panel
        financial = a.financial or research.financial_ids(research.config(a.financial_config))
        if candidates is None:
            candidates = a.candidates or sorted(r["series"] for r in panel.select("series").distinct().limit(10_000).collect() if r["series"] not in financial)
        out = research.run(version, panel, financial, candidates, cfg)
    tables, report = research.evidence(version, out, cfg, panel)
    if a.out:
        sinks.evidence(tables, a.out, report, a.form)
    return tables["metrics"]


def _pilot(spark: SparkSession, a) -> DataFrame:
    finance, physical = research.config(a.financial_config), research.config(a.physical_config)
    client = SeriesClient(spark, folder=a.folder, mode="csv")
    if a.run == "fred-pilot":
        panel, meta = universe(client, finance["financial"], a.start, a.end, source="FRED")
        sinks.evidence({"panel": panel, "metadata": meta}, a.out, form=a.form)
        return panel
    raw = spark.read.parquet(a.raw) if not a.raw.endswith(".csv") else spark.read.option("header", True).csv(a.raw)
    raw = raw.withColumn("date", F.to_date("date"))
    if a.run == "portwatch-pilot":
        options = physical.get("features", {})
        features = research.feature_panel(raw, physical.get("metrics", ["capacity", "n_total"]), options.get("method", "rolling"))
        releases = research.releases_of(features, int(physical.get("availability_lag_days", 10)), physical.get("source", "physical"), options.get("method", "rolling"))
        sinks.evidence({"features": features, "releases": releases, "raw": raw}, a.out, form=a.form)
        return features
    found = research.inputs(client, finance, physical, raw, a.start, a.end)
    sinks.evidence(found.tables(), a.data_out or a.out, form=a.form)
    if a.run == "public-pilot":
        return found.panel
    ids = research.financial_ids(finance)
    a.financial = ids
    out = _experiment("v1", spark, a, research.long_panel(found.panel), found.names)
    lags = physical.get("availability_lag_sensitivity_days", [])
    if lags:
        sinks.evidence({"availability_lag_sensitivity": research.lag_sensitivity(found, lags, ids, research.config(a.config))}, a.out, form=a.form)
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    parser = argparse.ArgumentParser(prog="lagwise")
    parser.add_argument("run", choices=[*DEMOS, *PILOTS, *EXPERIMENTS, "backend-info"])
    parser.add_argument("--panel", help="saved panel: Parquet or CSV, long or wide")
    parser.add_argument("--forecasts", help="folder that an earlier run wrote (empirical-v4)")
    parser.add_argument("--config", help="YAML of the experiment")
    parser.add_argument("--financial-config", help="YAML of the series")
    parser.add_argument("--physical-config", help="YAML of the physical layer")
    parser.add_argument("--folder", help="folder of series, one CSV file each")
    parser.add_argument("--raw", help="physical facts: date, portname and metrics")
    parser.add_argument("--financial", nargs="*")
    parser.add_argument("--candidates", nargs="*")
    parser.add_argument("--experts", nargs="*")
    parser.add_argument("--start")
    parser.add_argument("--end")
    parser.add_argument("--form", choices=["parquet", "csv"], default="parquet")
    parser.add_argument("--data-out")
    parser.add_argument("--out")
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("lagwise").getOrCreate()
    if a.run == "backend-info":
        return backend(spark)
    if a.run in DEMOS:
        out = research.demo(spark, a.run)
        if a.out:
            sinks.evidence(out, a.out, form=a.form)
        return scores(out)
    return _pilot(spark, a) if a.run in PILOTS else _experiment(a.run.removeprefix("empirical-"), spark, a)


if __name__ == "__main__":
    main().show(200, truncate=False)
