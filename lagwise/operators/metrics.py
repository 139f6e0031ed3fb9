"""Forecast metrics over segments, and skills against baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_HOLDOUT = 20


def correlation(x, y) -> Column:
    """Pearson's; null where one side is constant (corr() would raise)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def segmented(df: DataFrame, segments: dict[str, tuple[str | None, str | None]], date: str = "date") -> DataFrame:
    """Each row once for every segment (first and last date, inclusive; None is open) that holds it."""
    inside = [F.when((F.lit(True) if a is None else F.col(date) >= F.lit(a).cast("date")) & (F.lit(True) if b is None else F.col(date) <= F.lit(b).cast("date")), F.lit(name)) for name, (a, b) in segments.items()]
    return df.withColumn("segment", F.explode(F.array_compact(F.array(*inside))))


def metrics(df: DataFrame, by: list[str], actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    """Per group over complete pairs: n, rmse, mae, directional_accuracy, corr (more than two pairs).

    The direction is right if the signs are equal; two zeros are.
    """
    y, p = F.col(actual), F.col(prediction)
    e = p - y
    n = F.count(F.lit(1))
    return df.filter(y.isNotNull() & p.isNotNull()).groupBy(*by).agg(
        n.alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg((F.signum(y) == F.signum(p)).cast("double")).alias("directional_accuracy"), F.when(n > 2, correlation(y, p)).alias("corr")
    )


def skill_against(df: DataFrame, baseline: str, by: list[str], prefix: str = "ar") -> DataFrame:
    """Adds the baseline model's rmse of the same group and 1 - rmse / it: a window, not a self-join."""
    base = F.max(F.when(F.col("model") == baseline, F.col("rmse"))).over(Window.partitionBy(*by))
    return df.withColumn(f"{prefix}_rmse", base).withColumn(f"rmse_skill_vs_{prefix}", 1 - F.try_divide(F.col("rmse"), F.col(f"{prefix}_rmse")))


def skill_summary(df: DataFrame, core: str, by: list[str]) -> DataFrame:
    """Per group and model but the core: mean skill over the variables with a core rmse above 0, those better, all."""
    base = F.max(F.when(F.col("model") == core, F.col("rmse"))).over(Window.partitionBy(*by, "variable"))
    skill = 1 - F.col("rmse") / F.col("base")
    rows = df.withColumn("base", base).filter((F.col("model") != core) & (F.col("base") > 0)).withColumn("skill", skill)
    return rows.groupBy(*by, "model").agg(F.avg("skill").alias("mean_skill"), F.count_if(F.col("skill") > 0).alias("n_better"), F.count(F.lit(1)).alias("n_targets"))


def lag_sensitivity(tests: DataFrame, by: list[str], skill: str = "skill") -> DataFrame:
    """Per lag: mean and median skill, how many are better, how many there are, and discoveries that are better."""
    s = F.col(skill)
    return tests.groupBy(*by).agg(
        F.avg(s).alias("mean_skill"), F.median(s).alias("median_skill"), F.count_if(s > 0).alias("n_better"), F.count(s).alias("n_targets"), F.count_if(F.col("fdr_reject") & F.col("challenger_better")).alias("n_fdr_better")
    )


def preferred_segment(df: DataFrame, preferred: str, fallback: str = "all") -> DataFrame:
    """The rows of the preferred segment, or of the fallback if the table has none of it."""
    have = df.filter(F.col("segment") == preferred).limit(1).agg(F.count(F.lit(1)).alias("__have"))
    return df.filter(F.col("segment").isin(preferred, fallback)).crossJoin(have).filter(F.col("segment") == F.when(F.col("__have") > 0, preferred).otherwise(fallback)).drop("__have")


def latest(df: DataFrame, by: list[str], date: str = "date") -> DataFrame:
    """Rows of the last date of each group."""
    return df.withColumn("__last", F.max(date).over(Window.partitionBy(*by))).filter(F.col(date) == F.col("__last")).drop("__last")


def top(df: DataFrame, n: int, order: list, by: list[str] | None = None) -> DataFrame:
    """The first n rows, of all or of each group; give tie-breakers in the order."""
    if not by:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")
