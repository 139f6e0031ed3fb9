"""Tests of equal forecast accuracy with HAC variances, under false-discovery control."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

LEAST_PAIRS = 20


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """2 (1 - Phi(|z|)); Spark has no erfc."""
    return z.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2)))


def loss_differences(pairs: DataFrame, loss: str = "squared") -> DataFrame:
    """Adds d = loss(benchmark) - loss(challenger) to complete rows of actual, benchmark, challenger."""
    if loss not in ("squared", "absolute"):
        raise ValueError("loss must be squared or absolute")
    f = (lambda c: F.pow(F.col("actual") - F.col(c), 2)) if loss == "squared" else (lambda c: F.abs(F.col("actual") - F.col(c)))
    return pairs.dropna("any", subset=["actual", "benchmark", "challenger"]).withColumn("d", f("benchmark") - f("challenger"))


def dm_test(diffs: DataFrame, by: list[str], max_lags: int, lags: Column | None = None, order: str = "date", strict: bool = False) -> DataFrame:
    """Per group: n, mean_loss_improvement, lrv, dm_stat, hac_lags of the differences d.

    The long-run variance has Bartlett weights up to the lag of the group (`lags`, at most max_lags
    and n - 1), divisor n, floor 0; with variance 0 the statistic is 0, or infinite with the sign of
    the mean. Autocovariances need one sort a group. Groups of fewer than LEAST_PAIRS pairs are left
    out, or raise where strict.
    """
    w = Window.partitionBy(*by)
    lags = F.lit(max_lags) if lags is None else lags
    rows = diffs.withColumns({"__n": F.count(F.lit(1)).over(w), "__m": F.avg("d").over(w), "__l": lags})
    rows = rows.withColumn("__l", F.least("__l", F.lit(max_lags), F.col("__n") - 1)).withColumn("__c", F.col("d") - F.col("__m"))
    o = w.orderBy(order)
    if max_lags:
        rows = rows.withColumns({f"__p{k}": F.col("__c") * F.lag("__c", k).over(o) for k in range(1, max_lags + 1)})
    got = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.first("__m").alias("mean_loss_improvement"), F.first("__l").cast("int").alias("hac_lags"), (F.sum(F.col("__c") * F.col("__c")) / F.count(F.lit(1))).alias("__g0"),
        *((F.coalesce(F.sum(f"__p{k}"), F.lit(0.0)) / F.count(F.lit(1))).alias(f"__g{k}") for k in range(1, max_lags + 1)),
    )
    lrv = F.col("__g0")
    for k in range(1, max_lags + 1):
        lrv = lrv + F.when(F.col("hac_lags") >= k, 2 * (1 - k / (F.col("hac_lags") + 1)) * F.col(f"__g{k}")).otherwise(0.0)
    m = F.col("mean_loss_improvement")
    stat = F.when(F.col("lrv") > 0, m / F.sqrt(F.col("lrv") / F.col("n"))).when(m == 0, F.lit(0.0)).otherwise(F.signum(m) * F.lit(float("inf")))
    got = got.withColumn("lrv", F.greatest(lrv, F.lit(0.0))).withColumn("dm_stat", stat).drop(*(f"__g{k}" for k in range(max_lags + 1)))
    if strict:
        return got.withColumn("n", F.when(F.col("n") < LEAST_PAIRS, F.raise_error(F.lit(f"a test needs {LEAST_PAIRS} pairs")).cast("long")).otherwise(F.col("n")))
    return got.filter(F.col("n") >= LEAST_PAIRS)


def benjamini_hochberg(df: DataFrame, q: float, family: list[str], p: str = "p_value", tie: list[str] | None = None) -> DataFrame:
    """Adds fdr_reject: ranks up to the last with p <= q rank / m are rejected. p outside [0, 1] raises."""
    if not 0 < q < 1:
        raise ValueError("q must lie between 0 and 1")
    x = F.col(p)
    ok = F.when(x.isNull() | F.isnan(x) | (x < 0) | (x > 1), F.raise_error(F.lit("p-values must lie in [0, 1]")).cast("double")).otherwise(x)
    every = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(1))
    ranked = df.withColumn("__p", ok).withColumn("__r", F.row_number().over(every.orderBy("__p", *(tie or []))))
    passed = F.when(F.col("__p") <= q * F.col("__r") / F.count(F.lit(1)).over(every), F.col("__r"))
    last = F.max("__pass").over(every)
    return ranked.withColumn("__pass", passed).withColumn("fdr_reject", F.col("__r") <= F.coalesce(last, F.lit(0))).drop("__p", "__r", "__pass")


def nested_tests(forecasts: DataFrame, comparisons: list[tuple[str, str]], base_lags: int = 0, q: float = 0.10, horizons: list[int] | None = None, loss: str = "squared", start: str | None = None, with_p: bool = True) -> DataFrame:
    """Tests of each (benchmark, challenger) by horizon and target over long forecasts.

    forecasts: horizon, model, date, target, actual, prediction. hac_lags = max(base_lags, h - 1).
    False discoveries are held within a comparison, over its targets and horizons. One plan for
    all groups: models meet by a pivot of each (horizon, date, target), not by joins.
    """
    horizons = horizons or [r[0] for r in forecasts.select("horizon").distinct().collect()]
    most = max([base_lags, *(h - 1 for h in horizons)])
    models = sorted({m for c in comparisons for m in c})
    rows = forecasts if start is None else forecasts.filter(F.col("date") >= F.lit(start).cast("date"))
    met = rows.groupBy("horizon", "date", "target").agg(F.first("actual").alias("actual"), *(F.max(F.when(F.col("model") == m, F.col("prediction"))).alias(f"m{i}") for i, m in enumerate(models)))
    one = lambda b, c: F.struct(F.lit(f"{c}_vs_{b}").alias("comparison"), F.lit(b).alias("name_b"), F.lit(c).alias("name_c"), F.col(f"m{models.index(b)}").alias("benchmark"), F.col(f"m{models.index(c)}").alias("challenger"))
    pairs = met.select("horizon", "date", "target", "actual", F.explode(F.array(*(one(b, c) for b, c in comparisons))).alias("c")).select("horizon", "date", "target", "actual", "c.*")
    by = ["comparison", "name_b", "name_c", "horizon", "target"]
    out = dm_test(loss_differences(pairs, loss), by, most, F.greatest(F.lit(base_lags), F.col("horizon") - 1))
    out = out.withColumnsRenamed({"name_b": "benchmark", "name_c": "challenger"}).withColumn("challenger_better", F.col("mean_loss_improvement") > 0)
    if not with_p:
        return out
    return benjamini_hochberg(out.withColumn("p_value", two_sided_p("dm_stat")), q, ["comparison"], tie=["horizon", "target"])


def ordered(tests: DataFrame) -> DataFrame:
    """By comparison, discoveries first, then by improvement."""
    return tests.orderBy("comparison", F.desc("fdr_reject"), F.desc("mean_loss_improvement"), "horizon", "target")


def comparison_summary(tests: DataFrame) -> DataFrame:
    return tests.groupBy("comparison").agg(F.count(F.lit(1)).alias("n_tests"), F.count_if("challenger_better").alias("n_better"), F.count_if("fdr_reject").alias("n_reject"))
