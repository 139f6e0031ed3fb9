"""Online aggregation of experts by delayed Fixed-Share weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def learning_rate(n: Column, experts: int) -> Column:
    if experts <= 1:
        return F.lit(0.0)
    return F.least(F.lit(1.0), F.sqrt(F.lit(8.0) * F.ln(F.lit(float(experts))) / F.greatest(n, F.lit(1))))


def _check(horizon_least: int, share: float, window: int, clip: float, experts: list[str]) -> None:
    if horizon_least < 1 or not 0 <= share < 1 or window < 1 or clip <= 0 or not experts:
        raise ValueError("needs horizon >= 1, 0 <= share < 1, window >= 1, clip > 0 and an expert")


def complete_rows(forecasts: DataFrame, experts: list[str]) -> DataFrame:
    """(horizon, target, date, pos, actual, predictions): dates that all experts and the actual have, from 0."""
    e = [F.max(F.when(F.col("model") == m, F.col("prediction"))).alias(f"e{k}") for k, m in enumerate(experts)]
    rows = forecasts.filter(F.col("model").isin(experts)).groupBy("horizon", "target", "date").agg(F.first("actual").alias("actual"), *e)
    rows = rows.dropna("any")
    w = Window.partitionBy("horizon", "target").orderBy("date")
    return rows.select("horizon", "target", "date", (F.row_number().over(w) - 1).alias("pos"), "actual", F.array(*(F.col(f"e{k}") for k in range(len(experts)))).alias("predictions"))


def bounded_losses(rows: DataFrame, experts: list[str], window: int = 252, clip: float = 5.0) -> DataFrame:
    """Adds losses, pooled, scale, bounded (arrays by expert), n and eta of each row's own outcome.

    scale: the median of up to `window` earlier pooled losses, the first row's own, at least 1e-12.
    """
    w = Window.partitionBy("horizon", "target").orderBy("pos")
    losses = F.transform("predictions", lambda p: F.pow(F.col("actual") - p, 2))
    rows = rows.withColumn("losses", losses).withColumn("pooled", F.aggregate("losses", F.lit(0.0), lambda a, x: a + x) / len(experts))
    earlier = F.percentile("pooled", F.lit(0.5)).over(w.rowsBetween(-window, -1))
    rows = rows.withColumn("scale", F.greatest(F.coalesce(earlier, F.col("pooled")), F.lit(1e-12)))
    rows = rows.withColumn("bounded", F.transform("losses", lambda x: F.least(F.greatest(x / F.col("scale"), F.lit(0.0)), F.lit(float(clip))) / clip))
    return rows.withColumn("n", F.col("pos") + 1).withColumn("eta", learning_rate(F.col("pos") + 1, len(experts)))


def fixed_share(forecasts: DataFrame, experts: list[str], shares: list[float] | None = None, window: int = 252, clip: float = 5.0) -> DataFrame:
    """(share, horizon, target, date, actual, prediction, weights, updates) for each share of the grid.

    At row i the outcome of row i - h is known; weights are updated with it before row i's
    forecast. Losses, scales and rates come from windows; what is left is a recurrence in the
    weights along each (horizon, target, share), folded in order with the last h rows in memory.
    """
    shares = shares or [1.0 / 252]
    for s in shares:
        _check(1, s, window, clip, experts)
    rows = bounded_losses(complete_rows(forecasts, experts), experts, window, clip)
    # The outcome that row i learns: that of row i - h.
    known = rows.select("horizon", "target", (F.col("pos") + F.col("horizon")).cast("int").alias("pos"), F.col("bounded").alias("seen"), F.col("eta").alias("rate"), F.col("n").alias("updates"))
    rows = rows.join(known, ["horizon", "target", "pos"], "left").withColumn("updates", F.coalesce("updates", F.lit(0)))
    rows = rows.withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in shares))))
    keys, k = ["share", "horizon", "target"], len(experts)
    dealt = rows.select(*keys, "pos", "date", "actual", "predictions", "seen", "rate", "updates").repartition(*keys).sortWithinPartitions(*keys, "pos")

    def fold(parts):
        now, weights = None, None
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                if (r.share, r.horizon, r.target) != now:
                    now, weights = (r.share, r.horizon, r.target), np.full(k, 1 / k)
                if r.seen is not None:
                    u = weights * np.exp(-r.rate * np.asarray(r.seen))
                    total = u.sum()
                    u = u / total if np.isfinite(total) and total > 0 else np.full(k, 1 / k)
                    weights = (1 - r.share) * u + r.share / k
                    weights = weights / weights.sum()
                out.append((r.share, r.horizon, r.target, r.date, r.actual, float(weights @ np.asarray(r.predictions)), weights.tolist(), r.updates))
            yield pd.DataFrame(out, columns=["share", "horizon", "target", "date", "actual", "prediction", "weights", "updates"])

    kind = forecasts.schema["horizon"].dataType.simpleString()
    return dealt.mapInPandas(fold, f"share double, horizon {kind}, target string, date date, actual double, prediction double, weights array<double>, updates int")


def weights_long(out: DataFrame, experts: list[str]) -> DataFrame:
    """A row an expert: (share, horizon, target, date, expert, weight, updates)."""
    return out.select("share", "horizon", "target", "date", "updates", F.posexplode("weights").alias("k", "weight")).withColumn("expert", F.element_at(F.array(*(F.lit(e) for e in experts)), F.col("k") + 1)).drop("k")
