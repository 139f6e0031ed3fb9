"""Direct forecasts over expanding windows, as set operations on moments.

A model of refit k at horizon h is a function of the moments of its training rows. Those are
summed per (h, block of rows between refits), block sums are accumulated once along k, and each
refit is solved on its own from its prefix: no row is read twice, however many refits there are.

Frames: panel (i, date, series, x) in long form with rows numbered from 0 in each series;
design (i, z) with lags newest first, series in the given order within each lag;
targets (h, i, g, y, realized_date); models (h, k, g, mu, sd, mu_y, sd_y, coef, ...).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagwise.operators import solvers


@dataclass(frozen=True)
class Window_:
    """Which rows are forecast and when models are refitted."""

    lags: int = 5
    min_train: int = 750
    refit_every: int = 20
    horizons: tuple[int, ...] = (1,)


def design(panel: DataFrame, series: list[str], lags: int) -> DataFrame:
    """(i, z): each value is sent to the rows it is a lag of, so no window spans the panel."""
    if lags < 1:
        raise ValueError("lags must be 1 or more")
    order = F.array_position(F.array(*(F.lit(s) for s in series)), F.col("series"))
    rows = panel.filter(F.col("series").isin(series)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(lags))))
    sent = rows.select((F.col("i") + F.col("k")).cast("long").alias("i"), ((F.col("k") - 1) * len(series) + order).alias("at"), "x")
    got = sent.filter("x is not null").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("s"))
    return got.filter(F.size("s") == lags * len(series)).select("i", F.transform("s", lambda v: v["x"]).alias("z"))


def targets(panel: DataFrame, names: list[str], horizons: tuple[int, ...]) -> DataFrame:
    """(h, i, g, y, date, realized_date): sums of the next h values, where all are there."""
    w = Window.partitionBy("series").orderBy("i")
    one = lambda h: F.struct(F.lit(h).alias("h"), F.when(F.count("x").over(w.rowsBetween(0, h - 1)) == h, F.sum("x").over(w.rowsBetween(0, h - 1))).alias("y"), F.lead("date", h - 1).over(w).alias("realized_date"))
    rows = panel.filter(F.col("series").isin(names)).withColumn("t", F.array(*(one(h) for h in horizons))).withColumn("t", F.explode("t"))
    return rows.select("t.h", "i", F.col("series").alias("g"), "t.y", "date", "t.realized_date").filter("y is not null and realized_date is not null")


def block_of(i: Column, h: Column, spec: Window_) -> Column:
    """The first refit whose training window, rows up to i_k - h, holds row i."""
    return F.ceil(F.greatest(F.lit(0), i + h - spec.min_train) / F.lit(float(spec.refit_every))).cast("int")


def refit_of(i: Column, spec: Window_) -> Column:
    """The refit in force at row i."""
    return F.floor((i - spec.min_train) / F.lit(float(spec.refit_every))).cast("int")


#: Bytes of matrices after which a task sends them on.
HELD = 16 << 20


def prefixes(rows: DataFrame, n_z: int, names: list[str], spec: Window_) -> DataFrame:
    """(h, k, m): moments of all training rows of refit k. rows: h, i, z, g, y."""
    wide = rows.groupBy("h", "i").agg(F.first("z").alias("z"), *(F.max(F.when(F.col("g") == g, F.col("y"))).alias(f"y{j}") for j, g in enumerate(names)))
    wide = wide.dropna("any").withColumn("k", block_of(F.col("i"), F.col("h"), spec)).select("h", "k", "z", F.array(*(F.col(f"y{j}") for j in range(len(names)))).alias("y"))
    d = 1 + n_z + len(names)

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for part in parts:
            for key, own in part.groupby(["h", "k"]):
                v = np.hstack((np.ones((len(own), 1)), np.stack(own["z"].to_numpy()), np.stack(own["y"].to_numpy())))
                held[key] = held.get(key, 0) + v.T @ v
        yield pd.DataFrame([(h, k, m.tobytes()) for (h, k), m in held.items()], columns=["h", "k", "m"])

    def add(key, parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(m).reshape(d, d) for m in parts["m"])
        return pd.DataFrame([(*key, total.tobytes())], columns=["h", "k", "m"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total, last = None, None, -1
        for part in parts:
            out = []
            for h, k, m in part[["h", "k", "m"]].itertuples(index=False):
                if h != now:
                    now, total, last = h, np.zeros(d * d), -1
                for j in range(last + 1, k) if last >= 0 else ():  # refits without new rows
                    out.append((h, j, total.tobytes()))
                total, last = total + np.frombuffer(m), k
                out.append((h, k, total.tobytes()))
                if len(out) * total.nbytes >= HELD:
                    yield pd.DataFrame(out, columns=["h", "k", "m"])
                    out = []
            yield pd.DataFrame(out, columns=["h", "k", "m"])

    kind = "h int, k int, m binary"
    blocks = wide.mapInPandas(sums, kind).groupBy("h", "k").applyInPandas(add, kind)
    return blocks.repartition("h").sortWithinPartitions("h", "k").mapInPandas(run, kind)


MODEL = "h int, k int, g string, n double, mu array<double>, sd array<double>, mu_y double, sd_y double, coef array<double>"


def solve(prefix: DataFrame, n_z: int, names: list[str], fit, centre: bool = True, least: int = 2) -> DataFrame:
    """Models of every refit and target. fit(gram, cross, n, g) -> coefficients of standardised columns.

    centre: the response is centred; else it is only scaled (about its mean) and there is no intercept.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for h, k, raw in part[["h", "k", "m"]].itertuples(index=False):
                m = np.frombuffer(raw).reshape(1 + n_z + len(names), -1)
                if m[0, 0] < least:
                    continue
                n, mu, mu_y, sd, sd_y, cov, cross = solvers.split(m, n_z)
                gram = cov / np.outer(sd, sd)
                if not centre:  # the columns of z are centred, so the mean of y drops out of the cross products
                    sd_y, mu_y = np.where(sd_y <= 1e-12, 1.0, sd_y), np.zeros_like(mu_y)
                for j, g in enumerate(names):
                    w = fit(gram, (cross[:, j] / sd / sd_y[j])[:, None], n, j)[:, 0]
                    out.append((h, k, g, n, mu.tolist(), sd.tolist(), float(mu_y[j]), float(sd_y[j]), w.tolist()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MODEL.split(", ")])

    return prefix.repartition("h", "k").mapInPandas(run, MODEL)


def lasso_fit(alpha: float):
    return lambda gram, cross, n, j: solvers.lasso(gram, cross, alpha)


def own_ridge_fit(alpha: float, n_series: int, lags: int, columns: list[int]):
    """Ridge on the lags of the target's own series; columns: each target's place among the series."""

    def fit(gram, cross, n, j):
        own = [k * n_series + columns[j] for k in range(lags)]
        out = np.zeros_like(cross)
        out[own] = solvers.ridge(gram[np.ix_(own, own)], cross[own], alpha, n)
        return out

    return fit


def masked_ridge(prefix: DataFrame, masks: DataFrame, series: list[str], lags: int, names: list[str], alpha: float, centre: bool = True) -> DataFrame:
    """Ridge refits on the allowed sources of each (h, k, g); masks: h, k, source, target. Nothing allowed: no coefficient."""
    n_z, p = lags * len(series), len(series)
    allowed = masks.groupBy("h", "k").agg(F.collect_set(F.struct("source", "target")).alias("allowed"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for h, k, raw, edges in part[["h", "k", "m", "allowed"]].itertuples(index=False):
                m = np.frombuffer(raw).reshape(1 + n_z + len(names), -1)
                n, mu, mu_y, sd, sd_y, cov, cross = solvers.split(m, n_z)
                if not centre:
                    sd_y, mu_y = np.where(sd_y <= 1e-12, 1.0, sd_y), np.zeros_like(mu_y)
                own_edges = {(e["source"], e["target"]) for e in (edges if edges is not None else [])}
                for j, g in enumerate(names):
                    own = [lag * p + s for lag in range(lags) for s in range(p) if (series[s], g) in own_edges]
                    w = np.zeros(n_z)
                    if own:
                        gram = (cov / np.outer(sd, sd))[np.ix_(own, own)]
                        w[own] = solvers.ridge(gram, (cross[own, j] / sd[own] / sd_y[j])[:, None], alpha, n)[:, 0]
                    out.append((h, k, g, n, mu.tolist(), sd.tolist(), float(mu_y[j]), float(sd_y[j]), w.tolist()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MODEL.split(", ")])

    return prefix.join(allowed, ["h", "k"], "left").repartition("h", "k").mapInPandas(run, MODEL)


def coefficients(models: DataFrame, series: list[str]) -> DataFrame:
    """(h, k, target, lag, source, coef), standardised, in long form."""
    names = F.array(*(F.lit(s) for s in series))
    rows = models.select("h", "k", F.col("g").alias("target"), F.posexplode("coef").alias("at", "coef"))
    return rows.select("h", "k", "target", (F.floor(F.col("at") / len(series)) + 1).cast("int").alias("lag"), F.element_at(names, (F.col("at") % len(series) + 1).cast("int")).alias("source"), "coef")


def adjacency(coefs: DataFrame) -> DataFrame:
    """(h, k, source, target, strength, signed_weight): sums of |coef| over lags; the strongest lag's coefficient, the newest of equals."""
    return coefs.groupBy("h", "k", "source", "target").agg(F.sum(F.abs("coef")).alias("strength"), F.max_by("coef", F.struct(F.abs("coef"), -F.col("lag"))).alias("signed_weight"))


def effects(design_rows: DataFrame, models: DataFrame, series: list[str], lags: int, spec: Window_) -> DataFrame:
    """(h, i, g, base, effects): a forecast is base plus the effects of all sources, one array element a source."""
    p = len(series)
    rows = design_rows.filter(F.col("i") >= spec.min_train).withColumn("k", refit_of(F.col("i"), spec)).join(models, "k")
    parts = F.zip_with(F.zip_with(F.col("z"), F.col("mu"), lambda a, b: a - b), F.zip_with(F.col("coef"), F.col("sd"), lambda a, b: a / b), lambda a, b: a * b)
    rows = rows.withColumn("parts", parts)
    total = F.array(*(F.col("sd_y") * sum((F.col("parts")[lag * p + s] for lag in range(1, lags)), F.col("parts")[s]) for s in range(p)))
    return rows.select("h", "i", "k", "g", F.col("mu_y").alias("base"), total.alias("effects"))


def forecast(eff: DataFrame) -> DataFrame:
    """(h, i, k, g, prediction)"""
    return eff.select("h", "i", "k", "g", (F.col("base") + F.aggregate("effects", F.lit(0.0), lambda a, x: a + x)).alias("prediction"))
