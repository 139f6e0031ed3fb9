"""The four experiments, as chains of set-based stages.

Panels come in long form (date, series, x); everything is keyed by horizon, refit and row. What a
step may know at a row is a predicate on dates: outcomes count once realised before it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagwise.operators import edges, experts
from lagwise.operators import walkforward as W
from lagwise.operators.walkforward import Window_


@dataclass(frozen=True)
class Settings:
    """What the experiments take from a configuration."""

    spec: Window_ = Window_()
    alpha: float = 0.035
    ridge: float = 1.0
    threshold: float = 0.05
    min_snapshots: int = 3
    overlay_alpha: float = 0.035
    overlay_min_train: int = 252
    structural_half_life: float = 180.0
    contribution_half_life: float = 120.0
    mask: dict = field(default_factory=lambda: {"min_frequency": 0.5, "min_sign": 0.6, "min_retention": 0.25, "min_contributions": 20, "max_edges": 5})
    stability: dict = field(default_factory=lambda: {"min_frequency": 0.6, "min_sign": 0.75})
    gate: dict = field(default_factory=lambda: {"half_life": 120.0, "min_observations": 30, "t_scale": 2.0})


class Store:
    """Keeps stages that several others read as Parquet in the shared folder: lineage ends there.

    The folder is spark.checkpoint.dir; where that is unset a local one is made, for a local master only.
    """

    def __init__(self, folder: str | None = None):
        self.folder, self.n = folder, 0

    def keep(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        if self.folder is None:
            shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
            if not shared:
                master = spark.sparkContext.master
                if not master.startswith("local") or master.startswith("local-cluster"):
                    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
                shared = "file://" + tempfile.mkdtemp(prefix="lagwise-")
                spark.conf.set("spark.checkpoint.dir", shared)
            self.folder = f"{shared.rstrip('/')}/experiment-{uuid.uuid4().hex}"
            atexit.register(_delete, spark, self.folder)
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)


def _delete(spark, folder: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None and not sc._jsc.sc().isStopped():
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def indexed(panel: DataFrame) -> DataFrame:
    """Adds i, the row number in each series; the panel must be complete."""
    bad = F.when(F.col("x").isNull() | F.isnan("x"), F.raise_error(F.lit("the panel has missing values")).cast("double")).otherwise(F.col("x"))
    return panel.select("date", "series", bad.alias("x")).withColumn("i", (F.row_number().over(Window.partitionBy("series").orderBy("date")) - 1).cast("long"))


def refit_dates(panel: DataFrame, spec: Window_) -> DataFrame:
    """(k, date) of each refit's row."""
    rows = panel.select("i", "date").distinct().filter((F.col("i") >= spec.min_train) & ((F.col("i") - spec.min_train) % spec.refit_every == 0))
    return rows.select(W.refit_of(F.col("i"), spec).alias("k"), "date")


@dataclass
class Fit:
    """A walk-forward of one model family."""

    prefix: DataFrame
    models: DataFrame
    effects: DataFrame
    snapshots: DataFrame


def direct(panel: DataFrame, outcome: DataFrame, sources: list[str], names: list[str], s: Settings, store: Store, alpha: float | None = None, centre: bool = True, least: int = 2, prefix: DataFrame | None = None, fit=None) -> Fit:
    """Models of names on the lags of sources for each refit, their effects and edge snapshots. outcome: h, i, g, y."""
    spec, n_z = s.spec, s.spec.lags * len(sources)
    z = store.keep(W.design(panel, sources, spec.lags))
    prefix = prefix or store.keep(W.prefixes(outcome.join(z, "i"), n_z, names, spec))
    models = store.keep(W.solve(prefix, n_z, names, fit or W.lasso_fit(s.alpha if alpha is None else alpha), centre, least))
    eff = store.keep(W.effects(z, models, sources, spec.lags, spec))
    return Fit(prefix, models, eff, store.keep(snapshots_of(models, sources, refit_dates(panel, spec))))


def snapshots_of(models: DataFrame, sources: list[str], dates: DataFrame) -> DataFrame:
    return W.adjacency(W.coefficients(models, sources)).join(F.broadcast(dates), "k")


def autoregression(panel: DataFrame, outcome: DataFrame, names: list[str], s: Settings, store: Store) -> Fit:
    return direct(panel, outcome, names, names, s, store, fit=W.own_ridge_fit(s.ridge, len(names), s.spec.lags, list(range(len(names)))))


def joined(predictions: dict[str, DataFrame], outcome: DataFrame) -> DataFrame:
    """Long forecasts: horizon, model, date, target, actual, prediction."""
    rows = None
    for name, df in predictions.items():
        one = df.select("h", "i", "g", "prediction").withColumn("model", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    got = rows.join(outcome.select("h", "i", "g", "y", "date"), ["h", "i", "g"])
    return got.select(F.col("h").alias("horizon"), "model", "date", F.col("g").alias("target"), F.col("y").alias("actual"), "prediction")


def _edge_rows(eff: DataFrame, sources: list[str], outcome: DataFrame) -> DataFrame:
    """(h, i, k, target, source, effect, prediction, y, realized_date), a row a source."""
    names = F.array(*(F.lit(x) for x in sources))
    total = F.col("base") + F.aggregate("effects", F.lit(0.0), lambda a, x: a + x)
    rows = eff.select("h", "i", "k", "g", total.alias("prediction"), F.posexplode("effects").alias("at", "effect"))
    got = rows.withColumn("source", F.element_at(names, F.col("at") + 1)).join(outcome.select("h", "i", "g", "y", "realized_date"), ["h", "i", "g"])
    return got.withColumnRenamed("g", "target")


def leave_one_out(fit: Fit, sources: list[str], outcome: DataFrame, threshold: float) -> DataFrame:
    """What each active edge between different series saved of the squared loss."""
    active = fit.snapshots.filter((F.col("strength") >= threshold) & (F.col("source") != F.col("target"))).select("h", "k", "source", "target")
    rows = _edge_rows(fit.effects, sources, outcome).join(active, ["h", "k", "source", "target"], "left_semi")
    e = F.col("y") - F.col("prediction")
    return rows.select("h", "realized_date", "source", "target", ((e + F.col("effect")) * (e + F.col("effect")) - e * e).alias("loss_improvement"))


def add_one(fit: Fit, sources: list[str], residuals: DataFrame, threshold: float) -> DataFrame:
    """What each active overlay edge alone would save against the core. residuals: h, i, g, y (of the core), realized_date."""
    active = fit.snapshots.filter(F.col("strength") >= threshold).select("h", "k", "source", "target")
    rows = _edge_rows(fit.effects, sources, residuals).join(active, ["h", "k", "source", "target"], "left_semi")
    r = F.col("y")
    return rows.select("h", "realized_date", "source", "target", (r * r - (r - F.col("effect")) * (r - F.col("effect"))).alias("loss_improvement"))


def survival_history(fit: Fit, contributions: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Survival as of every refit with enough snapshot dates, and those (h, k, as_of)."""
    dates = fit.snapshots.select("h", "k", "date").distinct()
    count = F.row_number().over(Window.partitionBy("h").orderBy("date"))
    active = dates.withColumn("c", count).filter(F.col("c") >= s.min_snapshots).select("h", "k", F.col("date").alias("as_of"))
    table = edges.survival(fit.snapshots.select("h", "date", "source", "target", "strength", "signed_weight"), contributions, active.select("h", "as_of"), s.threshold, s.structural_half_life, s.contribution_half_life, ["h"])
    return table.join(F.broadcast(active), ["h", "as_of"]), active


def run_v1(panel: DataFrame, financial: list[str], candidates: list[str], s: Settings, store: Store | None = None) -> dict[str, DataFrame]:
    """One step ahead: ar, sparse models of financial and of all series, and all with stable edges only."""
    store, s = store or Store(), s
    panel = store.keep(indexed(panel))
    every = financial + candidates
    outcome = store.keep(W.targets(panel, every, (1,)))
    own = outcome.filter(F.col("g").isin(financial))
    ar, fin = autoregression(panel, own, financial, s, store), direct(panel, own, financial, financial, s, store)
    full = direct(panel, outcome, every, every, s, store)
    snaps = store.keep(full.snapshots)
    # The mask of refit k comes from the snapshots up to and with its own; before enough, all edges count.
    dates = snaps.select("k", "date").distinct().withColumn("c", F.row_number().over(Window.orderBy("date")))
    upto = snaps.select("date", "source", "target", "strength", "signed_weight").join(F.broadcast(dates.filter(F.col("c") >= s.min_snapshots).select("k", F.col("date").alias("as_of"))), F.col("date") <= F.col("as_of"))
    table = edges.stability(upto, s.threshold, keys=["k"])
    mask = store.keep(edges.stability_mask(table, every, every, s.stability["min_frequency"], s.stability["min_sign"], ["k"]))
    ready = mask.select("k").distinct().withColumn("ready", F.lit(True))
    names = F.array(*(F.lit(x) for x in every))
    allowed = mask.groupBy("k", F.col("target").alias("g")).agg(F.collect_set("source").alias("allowed"))
    rows = full.effects.join(F.broadcast(ready), "k", "left").join(F.broadcast(allowed), ["k", "g"], "left")
    kept = F.transform(F.arrays_zip(names.alias("s"), F.col("effects").alias("e")), lambda x: F.when(F.col("ready").isNull() | F.array_contains(F.coalesce("allowed", F.array().cast("array<string>")), x["s"]), x["e"]).otherwise(0.0))
    masked = W.forecast(rows.withColumn("effects", kept))
    predictions = {"ar": W.forecast(ar.effects), "financial_sparse_var": W.forecast(fin.effects), "full_sparse_var": W.forecast(full.effects), "stability_filtered_full": masked}
    return {"forecasts": joined(predictions, own), "snapshots": snaps, "stability": edges.stability(snaps, s.threshold)}


def run_v2(panel: DataFrame, financial: list[str], candidates: list[str], s: Settings, store: Store | None = None) -> dict[str, DataFrame]:
    """Several horizons: does realised edge value say which edges survive?"""
    store = store or Store()
    panel = store.keep(indexed(panel))
    every = financial + candidates
    outcome = store.keep(W.targets(panel, financial, s.spec.horizons))
    ar, fin, full = autoregression(panel, outcome, financial, s, store), direct(panel, outcome, financial, financial, s, store), direct(panel, outcome, every, financial, s, store)
    contributions = store.keep(leave_one_out(full, every, outcome, s.threshold))
    table, active = survival_history(full, contributions, s)
    table = store.keep(table)
    mask = edges.survival_mask(table, every, financial, keys=["h", "k"], **s.mask)
    mask = store.keep(mask)
    refit = W.masked_ridge(full.prefix.join(F.broadcast(active.select("h", "k")), ["h", "k"], "left_semi"), mask, every, s.spec.lags, financial, s.ridge)
    eff = W.effects(W.design(panel, every, s.spec.lags), refit, every, s.spec.lags, s.spec)
    survived = W.forecast(full.effects).join(W.forecast(eff).select("h", "i", "g", F.col("prediction").alias("p2")), ["h", "i", "g"], "left").withColumn("prediction", F.coalesce("p2", "prediction"))
    predictions = {"ar": W.forecast(ar.effects), "financial_direct_sparse": W.forecast(fin.effects), "full_direct_sparse": W.forecast(full.effects), "survival_refit_full": survived}
    return {"forecasts": joined(predictions, outcome), "snapshots": full.snapshots, "contributions": contributions, "survival": table}


def run_v3(panel: DataFrame, financial: list[str], candidates: list[str], s: Settings, store: Store | None = None) -> dict[str, DataFrame]:
    """Can candidates explain what the protected core's out-of-sample forecasts leave?"""
    store, spec = store or Store(), s.spec
    panel = store.keep(indexed(panel))
    outcome = store.keep(W.targets(panel, financial, spec.horizons))
    ar, core = autoregression(panel, outcome, financial, s, store), direct(panel, outcome, financial, financial, s, store)
    core_f = store.keep(W.forecast(core.effects))
    residuals = core_f.join(outcome, ["h", "i", "g"]).select("h", "i", "k", "g", (F.col("y") - F.col("prediction")).alias("y"), "date", "realized_date")
    residuals = store.keep(residuals)
    over = direct(panel, residuals.select("h", "i", "g", "y"), candidates, financial, s, store, s.overlay_alpha, centre=False, least=s.overlay_min_train)
    contributions = store.keep(add_one(over, candidates, residuals, s.threshold))
    table, active = survival_history(over, contributions, s)
    table = store.keep(table)
    mask = edges.survival_mask(table, candidates, financial, keys=["h", "k"], **s.mask)
    mask = store.keep(mask)
    usable = over.models.select("h", "k").distinct().join(F.broadcast(active.select("h", "k")), ["h", "k"], "left_semi")
    refit = W.masked_ridge(over.prefix.join(F.broadcast(usable), ["h", "k"], "left_semi"), mask, candidates, spec.lags, financial, s.ridge, centre=False)
    eff = W.effects(W.design(panel, candidates, spec.lags), refit, candidates, spec.lags, spec)
    rows = core_f.join(W.forecast(over.effects).select("h", "i", "g", F.col("prediction").alias("sparse")), ["h", "i", "g"], "left")
    rows = rows.join(W.forecast(eff).select("h", "i", "g", F.col("prediction").alias("lasting")), ["h", "i", "g"], "left").fillna(0.0, ["sparse", "lasting"])
    # Without an active survival model the overlay is zero.
    rows = store.keep(rows.join(residuals.select("h", "i", "g", F.col("y").alias("r"), "realized_date"), ["h", "i", "g"], "left"))
    r, o = F.col("r"), F.col("lasting")
    realised = rows.filter("r is not null").select("h", "realized_date", F.col("g").alias("target"), (r * r - (r - o) * (r - o)).alias("loss_improvement"))
    dates = refit_dates(panel, spec).select("k", F.col("date").alias("as_of"))
    asked = core_f.select("h", "k").distinct().join(F.broadcast(dates), "k")
    gate = store.keep(edges.gates(realised, asked.select("h", "as_of"), financial, keys=["h"], **s.gate).join(F.broadcast(dates), "as_of"))
    rows = rows.join(F.broadcast(gate.select("h", "k", F.col("target").alias("g"), "gate")), ["h", "k", "g"], "left")
    one = lambda c: rows.select("h", "i", "g", c.alias("prediction"))
    base = F.col("prediction")
    predictions = {
        "ar": W.forecast(ar.effects), "financial_direct_sparse": core_f, "candidate_overlay_sparse": one(base + F.col("sparse")), "candidate_overlay_survival": one(base + F.col("lasting")),
        "candidate_overlay_adaptive": one(base + F.col("lasting") * F.coalesce("gate", F.lit(0.0))),
    }
    return {"forecasts": joined(predictions, outcome), "snapshots": over.snapshots, "contributions": contributions, "model_contributions": realised, "survival": table, "gates": gate, "residuals": residuals}


def run_v4(forecasts: DataFrame, names: list[str], share: float = 1.0 / 252, window: int = 252, clip: float = 5.0) -> dict[str, DataFrame]:
    """Online trust between experts: forecasts with online_fixed_share added, and the weights."""
    out = experts.fixed_share(forecasts, names, [share], window, clip)
    more = out.select("horizon", F.lit("online_fixed_share").alias("model"), "date", "target", "actual", "prediction")
    return {"forecasts": forecasts.unionByName(more), "weights": experts.weights_long(out, names)}


def rolling_edges(panel: DataFrame, series: list[str], window: int, step: int, lags: int, alpha: float, store: Store | None = None) -> DataFrame:
    """Edge snapshots of fixed windows of `window` rows, every `step` rows; a row goes to the windows that hold it."""
    store = store or Store()
    panel = store.keep(indexed(panel))
    n_z = lags * len(series)
    spec = Window_(lags, window, step, (1,))
    outcome = W.targets(panel, series, (1,)).join(W.design(panel, series, lags), "i")
    # A window has rows [e - window, e), so its training rows are [e - window + lags, e).
    ends = panel.agg((F.max("i") + 1).alias("n")).select(F.explode(F.sequence(F.lit(window), F.col("n"), F.lit(step))).alias("e"))
    held = outcome.join(F.broadcast(ends), (F.col("i") < F.col("e")) & (F.col("i") >= F.col("e") - window + lags))
    one = held.withColumn("h", F.col("e").cast("int"))  # a window takes the place of a horizon: one prefix of its own
    whole = Window_(lags, 1 << 30, 1, (1,))
    models = W.solve(W.prefixes(one.select("h", "i", "z", "g", "y"), n_z, series, whole), n_z, series, W.lasso_fit(alpha))
    dates = panel.select((F.col("i") + 1).alias("h"), "date").distinct()
    snaps = W.adjacency(W.coefficients(models, series)).join(dates.withColumn("h", F.col("h").cast("int")), "h")
    return snaps.select("date", "source", "target", "strength", "signed_weight")
