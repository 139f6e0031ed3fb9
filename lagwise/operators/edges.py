"""Directed edges between series: stability, survival, masks and gates.

Snapshots: date, source, target, strength, signed_weight. Contributions: realized_date, source,
target, loss_improvement. Keys (a horizon, say) may stand before source and target.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagwise.operators.panel import require
from lagwise.operators.transforms import days

EDGE = ["source", "target"]
#: Relative variance below which differences are rounding.
FLAT = 1e-18


def stability(snapshots: DataFrame, threshold: float, recent: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Per edge: selection_frequency, mean_strength, latest_strength, sign_stability (null if never selected).

    recent: only the last so many dates.
    """
    require(snapshots, "date", *EDGE, "strength", "signed_weight")
    keys = keys or []
    if recent is not None:
        dates = snapshots.select(*keys, "date").distinct()
        w = Window.partitionBy(*keys).orderBy(F.desc("date")) if keys else Window.partitionBy(F.lit(1)).orderBy(F.desc("date"))
        kept = dates.withColumn("__r", F.dense_rank().over(w)).filter(F.col("__r") <= recent).drop("__r")
        snapshots = snapshots.join(kept, [*keys, "date"], "left_semi")
    sel = F.col("strength") >= threshold
    up, down, n = (F.count_if(sel & (F.col("signed_weight") > 0)), F.count_if(sel & (F.col("signed_weight") < 0)), F.count_if(sel))
    return snapshots.groupBy(*keys, *EDGE).agg(
        F.avg(sel.cast("double")).alias("selection_frequency"), F.avg("strength").alias("mean_strength"), F.max_by("strength", "date").alias("latest_strength"), F.when(n > 0, F.greatest(up, down) / n).alias("sign_stability")
    )


HISTORY = "n_snapshots long, selection_frequency double, sign_stability double, weighted_strength double, latest_strength double, n long, mean double, hit_rate double, t_stat double, no_variance boolean"


class _Recent:
    """Sums with recency weights of one group's events, brought forward from date to date."""

    def __init__(self, half_lives: tuple[float, float]):
        self.rates = [np.log(2.0) / max(h, 1e-9) for h in half_lives]
        self.at, self.seen, self.latest, self.base = None, [0, 0], None, 0.0
        # Weight, selected, up, down, strength; then weight, its square, value and square from base, hits.
        self.shape, self.value = np.zeros(5), np.zeros(5)

    def forward(self, at: float) -> None:
        if self.at is not None and at > self.at:
            f, g = (np.exp(-r * (at - self.at)) for r in self.rates)
            self.shape *= f
            self.value *= np.array([g, g * g, g, g, g])
        self.at = at if self.at is None else max(self.at, at)

    def snapshot(self, strength: float, signed: float, threshold: float) -> None:
        self.seen[0] += 1
        self.latest = strength
        if strength == strength:
            sel = strength >= threshold
            self.shape += (1, sel, sel and signed > 0, sel and signed < 0, strength)

    def outcome(self, v: float) -> None:
        if not self.seen[1]:
            self.base = v
        self.seen[1] += 1
        d = v - self.base
        self.value += (1, 1, d, d * d, v > 0)

    def row(self) -> tuple:
        w, sel, up, down, strength = self.shape.tolist()
        first = (self.seen[0], sel / w if w else None, max(up, down) / sel if sel else None, strength / w if w else None, self.latest)
        v, v2, d, dd, hits = self.value.tolist()
        if not v:
            return (*first, self.seen[1], None, None, None, None)
        mean, var, n_eff = self.base + d / v, max(dd / v - (d / v) ** 2, 0.0), v * v / v2
        flat = var <= FLAT * mean * mean
        t = None if self.seen[1] < 2 else 0.0 if flat or n_eff <= 1 else mean / np.sqrt(var / n_eff)
        return (*first, self.seen[1], mean, hits / v, t, flat)


def history(snapshots: DataFrame | None, outcomes: DataFrame, asked: DataFrame, by: list[str], threshold: float, structural_half_life: float, contribution_half_life: float) -> DataFrame:
    """(by..., as_of, HISTORY) for each of asked (by..., as_of): what its group had by then.

    Snapshots count up to the date, outcomes before it. All three meet in one exchange, sorted by
    group and date, and a task streams along it with one group's sums, so the work is linear in
    rows and dates asked for, however long the history is.
    """
    one = lambda df, date, side, strength, signed, v: df.select(*by, F.col(date).alias("__d"), F.lit(side).alias("__side"), days(F.col(date)).alias("__at"), strength.cast("double").alias("__s"), signed.cast("double").alias("__g"), v.cast("double").alias("__v"))
    none = F.lit(None)
    rows = one(asked, "as_of", 1, none, none, none).unionByName(one(outcomes.filter("loss_improvement is not null"), "realized_date", 2, none, none, F.col("loss_improvement")))
    if snapshots is not None:
        rows = rows.unionByName(one(snapshots, "date", 0, F.col("strength"), F.col("signed_weight"), none))
    kind = dict(asked.dtypes)
    dealt = rows.repartition(*by).sortWithinPartitions(*by, "__at", "__side", "__s", "__v")

    def fold(parts):
        now, state = None, None
        for part in parts:
            own, out = list(zip(*(part[c] for c in by), strict=True)) if len(part) else [], []
            for key, d, side, at, s, g, v in zip(own, part["__d"], part["__side"], part["__at"], part["__s"], part["__g"], part["__v"], strict=True):
                if key != now:
                    now, state = key, _Recent((structural_half_life, contribution_half_life))
                state.forward(at)
                if side == 0:
                    state.snapshot(s, g, threshold)
                elif side == 2:
                    state.outcome(v)
                else:
                    out.append((*key, d, *state.row()))
            yield pd.DataFrame(out, columns=[*by, "as_of", *(x.split()[0] for x in HISTORY.split(", "))]).astype({"n_snapshots": "int64", "n": "int64"})

    return dealt.mapInPandas(fold, ", ".join([*(f"`{c}` {kind[c]}" for c in by), f"as_of {kind['as_of']}", HISTORY]))


def survival(snapshots: DataFrame, contributions: DataFrame, as_of: DataFrame, threshold: float = 0.05, structural_half_life: float = 180.0, contribution_half_life: float = 120.0, keys: list[str] | None = None) -> DataFrame:
    """Edge survival as of each date: structure (seen up to the date) times predictive value (realised before it).

    as_of: (keys..., as_of), one row a date of interest. Edges with no snapshot yet have no row.
    """
    keys = keys or []
    require(snapshots, "date", *EDGE, "strength", "signed_weight")
    require(contributions, "realized_date", *EDGE, "loss_improvement")
    by = [*keys, *EDGE]
    dates = as_of.select(*keys, "as_of").distinct()
    asked = snapshots.select(*by).distinct().join(dates, keys) if keys else snapshots.select(*by).distinct().crossJoin(dates)
    own = contributions.join(snapshots.select(*by).distinct(), by, "left_semi")
    got = history(snapshots, own, asked, by, threshold, structural_half_life, contribution_half_life).filter("n_snapshots > 0")
    retention = F.when(F.col("weighted_strength") > 1e-12, F.col("latest_strength") / F.col("weighted_strength")).otherwise(0.0)
    out = got.select(
        *keys, "as_of", *EDGE, "n_snapshots", "selection_frequency", "sign_stability", "weighted_strength", "latest_strength", retention.alias("strength_retention"),
        F.col("n").alias("n_contributions"), F.col("mean").alias("weighted_mean_loss_improvement"), F.col("hit_rate").alias("contribution_hit_rate"), F.col("t_stat").alias("contribution_t_stat"),
    )
    t = F.col("contribution_t_stat")
    structural = F.greatest("selection_frequency", F.lit(0.0)) * F.greatest(F.coalesce("sign_stability", F.lit(0.0)), F.lit(0.0)) * F.least(F.greatest("strength_retention", F.lit(0.0)), F.lit(1.0))
    return out.withColumns({"structural_score": structural, "predictive_score": F.when(t > 0, F.tanh(t / 2)).otherwise(0.0)}).withColumn("survival_score", F.col("structural_score") * F.col("predictive_score"))


def survival_mask(
    table: DataFrame, sources: list[str], targets: list[str], min_frequency: float = 0.5, min_sign: float = 0.6, min_retention: float = 0.25, min_contributions: int = 20, min_mean: float = 0.0, max_edges: int | None = None, keys: list[str] | None = None
) -> DataFrame:
    """(keys..., source, target) of the edges that may be used: those that pass all five bars, the best of each target, and self-edges."""
    keys = keys or []
    known = F.col("source").isin(sources) & F.col("target").isin(targets)
    passed = table.filter(known).filter(
        (F.col("selection_frequency") >= min_frequency) & (F.coalesce("sign_stability", F.lit(0.0)) >= min_sign) & (F.col("strength_retention") >= min_retention) & (F.col("n_contributions") >= min_contributions)
        & (F.coalesce("weighted_mean_loss_improvement", F.lit(float("-inf"))) > min_mean)
    )
    if max_edges is not None:
        w = Window.partitionBy(*keys, "target").orderBy(F.desc("survival_score"), "source")
        passed = passed.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= max_edges)
    return _with_self(passed.select(*keys, *EDGE), table, sources, targets, keys)


def _with_self(passed: DataFrame, table: DataFrame, sources: list[str], targets: list[str], keys: list[str]) -> DataFrame:
    own = [t for t in targets if t in sources]
    if not own:
        return passed
    base = table.select(*keys).distinct() if keys else table.sparkSession.range(1).select()
    loops = base.withColumn("source", F.explode(F.array(*(F.lit(t) for t in own)))).withColumn("target", F.col("source"))
    return passed.unionByName(loops).distinct()


def stability_mask(table: DataFrame, sources: list[str], targets: list[str], min_frequency: float = 0.6, min_sign: float = 0.75, keys: list[str] | None = None) -> DataFrame:
    """Edges selected often enough with one sign, and self-edges."""
    passed = table.filter((F.col("selection_frequency") >= min_frequency) & (F.coalesce("sign_stability", F.lit(0.0)) >= min_sign))
    return _with_self(passed.filter(F.col("source").isin(sources) & F.col("target").isin(targets)).select(*(keys or []), *EDGE), table, sources, targets, keys or [])


def gates(contributions: DataFrame, as_of: DataFrame, targets: list[str], half_life: float = 120.0, min_observations: int = 30, t_scale: float = 2.0, keys: list[str] | None = None) -> DataFrame:
    """A gate in [0, 1] for every target as of each date: tanh(t / t_scale) of realised improvement, else 0.

    Without variance the t-statistic says nothing: then the gate is 1 for a positive mean, else 0.
    """
    keys = keys or []
    require(contributions, "realized_date", "target", "loss_improvement")
    spine = as_of.select(*keys, "as_of").distinct().withColumn("target", F.explode(F.array(*(F.lit(t) for t in targets))))
    got = history(None, contributions.filter(F.col("target").isin(targets)), spine, [*keys, "target"], 0.0, half_life, half_life)
    got = got.withColumnsRenamed({"hit_rate": "contribution_hit_rate", "t_stat": "contribution_t_stat"})
    t, ready = F.col("contribution_t_stat"), (F.col("n") >= min_observations) & (F.col("mean") > 0)
    gate = F.when(ready & F.col("no_variance"), F.lit(1.0)).when(ready & (t > 0), F.tanh(t / F.lit(max(float(t_scale), 1e-9)))).otherwise(0.0)
    return got.select(*keys, "as_of", "target", "n", F.col("mean").alias("weighted_mean_loss_improvement"), "contribution_hit_rate", "contribution_t_stat", gate.alias("gate"))
