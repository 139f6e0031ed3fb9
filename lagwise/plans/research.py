"""From configurations to inputs, experiments and evidence."""

from __future__ import annotations

from dataclasses import dataclass, replace

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.operators import experts, inference, metrics, panel
from lagwise.operators.features import feature_panel
from lagwise.operators.walkforward import Window_
from lagwise.plans import experiments as E
from lagwise.plans import reports
from lagwise.sources.series import SeriesClient, universe

ALL, HOLDOUT = "oos_all", "final_holdout"
RUNS = {"v1": E.run_v1, "v2": E.run_v2, "v3": E.run_v3}
CORE = {"v1": "financial_sparse_var", "v2": "financial_direct_sparse", "v3": "financial_direct_sparse", "v4": "financial_direct_sparse"}
#: Comparisons of an experiment whose configuration names none.
COMPARISONS = {
    "v1": [("ar", "financial_sparse_var"), ("financial_sparse_var", "full_sparse_var"), ("financial_sparse_var", "stability_filtered_full")],
    "v2": [("ar", "financial_direct_sparse"), ("financial_direct_sparse", "full_direct_sparse"), ("full_direct_sparse", "survival_refit_full")],
    "v3": [("financial_direct_sparse", "candidate_overlay_sparse"), ("financial_direct_sparse", "candidate_overlay_survival"), ("financial_direct_sparse", "candidate_overlay_adaptive")],
    "v4": [("financial_direct_sparse", "online_fixed_share"), ("candidate_overlay_survival", "online_fixed_share")],
}
EXPERTS = ["financial_direct_sparse", "candidate_overlay_survival", "candidate_overlay_adaptive"]
SHARES = [0.0, 1.0 / 1260, 1.0 / 252, 1.0 / 63]


def config(path: str | None) -> dict:
    if path is None:
        return {}
    with open(path, encoding="utf-8") as f:  # a small file on the driver
        return yaml.safe_load(f) or {}


def financial_ids(cfg: dict, source: str = "FRED") -> list[str]:
    return [n["id"] for n in cfg.get("financial", []) if n.get("source") == source]


def settings(cfg: dict, base: E.Settings | None = None) -> E.Settings:
    """The settings that a configuration's sections name; the others stay as in base."""
    s = base or E.Settings()
    model, survival, overlay, gate = (cfg.get(k, {}) for k in ("model", "survival", "overlay", "adaptive_gate"))
    pick = lambda section, **names: {k: section[v] for k, v in names.items() if v in section}
    spec = pick(model, lags="lags", min_train="min_train", refit_every="refit_every") | ({"horizons": tuple(cfg["horizons"])} if "horizons" in cfg else {})
    mask = pick(survival, min_frequency="min_selection_frequency", min_sign="min_sign_stability", min_retention="min_strength_retention", min_contributions="min_contributions", max_edges="max_edges_per_target")
    flat = pick(model, alpha="alpha", ridge="ar_alpha") | pick(overlay, overlay_alpha="alpha", overlay_min_train="min_oos_residuals")
    flat |= pick(survival, threshold="edge_threshold", structural_half_life="structural_half_life_days", contribution_half_life="contribution_half_life_days", min_snapshots="min_survival_snapshots")
    return replace(s, spec=replace(s.spec, **spec), mask=s.mask | mask, gate=s.gate | pick(gate, half_life="half_life_days", min_observations="min_observations", t_scale="t_scale"), **flat)


@dataclass
class Inputs:
    """Everything that a joined panel is made of."""

    panel: DataFrame
    financial: DataFrame
    financial_metadata: DataFrame
    physical_raw: DataFrame
    physical_features: DataFrame
    physical_releases: DataFrame
    names: list[str]

    def tables(self) -> dict[str, DataFrame]:
        return {k: v for k, v in vars(self).items() if isinstance(v, DataFrame)}


def releases_of(features: DataFrame, lag_days: int, source: str, transform: str) -> DataFrame:
    """Long features (date, feature, value) as a release log."""
    if lag_days < 0:
        raise ValueError("the availability lag must be 0 or more")
    known = features.filter("value is not null")
    return known.select(
        F.col("date").alias("observation_time"), F.date_add("date", lag_days).alias("available_at"), "feature", "value", F.lit(source).alias("source"), F.lit("daily").alias("frequency"), F.lit(transform).alias("transform")
    )


def inputs(client: SeriesClient, financial_cfg: dict, physical_cfg: dict, raw: DataFrame, start: str | None = None, end: str | None = None, lag_days: int | None = None) -> Inputs:
    """The configured series, the physical facts (date, portname, metrics), their features, and the panel of both."""
    finance, metadata = universe(client, financial_cfg["financial"], start, end, source="FRED")
    options = physical_cfg.get("features", {})
    names = {"smooth_days": "smooth_days", "baseline_days": "baseline_days", "min_periods": "min_periods", "seasonal_lag": "seasonal_lag_days"}
    method = options.get("method", "rolling")
    features = feature_panel(raw, physical_cfg.get("metrics", ["capacity", "n_total"]), method, **{k: int(options[v]) for k, v in names.items() if v in options})
    lag = int(physical_cfg.get("availability_lag_days", 10)) if lag_days is None else lag_days
    releases = releases_of(features, lag, physical_cfg.get("source", "physical"), method)
    columns = sorted(r["feature"] for r in features.select("feature").distinct().limit(10_000).collect())
    return Inputs(panel.public_panel(finance, releases, columns), finance, metadata, raw, features, releases, columns)


def long_panel(wide: DataFrame) -> DataFrame:
    """The complete rows of a wide panel as (date, series, x)."""
    names = [c for c in wide.columns if c != "date"]
    return panel.complete(wide).unpivot(["date"], names, "series", "x")


def run(version: str, panel_rows: DataFrame, financial: list[str], candidates: list[str], cfg: dict) -> dict[str, DataFrame]:
    s = settings(cfg)
    if version == "v1":
        s = replace(s, spec=replace(s.spec, horizons=(1,)))
    return RUNS[version](panel_rows, financial, candidates, s)


def run_v4(forecasts: DataFrame, cfg: dict, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Fixed-Share over an earlier run's forecasts, with the losses it learns from and the share grid."""
    online = cfg.get("online", {})
    names = names or online.get("experts", EXPERTS)
    share, window, clip = float(online.get("share", 1.0 / 252)), int(online.get("scale_window", 252)), float(online.get("loss_clip", 5.0))
    out = E.run_v4(forecasts, names, share, window, clip)
    rows = experts.complete_rows(forecasts, names)
    losses = experts.bounded_losses(rows, names, window, clip).select("horizon", "target", "date", F.posexplode("bounded").alias("k", "loss"))
    out["losses"] = losses.withColumn("expert", F.element_at(F.array(*(F.lit(e) for e in names)), F.col("k") + 1)).drop("k")
    grid = experts.fixed_share(forecasts, names, [float(x) for x in online.get("share_grid", SHARES)], window, clip)
    scored = metrics.metrics(grid.withColumnRenamed("target", "variable"), ["share", "horizon", "variable"]).select("share", "horizon", "variable", "rmse")
    core = metrics.metrics(forecasts.filter(F.col("model") == names[0]).withColumnRenamed("target", "variable"), ["horizon", "variable"]).select("horizon", "variable", F.col("rmse").alias("core_rmse"))
    skill = 1 - F.try_divide(F.col("rmse"), F.col("core_rmse"))
    out["share_sensitivity"] = scored.join(core, ["horizon", "variable"]).groupBy("share", "horizon").agg(F.avg(skill).alias("mean_skill"), F.count_if(skill > 0).alias("n_better"), F.count(skill).alias("n_targets"))
    return out


def evidence(version: str, out: dict[str, DataFrame], cfg: dict, panel_rows: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of an experiment's evidence, and its report.

    Metrics by segment, tests under false-discovery control in their order, their counts, the audit
    of the panel, stability, and the strongest edges, gates or weights.
    """
    dates = cfg.get("evaluation", {})
    first = dates.get("final_holdout_start") or dates.get("reused_evaluation_start")
    segments = {ALL: (None, None)} | ({HOLDOUT: (str(first), None)} if first else {}) | ({"development": (None, str(dates["development_end"]))} if "development_end" in dates else {})
    rows = metrics.segmented(out["forecasts"].withColumnRenamed("target", "variable"), segments)
    scored = metrics.skill_against(metrics.metrics(rows, ["segment", "horizon", "model", "variable"]), "ar", ["segment", "horizon", "variable"])
    test = cfg.get("forecast_test", {})
    pairs = [tuple(c) for c in test.get("comparisons", COMPARISONS[version])]
    start = None if not first else str(first)
    horizons = [1] if version == "v1" else list(cfg.get("horizons", [])) or None
    tests = inference.nested_tests(out["forecasts"], pairs, int(test.get("base_hac_lags", 5)), float(test.get("fdr_q", 0.10)), horizons, start=start)
    shown = metrics.preferred_segment(scored, HOLDOUT, ALL)
    tables = dict(out) | {"metrics": scored, "tests": inference.ordered(tests), "test_counts": inference.comparison_summary(tests), "skills": reports.skill_table(shown, sorted({m for c in pairs for m in c})), "skill_summary": metrics.skill_summary(shown, CORE[version], ["horizon"])}
    if panel_rows is not None:
        tables |= {"audit": panel.audit(panel_rows, "series", "x"), "panel_summary": panel.summary(panel_rows, "date", "series", "x")}
    more: dict[str, DataFrame] = {}
    if "stability" in out:
        more["Stable edges"] = metrics.top(out["stability"].filter("source != target"), 15, [F.desc("selection_frequency"), F.desc("sign_stability"), F.desc("mean_strength"), "source", "target"])
    if "survival" in out:
        last = metrics.latest(out["survival"], ["h"], "as_of")
        more["Surviving edges"] = metrics.top(last.select("h", "source", "target", "survival_score", "selection_frequency"), 15, [F.desc("survival_score"), F.desc("selection_frequency"), "h", "source", "target"])
    if "gates" in out:
        more["Gates"] = metrics.top(metrics.latest(out["gates"], ["h"], "as_of").select("h", "target", "gate", "n"), 15, [F.desc("gate"), "h", "target"])
    if "weights" in out:
        tables["latest_weights"] = metrics.latest(out["weights"], ["share", "horizon", "target"])
        more["Largest weights beside the core"] = largest_weights(tables["latest_weights"], CORE[version])
    if "share_sensitivity" in out:
        more["Shares"] = out["share_sensitivity"].orderBy("horizon", "share")
    return tables, reports.markdown(shown, tests, title=f"Experiment {version}", more={"Mean skill": tables["skill_summary"].orderBy("horizon", "model")} | more)


def largest_weights(latest: DataFrame, core: str, n: int = 8) -> DataFrame:
    """The n largest weights of experts other than the core."""
    return metrics.top(latest.filter(F.col("expert") != core).select("horizon", "target", "expert", "weight"), n, [F.desc("weight"), "horizon", "target", "expert"])


def lag_sensitivity(found: Inputs, lags: list[int], financial: list[str], cfg: dict) -> DataFrame:
    """v1 anew under each availability lag: skill of the full against the financial model, and discoveries."""
    rows = None
    for lag in lags:
        releases = found.physical_releases.withColumn("available_at", F.date_add("observation_time", int(lag)))
        joined = panel.public_panel(found.financial, releases, found.names)
        tables, _ = evidence("v1", run("v1", long_panel(joined), financial, found.names, cfg), cfg)
        rmse = lambda m: F.max(F.when(F.col("model") == m, F.col("rmse")))
        skills = metrics.preferred_segment(tables["metrics"], HOLDOUT, ALL).groupBy("variable").agg((1 - F.try_divide(rmse("full_sparse_var"), rmse("financial_sparse_var"))).alias("skill"))
        tests = tables["tests"].groupBy(F.col("target").alias("variable")).agg(F.count_if(F.col("fdr_reject") & F.col("challenger_better")).alias("n_fdr"))
        one = skills.join(tests, "variable", "left").agg(
            F.avg("skill").alias("mean_skill"), F.median("skill").alias("median_skill"), F.count_if(F.col("skill") > 0).alias("n_better"), F.count("skill").alias("n_targets"), F.coalesce(F.sum("n_fdr"), F.lit(0)).alias("n_fdr_better")
        )
        one = one.select(F.lit(int(lag)).alias("availability_lag_days"), "*")
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise ValueError("no availability lags")
    return rows


# Settings of the demonstrations, as fixed values.


def demo(spark: SparkSession, kind: str = "demo") -> dict[str, DataFrame]:
    """A seeded demonstration's tables: demo, survival-demo, overlay-demo or online-demo."""
    from lagwise.functions import synthetic

    if kind == "demo":
        s = E.Settings(spec=Window_(3, 500, 20, (1,)), alpha=0.035, threshold=0.05)
        return E.run_v1(synthetic.regime_system(spark), list(synthetic.SERIES), [], s)
    if kind == "survival-demo":
        mask = {"min_frequency": 0.5, "min_sign": 0.6, "min_retention": 0.3, "min_contributions": 20, "max_edges": 4}
        s = E.Settings(spec=Window_(3, 300, 20, (1,)), alpha=0.03, threshold=0.05, min_snapshots=4, structural_half_life=180.0, contribution_half_life=90.0, mask=mask)
        return E.run_v2(synthetic.dying_edge(spark), ["x", "y"], ["noise"], s)
    if kind == "overlay-demo":
        mask = {"min_frequency": 0.3, "min_sign": 0.5, "min_retention": 0.2, "min_contributions": 10, "max_edges": 1}
        gate = {"half_life": 70.0, "min_observations": 20, "t_scale": 2.0}
        s = E.Settings(spec=Window_(2, 260, 10, (1,)), alpha=0.03, overlay_alpha=0.03, overlay_min_train=80, threshold=0.02, min_snapshots=3, structural_half_life=100.0, contribution_half_life=70.0, mask=mask, gate=gate)
        return E.run_v3(synthetic.dying_candidate(spark), ["financial_x", "target"], ["candidate"], s)
    return E.run_v4(synthetic.breaking_expert(spark), ["financial_core", "candidate_overlay"])
