"""Demonstrations against their published figures, command line, evidence, streams and recency sums."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lagwise import cli
from lagwise.functions.names import resolve
from lagwise.operators import edges, metrics, panel
from lagwise.operators.transforms import decay
from lagwise.plans import reports, research
from lagwise.sources import sinks
from lagwise.streaming import online

RNG = np.random.default_rng(4)
DAY = dt.date(2024, 1, 1)


def rmse_of(forecasts, target):
    rows = metrics.metrics(forecasts.filter(F.col("target") == target), ["model"]).collect()
    return {r.model: r.rmse for r in rows}


def test_overlay_demonstration_meets_its_figures(spark):
    out = research.demo(spark, "overlay-demo")
    got = rmse_of(out["forecasts"], "target")
    want = {"candidate_overlay_adaptive": 0.58343, "candidate_overlay_survival": 0.59185, "candidate_overlay_sparse": 0.63203, "financial_direct_sparse": 0.66733, "ar": 0.82300}
    assert {m: round(got[m], 4) for m in want} == {m: pytest.approx(v, abs=2e-4) for m, v in want.items()}


def test_survival_demonstration_sees_the_edge_die(spark):
    out = research.demo(spark, "survival-demo")
    last = metrics.latest(out["survival"].filter("source = 'x' and target = 'y'"), ["h"], "as_of").first()
    assert last.selection_frequency == pytest.approx(1.0) and last.survival_score == pytest.approx(0.0)
    tables, report = research.evidence("v2", out, {"evaluation": {"final_holdout_start": dt.date(2022, 6, 1)}, "horizons": [1]})
    lines = [r.line for r in report.orderBy("line_no").collect()]
    assert "## Surviving edges" in lines and {r.segment for r in tables["metrics"].select("segment").distinct().collect()} == {"oos_all", "final_holdout"}
    order = [(r.comparison, not r.fdr_reject, -r.mean_loss_improvement) for r in tables["tests"].collect()]
    assert order == sorted(order) and order


def test_online_demonstration_and_its_evidence(spark, tmp_path):
    out = research.demo(spark, "online-demo")
    w = {(str(r.date), r.expert): r.weight for r in out["weights"].collect()}
    days = sorted({d for d, _ in w})
    assert w[days[400], "candidate_overlay"] > 0.9 and w[days[-1], "financial_core"] > 0.8
    base = out["forecasts"].filter("model != 'online_fixed_share'")
    more = research.run_v4(base, {"online": {"share_grid": [0.0, 0.01]}}, ["financial_core", "candidate_overlay"])
    assert {r.share for r in more["share_sensitivity"].collect()} == {0.0, 0.01}
    assert more["losses"].agg(F.min("loss"), F.max("loss")).first()[0] >= 0
    paths = sinks.evidence({"weights": more["weights"], "raw": out["forecasts"].withColumn("list", F.array("actual"))}, f"{tmp_path}/e", form="csv")
    assert spark.read.option("header", True).csv(paths[1]).count() == out["forecasts"].count()
    top = research.largest_weights(metrics.latest(more["weights"], ["share", "horizon", "target"]), "financial_core").collect()
    assert [r.expert for r in top] == ["candidate_overlay"]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("pilot")
    days = [DAY + dt.timedelta(days=i) for i in range(260)]
    for name in ("AA", "BB"):
        level = 100 + np.cumsum(RNG.normal(0, 1, len(days)))
        (root / f"{name}.csv").write_text("DATE," + name + "\n" + "\n".join(f"{d},{'.' if i == 7 else round(float(v), 4)}" for i, (d, v) in enumerate(zip(days, level, strict=True))))
    (root / "raw.csv").write_text("date,portname,capacity,n_total\n" + "\n".join(f"{d},Port é {p},{50 + 10 * p + i % 7},{5 + i % 5 + p}" for i, d in enumerate(days) for p in (1, 2)))
    (root / "series.yaml").write_text("financial:\n" + "".join(f"  - {{id: {i}, source: FRED, series_id: {s}, transform: log_return, family: fx, role: target}}\n" for i, s in (("aa", "AA"), ("bb", "BB"))))
    (root / "physical.yaml").write_text("source: ports\navailability_lag_days: 3\navailability_lag_sensitivity_days: [3, 5]\nmetrics: [capacity]\nfeatures: {method: rolling, smooth_days: 3, baseline_days: 40, min_periods: 20}\n")
    (root / "run.yaml").write_text("model: {lags: 1, alpha: 0.03, min_train: 120, refit_every: 60}\nhorizons: [1]\nevaluation: {final_holdout_start: 2024-08-01}\nsurvival: {min_survival_snapshots: 2}\noverlay: {min_oos_residuals: 40}\nforecast_test: {base_hac_lags: 2}\n")
    return root


def test_pilots_from_files(spark, files, tmp_path):
    base = ["--financial-config", f"{files}/series.yaml", "--physical-config", f"{files}/physical.yaml", "--folder", str(files), "--raw", f"{files}/raw.csv"]
    finance = cli.main(["fred-pilot", *base, "--out", f"{tmp_path}/f"], spark)
    assert finance.columns == ["date", "aa", "bb"] and spark.read.parquet(f"{tmp_path}/f/metadata").count() == 2
    features = cli.main(["portwatch-pilot", *base, "--out", f"{tmp_path}/p"], spark)
    assert {r.feature for r in features.select("feature").distinct().collect()} == {"pw_port_e_1_capacity_z", "pw_port_e_2_capacity_z"}
    found = cli.main(["public-pilot", *base, "--out", f"{tmp_path}/d"], spark)
    assert set(found.columns) == {"date", "aa", "bb", "pw_port_e_1_capacity_z", "pw_port_e_2_capacity_z"}
    for name in ("panel", "financial", "financial_metadata", "physical_raw", "physical_features", "physical_releases"):
        assert spark.read.parquet(f"{tmp_path}/d/{name}").count() > 0, name


def test_research_and_experiments_from_files(spark, files, tmp_path):
    base = ["--financial-config", f"{files}/series.yaml", "--physical-config", f"{files}/physical.yaml", "--folder", str(files), "--raw", f"{files}/raw.csv", "--config", f"{files}/run.yaml"]
    got = cli.main(["public-research", *base, "--data-out", f"{tmp_path}/data", "--out", f"{tmp_path}/v1"], spark)
    assert {r.model for r in got.collect()} == {"ar", "financial_sparse_var", "full_sparse_var", "stability_filtered_full"}
    lags = spark.read.parquet(f"{tmp_path}/v1/availability_lag_sensitivity").collect()
    assert sorted(r.availability_lag_days for r in lags) == [3, 5] and all(r.n_targets == 2 for r in lags)
    for name in ("tests", "audit", "panel_summary", "skills", "stability"):
        assert spark.read.parquet(f"{tmp_path}/v1/{name}").count() > 0, name
    cli.main(["empirical-v3", *base, "--panel", f"{tmp_path}/data/panel", "--out", f"{tmp_path}/v3"], spark)
    out = cli.main(["empirical-v4", *base, "--forecasts", f"{tmp_path}/v3", "--out", f"{tmp_path}/v4"], spark)
    assert "online_fixed_share" in {r.model for r in out.collect()}
    text = [r.value for r in spark.read.text(f"{tmp_path}/v4/RESULTS").collect()]
    assert "## Largest weights beside the core" in text and "## Shares" in text
    assert {r.part for r in cli.main(["backend-info"], spark).collect()} >= {"spark", "lag design"}


def test_recency_sums_are_those_of_the_whole_history(spark):
    snaps = [(DAY + dt.timedelta(days=10 * k), s, t, float(RNG.random()), float(RNG.normal())) for k in range(8) for s in "ab" for t in "xy" if (k, s, t) != (0, "b", "y")]
    outs = [(DAY + dt.timedelta(days=int(d)), s, t, float(v)) for d, s, t, v in zip(RNG.integers(0, 90, 300), RNG.choice(list("ab"), 300), RNG.choice(list("xy"), 300), RNG.normal(0.1, 1, 300), strict=True)]
    outs += [(DAY + dt.timedelta(days=k), "c", "x", 0.2) for k in range(40)]
    snaps.append((DAY, "c", "x", 0.5, 0.5))
    asked = [(DAY + dt.timedelta(days=k),) for k in (0, 1, 10, 33, 90)]
    sdf = spark.createDataFrame([(1, *r) for r in snaps], "h int, date date, source string, target string, strength double, signed_weight double")
    odf = spark.createDataFrame([(1, *r) for r in outs], "h int, realized_date date, source string, target string, loss_improvement double")
    adf = spark.createDataFrame([(1, *r) for r in asked], "h int, as_of date")
    got = {(r.as_of, r.source, r.target): r for r in edges.survival(sdf, odf, adf, 0.3, 20.0, 15.0, ["h"]).collect()}
    n = 0
    for (a,) in asked:
        for s, t in {(s, t) for _, s, t, *_ in snaps}:
            own = [(0.5 ** ((a - d).days / 20), x, g, d) for d, p, q, x, g in snaps if (p, q) == (s, t) and d <= a]
            if not own:
                assert (a, s, t) not in got
                continue
            n += 1
            r, sel = got[a, s, t], [w for w, x, *_ in own if x >= 0.3]
            assert r.n_snapshots == len(own) and r.selection_frequency == pytest.approx(sum(sel) / sum(w for w, *_ in own))
            assert r.weighted_strength == pytest.approx(sum(w * x for w, x, *_ in own) / sum(w for w, *_ in own)) and r.latest_strength == max(own, key=lambda o: o[3])[1]
            if sel:
                up = sum(w for w, x, g, _ in own if x >= 0.3 and g > 0)
                down = sum(w for w, x, g, _ in own if x >= 0.3 and g < 0)
                assert r.sign_stability == pytest.approx(max(up, down) / sum(sel))
            vs = [(0.5 ** ((a - d).days / 15), v) for d, p, q, v in outs if (p, q) == (s, t) and d < a]
            assert r.n_contributions == len(vs)
            if len(vs) >= 2:
                w = sum(x for x, _ in vs)
                m = sum(x * v for x, v in vs) / w
                var, eff = sum(x * (v - m) ** 2 for x, v in vs) / w, w * w / sum(x * x for x, _ in vs)
                assert r.weighted_mean_loss_improvement == pytest.approx(m) and r.contribution_hit_rate == pytest.approx(sum(x for x, v in vs if v > 0) / w)
                assert r.contribution_t_stat == pytest.approx(0.0 if s == "c" else m / math.sqrt(var / eff))
    assert n > 15
    gate = edges.gates(odf, adf, ["x", "none"], min_observations=5, keys=["h"]).collect()
    assert len(gate) == 10 and all(r.n == 0 and r.gate == 0 for r in gate if r.target == "none")


def test_decay_counts_the_time_of_day(spark):
    df = spark.sql("select timestamp '2024-01-02 12:00:00' as a, timestamp '2024-01-01 00:00:00' as b, date '2024-01-03' as c")
    r = df.select(decay(F.col("a"), F.col("b"), 1.5).alias("x"), decay(F.col("c"), F.col("b"), 2.0).alias("y"), decay(F.col("b"), F.col("a"), 2.0).alias("z")).first()
    assert (r.x, r.y, r.z) == (pytest.approx(0.5), pytest.approx(0.5), 1.0)


def test_as_of_carries_over_units_of_the_calendar(spark):
    releases = [("f", DAY, 1.0), ("f", DAY + dt.timedelta(days=45), None), ("f", DAY + dt.timedelta(days=200), 3.0), ("g", DAY + dt.timedelta(days=100), 9.0)]
    times = [DAY + dt.timedelta(days=d) for d in (-5, 0, 40, 45, 46, 150, 200, 400)]
    df = spark.createDataFrame(releases, "feature string, available_at date, value double")
    for unit in ("day", "month", "year"):
        got = {(r.date, r.feature): r.value for r in panel.as_of(df, spark.createDataFrame([(t,) for t in times], "date date"), unit=unit).collect()}
        for t in times:
            for f in "fg":
                known = [(d, v) for x, d, v in releases if x == f and d <= t]
                assert got[t, f] == (max(known, key=lambda k: k[0])[1] if known else None), (unit, t, f)


def test_names_meet_without_a_product(spark):
    known = spark.createDataFrame([(x,) for x in ("Suez Canal", "Panama Canal", "Strait of Hormuz", "Bab el-Mandeb Strait", "Gibraltar Strait", "Xy")], "name string")
    asked = spark.createDataFrame([(x,) for x in ("SUEZ canal", "Suez", "Hormuz Strait", "Canal", "xyz", "nothing")], "name string")
    got = {r.requested: r for r in resolve(asked, known).collect()}
    assert (got["SUEZ canal"].how, got["SUEZ canal"].resolved) == ("exact", "Suez Canal")
    assert (got["Suez"].how, got["Suez"].resolved) == ("substring", "Suez Canal") and (got["xyz"].how, got["xyz"].resolved) == ("substring", "Xy")
    assert (got["Hormuz Strait"].how, got["Hormuz Strait"].resolved) == ("fuzzy", "Strait of Hormuz")
    assert got["Canal"].how is None and len(got["Canal"].suggestions) == 5 and set(got["Canal"].suggestions[:2]) == {"Suez Canal", "Panama Canal"}
    assert got["nothing"].resolved is None and len(got["nothing"].suggestions) == 5


def test_the_segment_is_chosen_for_the_table(spark):
    rows = [("m1", "all", 1), ("m1", "late", 2), ("m2", "all", 3)]
    df = spark.createDataFrame(rows, "model string, segment string, v int")
    assert [r.v for r in metrics.preferred_segment(df, "late").collect()] == [2]
    assert sorted(r.v for r in metrics.preferred_segment(df, "none").collect()) == [1, 3]


def test_tables_behind_plots(spark):
    m = spark.createDataFrame([Row(variable="x", model="a", horizon=1, rmse=2.0, rmse_skill_vs_ar=0.1), Row(variable="x", model="b", horizon=1, rmse=1.0, rmse_skill_vs_ar=0.3)])
    assert reports.skill_heatmap(m, ["a", "b"]).first()["b"] == 0.3 and reports.incremental_bar(m, "a", "b").first().skill == 0.5
    assert reports.skill_table(m, ["a", "b"]).first()["a"] == 0.1
    snaps = spark.createDataFrame([(DAY, "s", "t", 0.5, -0.5), (DAY + dt.timedelta(days=1), "s", "t", 0.6, 0.6), (DAY + dt.timedelta(days=1), "t", "t", 0.9, 0.9)], "date date, source string, target string, strength double, signed_weight double")
    assert [r.strength for r in reports.edge_lifecycle(snaps, "s", "t").collect()] == [0.5, 0.6] and [tuple(r)[:2] for r in reports.network(snaps).collect()] == [("s", "t")]
    gates = spark.createDataFrame([(1, DAY, "t", 0.4), (5, DAY, "t", 0.9)], "h int, as_of date, target string, gate double")
    assert reports.gate_lifecycle(gates, ["t"], 1).first()["t"] == 0.4
    weights = spark.createDataFrame([(DAY, "t", "e", 0.7), (DAY, "t", "f", 0.3)], "date date, target string, expert string, weight double")
    assert reports.weight_lifecycle(weights, "t", ["e", "f"]).first()["f"] == 0.3
    with pytest.raises(ValueError):
        reports.lines_of(spark.range(300))


def test_streams_give_the_batch_result(spark, tmp_path):
    ts = lambda d, h: dt.datetime(2024, 1, d, h)
    releases = [("f", ts(1, 3), ts(1, 0), 1.0), ("f", ts(1, 9), ts(1, 0), 2.0), ("f", ts(2, 1), ts(1, 0), 3.0), ("g", ts(1, 5), ts(1, 0), 7.0)]
    spark.createDataFrame(releases, "feature string, available_at timestamp, observation_time timestamp, value double").repartition(3).write.parquet(f"{tmp_path}/r")
    outcomes = [(ts(1, k), 1, m, "x", float(k), float(k) + e) for k in range(10) for m, e in (("a", 1.0), ("b", -2.0))]
    spark.createDataFrame(outcomes, "ts timestamp, horizon int, model string, target string, actual double, prediction double").write.parquet(f"{tmp_path}/o")

    def streamed(path, form, name):
        batch = spark.read.parquet(path)
        query = form(spark.readStream.schema(batch.schema).parquet(path)).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c-{name}").start()
        query.awaitTermination(120)
        rows = sorted(map(tuple, spark.table(name).collect()))
        assert rows == sorted(map(tuple, form(batch).collect()))
        return rows

    got = streamed(f"{tmp_path}/r", online.latest_releases, "releases")
    assert got == [(dt.date(2024, 1, 1), "f", 2.0), (dt.date(2024, 1, 1), "g", 7.0), (dt.date(2024, 1, 2), "f", 3.0)]
    assert [(r[2], r[4], r[5]) for r in streamed(f"{tmp_path}/o", online.running_losses, "losses")] == [("a", 10, 1.0), ("b", 10, 2.0)]
