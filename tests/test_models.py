import datetime as dt

import numpy as np
import pytest

from lagwise.functions.synthetic import regime_system
from lagwise.operators import solvers
from lagwise.operators import walkforward as W
from lagwise.plans import experiments as E

S = E.Settings(spec=W.Window_(2, 150, 40, (1, 3)), min_snapshots=2, overlay_min_train=40, mask={"min_frequency": 0.3, "min_sign": 0.5, "min_retention": 0.1, "min_contributions": 10, "max_edges": 2})


def panel(spark, n=320, seed=4, change=None):
    rng = np.random.default_rng(seed)
    x = np.zeros((n, 3))
    for t in range(1, n):
        x[t] = [0.7 * x[t - 1, 1] + rng.normal(0, 0.4), 0.2 * x[t - 1, 1] + rng.normal(), 0.5 * x[t - 1, 2] + rng.normal()]
    if change is not None:
        x[change:] += 7
    d = dt.date(2020, 1, 1)
    return x, spark.createDataFrame([(d + dt.timedelta(days=i), s, float(x[i, j])) for i in range(n) for j, s in enumerate("xyp")], "date date, series string, x double")


def test_lasso_and_ridge_meet_their_conditions():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(500, 8))
    y = z @ np.array([1, 0, -0.5, 0, 0, 0, 0, 0.2]) + rng.normal(0, 0.1, 500)
    z, y = (z - z.mean(0)) / z.std(0), (y - y.mean()) / y.std()
    gram, cross = z.T @ z / 500, (z.T @ y / 500)[:, None]
    w = solvers.lasso(gram, cross, 0.05)[:, 0]
    grad = cross[:, 0] - gram @ w
    assert np.allclose(grad[w != 0], 0.05 * np.sign(w[w != 0]), atol=1e-8) and (np.abs(grad) <= 0.05 + 1e-8).all() and (w == 0).any()
    assert np.allclose(solvers.ridge(gram, cross, 1.0, 500)[:, 0], np.linalg.solve(z.T @ z + np.eye(8), z.T @ y))


def test_walk_forward_is_the_plain_loop(spark):
    x, df = panel(spark)
    own = E.indexed(df)
    outcome = W.targets(own, ["x", "y"], (1, 3))
    fit = E.direct(own, outcome, ["x", "y", "p"], ["x", "y"], S, E.Store(), alpha=0.03)
    got = {(r.h, r.i, r.g): r.prediction for r in W.forecast(fit.effects).collect()}
    n, lags = len(x), 2
    z = np.hstack([x[lags - k - 1 : n - k - 1] for k in range(lags)])  # row t - lags holds the lags of t
    for h in (1, 3):
        y = np.stack([x[t : t + h, :2].sum(0) for t in range(lags, n - h + 1)])
        for i in range(150, n - h + 1, 7):
            at = 150 + (i - 150) // 40 * 40
            a, b = z[: at - h - lags + 1], y[: at - h - lags + 1]
            mu, sd, my, sy = a.mean(0), a.std(0), b.mean(0), b.std(0)
            zs = (a - mu) / sd
            w = solvers.lasso(zs.T @ zs / len(a), zs.T @ ((b - my) / sy) / len(a), 0.03)
            want = my + sy * (((z[i - lags] - mu) / sd) @ w)
            assert [got[(h, i, "x")], got[(h, i, "y")]] == pytest.approx(want.tolist(), abs=1e-6)
    assert sum(k[0] == 3 for k in got) >= 2 * (n - 3 - 150 + 1)


def test_experiments_and_no_leakage(spark):
    for run, models in ((E.run_v1, 4), (E.run_v2, 4), (E.run_v3, 5)):
        one = run(panel(spark)[1], ["x", "y"], ["p"], S)["forecasts"]
        two = run(panel(spark, change=260)[1], ["x", "y"], ["p"], S)["forecasts"]
        cut = dt.date(2020, 1, 1) + dt.timedelta(days=250)
        pick = lambda f: {(r.horizon, r.model, r.date, r.target): r.prediction for r in f.collect() if r.date <= cut}
        a, b = pick(one), pick(two)
        assert a.keys() == b.keys() and len({k[1] for k in a}) == models
        assert all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_v4_and_rolling_edges(spark):
    out = E.run_v2(panel(spark)[1], ["x", "y"], ["p"], S)["forecasts"]
    v4 = E.run_v4(out, ["ar", "full_direct_sparse"])
    assert "online_fixed_share" in {r.model for r in v4["forecasts"].select("model").distinct().collect()}
    edges = E.rolling_edges(panel(spark)[1], ["x", "y", "p"], 150, 50, 1, 0.03)
    strong = edges.filter("source = 'y' and target = 'x'").collect()
    assert len(strong) == 4 and min(r.strength for r in strong) > 0.5


def test_incomplete_panels_are_refused(spark):
    from pyspark.errors import PySparkException

    bad = spark.createDataFrame([(dt.date(2020, 1, 1), "x", None)], "date date, series string, x double")
    with pytest.raises(PySparkException):
        E.indexed(bad).collect()
    with pytest.raises(ValueError):
        regime_system(spark, 100)
    assert regime_system(spark, 220).count() == 210 * 6


def test_queries_of_v4_and_report_go_through_v3(spark, monkeypatch):
    from lagwise.plans import catalog

    monkeypatch.setattr(catalog, "model_panel", lambda s, d: panel(spark)[1])
    monkeypatch.setattr(catalog.T, "naive_forecasts", lambda s, d: pytest.fail("naive forecasts"))
    monkeypatch.setattr(catalog.T, "SERIES", ["x", "y"])
    monkeypatch.setattr(catalog, "CANDIDATES", ["p"])
    monkeypatch.setattr(catalog, "SETTINGS", S)
    monkeypatch.setattr(catalog, "SPEC", S.spec)
    got = catalog.empirical_v4(spark, "").collect()
    assert {r.model for r in got} == {"ar", "financial_direct_sparse", "candidate_overlay_survival", "candidate_overlay_adaptive", "online_fixed_share"} and {r.horizon for r in got} == {1, 3}
    text = "\n".join(r.line for r in catalog.report_markdown(spark, "").orderBy("line_no").collect())
    assert "## Edges" in text and "## Gates" in text and "online_fixed_share_vs_financial_direct_sparse" in text


def test_queries_are_registered_at_full_stride(spark, monkeypatch):
    from lagwise.plans import catalog

    assert (catalog.SPEC.lags, catalog.SPEC.refit_every, catalog.SPEC.horizons, catalog.SETTINGS.min_snapshots) == (5, 20, (1, 5, 10, 20), 3)
    monkeypatch.setattr(catalog, "model_panel", lambda s, d: None)
    monkeypatch.setattr(catalog.E, "rolling_edges", lambda panel, series, window, step, lags, alpha: (series, window, step, lags))
    assert catalog.rolling_edge_snapshots(spark, "") == (catalog.T.SERIES + catalog.CANDIDATES, 400, 20, 5)
