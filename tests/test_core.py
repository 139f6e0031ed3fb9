import datetime as dt
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lagwise.functions import names
from lagwise.operators import edges, experts, features, inference, metrics
from lagwise.operators import panel as P
from lagwise.operators import transforms as X

DAY = dt.date(2026, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def series(spark, values, name="a"):
    return spark.createDataFrame([(name, day(i), None if v is None else float(v)) for i, v in enumerate(values)], "series string, date date, value double")


def values(df, col="value", by="date"):
    return [r[col] for r in df.orderBy(by).collect()]


def test_transforms(spark):
    s = series(spark, [100, 110, None, 121])
    assert values(X.transform(s, "difference")) == [None, 10.0, None, None]
    assert values(X.transform(series(spark, [100, 110]), "pct_change"))[1] == pytest.approx(0.1)
    log = values(X.transform(series(spark, [100, 110, 121]), "log_return"))
    assert log[0] is None and log[1:] == pytest.approx([math.log(1.1)] * 2)
    assert values(X.transform(series(spark, [100, 110]), "negative_log_return"))[1] == pytest.approx(-math.log(1.1))
    assert values(X.transform(series(spark, [0, 1]), "pct_change")) == [None, None]
    with pytest.raises(PySparkException):
        X.transform(series(spark, [1, 0]), "log_return").collect()
    with pytest.raises(ValueError):
        X.transform(s, "cube")


def test_as_of_join_takes_what_was_known(spark):
    log = spark.createDataFrame([("f", day(0), day(2), 1.0), ("f", day(1), day(2), 2.0), ("f", day(2), day(4), None), ("g", day(0), day(9), 5.0)], "feature string, observation_time date, available_at date, value double")
    times = spark.createDataFrame([(day(i),) for i in (1, 2, 3, 4)], "date date")
    got = {(r.date, r.feature): r.value for r in P.as_of(log, times).collect()}
    assert [got[(day(i), "f")] for i in (1, 2, 3, 4)] == [None, 2.0, 2.0, None]  # the missing release hides the older one
    assert {got[(day(i), "g")] for i in (1, 2, 3, 4)} == {None}
    wide = P.public_panel(times.withColumn("x", F.lit(1.0)), log, ["f", "g"])
    assert wide.count() == 4 and set(wide.columns) == {"date", "x", "f", "g"}
    with pytest.raises(KeyError):
        P.as_of(log.drop("value"), times)


def test_anomalies_see_the_past_only(spark):
    x = [10 + math.sin(i) * 3 for i in range(300)]
    rows = lambda v: series(spark, v).withColumnRenamed("series", "p")
    for method in features.METHODS:
        opts = {"baseline_days": 60, "min_periods": 20, "seasonal_lag": 30}
        a = values(features.anomaly(rows(x), ["p"], method, **opts), "anomaly")
        b = values(features.anomaly(rows(x[:250] + [1000.0] * 50), ["p"], method, **opts), "anomaly")
        assert a[:250] == b[:250] and a[260] != b[260] and any(v is not None for v in a)
    with pytest.raises(PySparkException):
        features.smooth(rows([-1.0]), ["p"]).collect()
    with pytest.raises(ValueError):
        features.anomaly(rows(x), ["p"], "other")


def test_resample_keeps_empty_bins(spark):
    s = spark.createDataFrame([("a", day(0), 1.0), ("a", day(1), 2.0), ("a", day(20), 5.0)], "series string, date date, value double")
    assert values(P.resample(s, "week"), by="bin") == [3.0, None, None, 5.0]


def test_audit_and_summary(spark):
    s = series(spark, [0, 2, None, 4])
    r = P.audit(s).first()
    assert (r.n, r.missing_fraction, r.mean, r.zero_fraction) == (3, 0.25, 2.0, pytest.approx(1 / 3)) and r["std"] == 2.0
    g = P.summary(s.union(s.limit(1))).first()
    assert (g["rows"], g.duplicate_dates, g.complete_rows, g.max_gap_days) == (5, 1, 3, 1)
    with pytest.raises(PySparkException):
        P.summary(s.limit(0)).collect()


def test_name_resolution(spark):
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "name string")
    got = {r.requested: (r.resolved, r.how) for r in names.resolve(one("SUEZ  canal", "Gibraltar", "Strait of Bab el Mandebb", "nowhere"), one("Suez Canal", "Gibraltar Strait", "Bab el-Mandeb Strait", "Panama Canal")).collect()}
    assert got["SUEZ  canal"] == ("Suez Canal", "exact") and got["Gibraltar"] == ("Gibraltar Strait", "substring") and got["nowhere"] == (None, None)
    assert names.normal(" Île-de-Ré!! ") == "ile de re"


def test_diebold_mariano_against_numpy(spark):
    rng = np.random.default_rng(3)
    d = rng.normal(0.1, 1, 400)
    rows = spark.createDataFrame([("t", day(i), float(v)) for i, v in enumerate(d)], "target string, date date, d double")
    for lags in (0, 4):
        r = inference.dm_test(rows, ["target"], lags).first()
        c = d - d.mean()
        lrv = c @ c / 400 + 2 * sum((1 - k / (lags + 1)) * (c[k:] @ c[:-k]) / 400 for k in range(1, lags + 1))
        assert r.dm_stat == pytest.approx(d.mean() / math.sqrt(lrv / 400))
    assert inference.dm_test(rows.limit(19), ["target"], 1).count() == 0
    flat = spark.createDataFrame([("t", day(i), 0.5) for i in range(30)], "target string, date date, d double")
    assert inference.dm_test(flat, ["target"], 1).first().dm_stat == math.inf
    p = spark.createDataFrame([(1.959963985,)], "z double").select(inference.two_sided_p("z")).first()[0]
    assert p == pytest.approx(0.05, abs=1e-9)


def test_benjamini_hochberg(spark):
    p = spark.createDataFrame([(i, v) for i, v in enumerate([0.001, 0.004, 0.03, 0.20, 0.90])], "i int, p_value double")
    assert [r.fdr_reject for r in inference.benjamini_hochberg(p, 0.05, []).orderBy("i").collect()] == [True, True, True, False, False]
    with pytest.raises(ValueError):
        inference.benjamini_hochberg(p, 1.0, [])


SNAP = "date date, source string, target string, strength double, signed_weight double"


def test_survival_rewards_value_not_structure(spark):
    snaps = spark.createDataFrame([(day(30 * k), s, "y", 0.5, 0.5) for k in range(4) for s in ("good", "bad")], SNAP)
    own = [(day(i), s, "y", (0.2 if s == "good" else -0.2) + 0.01 * (i % 3)) for i in range(90) for s in ("good", "bad")]
    contributions = spark.createDataFrame(own, "realized_date date, source string, target string, loss_improvement double")
    as_of = spark.createDataFrame([(day(95),)], "as_of date")
    got = {r.source: r for r in edges.survival(snaps, contributions, as_of).collect()}
    assert got["good"].survival_score > 0.9 and got["bad"].survival_score == 0 and got["bad"].selection_frequency == 1
    late = contributions.union(spark.createDataFrame([(day(95), "good", "y", -99.0)], contributions.schema))
    assert {r.source: r.survival_score for r in edges.survival(snaps, late, as_of).collect()}["good"] == got["good"].survival_score  # not realised before
    mask = {tuple(r) for r in edges.survival_mask(edges.survival(snaps, contributions, as_of), ["good", "bad", "y"], ["y"]).collect()}
    assert mask == {("good", "y"), ("y", "y")}


def test_gates(spark):
    rows = [(day(i), t, v) for i in range(80) for t, v in (("up", 0.2), ("down", -0.2))]
    contributions = spark.createDataFrame(rows, "realized_date date, target string, loss_improvement double")
    got = {r.target: r.gate for r in edges.gates(contributions, spark.createDataFrame([(day(80),)], "as_of date"), ["up", "down", "none"]).collect()}
    assert got == {"up": 1.0, "down": 0.0, "none": 0.0}  # no variance: the sign of the mean decides


def test_fixed_share_against_plain_python(spark):
    rng = np.random.default_rng(1)
    n, h, k = 300, 3, 2
    y = rng.normal(size=n)
    f = np.stack([y + rng.normal(0, 0.3, n), y + rng.normal(0, np.where(np.arange(n) < 150, 0.1, 1.0), n)])
    rows = [(h, m, day(i), "t", float(y[i]), float(f[j, i])) for i in range(n) for j, m in enumerate(("a", "b"))]
    df = spark.createDataFrame(rows, "horizon int, model string, date date, target string, actual double, prediction double")
    out = experts.fixed_share(df, ["a", "b"], [0.01], window=50).orderBy("date").collect()
    w, past, seen = np.full(k, 0.5), [], 0
    for i in range(n):
        if i >= h:
            loss = (y[i - h] - f[:, i - h]) ** 2
            pooled = loss.mean()
            scale = max(np.median(past[-50:]) if past else pooled, 1e-12)
            seen += 1
            u = w * np.exp(-min(1, math.sqrt(8 * math.log(2) / seen)) * np.clip(loss / scale, 0, 5) / 5)
            w = 0.99 * u / u.sum() + 0.01 / k
            past.append(pooled)
        assert out[i].weights == pytest.approx(w.tolist()) and out[i].updates == seen and sum(out[i].weights) == pytest.approx(1)
    assert out[149].weights[1] > 0.6 and out[-1].weights[1] < 0.4
    with pytest.raises(ValueError):
        experts.fixed_share(df, ["a"], [1.0])


def test_metrics(spark):
    rows = [("m", "v", 0.0, 0.0), ("m", "v", 1.0, 2.0), ("m", "v", -1.0, 1.0), ("m", "v", None, 1.0), ("c", "v", 1.0, 1.0)]
    got = {r.model: r for r in metrics.metrics(spark.createDataFrame(rows, "model string, variable string, actual double, prediction double"), ["model", "variable"]).collect()}
    assert (got["m"].n, got["m"].mae, got["m"].directional_accuracy) == (3, 1.0, pytest.approx(2 / 3)) and got["m"].rmse == pytest.approx(math.sqrt(5 / 3))
    assert got["c"]["corr"] is None
