"""The library's registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.functions import names
from lagwise.operators import edges, experts, features, inference, metrics
from lagwise.operators import panel as P
from lagwise.operators import transforms as X
from lagwise.plans import tables as T

QUERIES: dict = {}
SQL: dict[str, str] = {}
FLAGSHIP = "public_panel"
SEGMENTS = {"all": (None, None), "early": (None, "1998-06-30"), "late": ("1998-07-01", None)}
PORTS = ("africa", "america", "asia", "europe", "middle_east")
FEATURES = [f"pw_{p}_{m}_z" for p in PORTS for m in ("capacity", "n_total")]
ANOMALY = {"smooth_days": 7, "baseline_days": 120, "min_periods": 40, "seasonal_lag": 182}
LAG_DAYS = 10
EXPERTS = ["last", "mean"]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _r(*cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0::DOUBLE AS {c}" for c in cols)


# --- panels and transforms ---


@query(f"WITH {T.DAILY} SELECT series, date, {_r('value')} FROM daily")
def panel_daily(spark: SparkSession, d: str) -> DataFrame:
    return rounded(T.daily(spark, d))


@query(f"WITH {T.RETURNS} SELECT date, " + ", ".join(f"round(max(value) FILTER (series = '{s}'), 6) AS {s}" for s in T.SERIES) + " FROM rets GROUP BY date HAVING " + " AND ".join(f"max(value) FILTER (series = '{s}') IS NOT NULL" for s in T.SERIES))
def panel_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.complete(P.wide(T.returns(spark, d), T.SERIES)))


METHOD_OF = {"africa": "level", "america": "difference", "asia": "log_return", "europe": "negative_log_return", "middle east": "pct_change"}


@query(f"""WITH {T.FACTS}, w AS (SELECT lower(portname) AS series, date, capacity AS x, lag(capacity) OVER (PARTITION BY portname ORDER BY date) AS p FROM facts)
SELECT series, date, round(CASE series WHEN 'africa' THEN x WHEN 'america' THEN x - p WHEN 'asia' THEN ln(x) - ln(p) WHEN 'europe' THEN ln(p) - ln(x) ELSE x / p - 1 END, 6) AS value FROM w""")
def transforms_all(spark: SparkSession, d: str) -> DataFrame:
    rows = T.facts(spark, d).select(F.lower("portname").alias("series"), "date", F.col("capacity").alias("value"))
    return rounded(X.transform_by(rows, METHOD_OF))


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.page') AS DOUBLE) AS page, signum, round(clipped, 6) AS clipped, round(squashed, 6) AS squashed, round(weight, 6) AS weight FROM (
SELECT event_id, props, sign(value - 50)::DOUBLE AS signum, least(greatest(value / 100, 0.1), 0.9) AS clipped, tanh((value - 50) / 50) AS squashed, exp(-ln(2) * greatest(date_diff('day', ts::DATE, DATE '2024-01-20'), 0) / 7.0) AS weight FROM events)""")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return T.read(spark, d, "events").select(
        "event_id", X.coerce(F.get_json_object("props", "$.page")).alias("page"), F.signum(v - 50).alias("signum"), F.round(X.clip(v / 100, 0.1, 0.9), 6).alias("clipped"), F.round(F.tanh((v - 50) / 50), 6).alias("squashed"),
        F.round(X.decay(F.lit("2024-01-20").cast("date"), F.col("ts").cast("date"), 7.0), 6).alias("weight"),
    )


_LOGS = T.FACTS + ", logs AS (SELECT lower(portname) AS portname, date, ln(1 + capacity) AS l FROM facts)"
_SMOOTH = _LOGS + """, smooth AS (SELECT portname, date, CASE WHEN count(l) OVER w >= 3 THEN avg(l) OVER w END AS s FROM logs WINDOW w AS (PARTITION BY portname ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""


def _z(source: str, column: str) -> str:
    w = f"(PARTITION BY portname ORDER BY date ROWS BETWEEN {ANOMALY['baseline_days']} PRECEDING AND 1 PRECEDING)"
    enough = f"count({column}) OVER {w} >= {ANOMALY['min_periods']}"
    return f"SELECT portname, date, round(CASE WHEN {enough} THEN ({column} - avg({column}) OVER {w}) / nullif(stddev_samp({column}) OVER {w}, 0) END, 5) AS anomaly FROM {source}"


def _ports(spark: SparkSession, d: str) -> DataFrame:
    return T.facts(spark, d).select(F.lower("portname").alias("portname"), "date", F.col("capacity").alias("value"))


@query(f"WITH {_SMOOTH} SELECT portname, date, round(s, 6) AS smooth FROM smooth")
def physical_smooth(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.smooth(_ports(spark, d), ["portname"]).select("portname", "date", "smooth"))


@query(f"WITH {_SMOOTH} {_z('smooth', 's')}")
def trailing_anomaly(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.anomaly(_ports(spark, d), ["portname"], "rolling", **ANOMALY).select("portname", "date", "anomaly"), 5)


@query(f"WITH {_SMOOTH}, change AS (SELECT portname, date, s - lag(s, {ANOMALY['seasonal_lag']}) OVER (PARTITION BY portname ORDER BY date) AS c FROM smooth) {_z('change', 'c')}")
def seasonal_anomaly(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.anomaly(_ports(spark, d), ["portname"], "seasonal_yoy", **ANOMALY).select("portname", "date", "anomaly"), 5)


def _releases(spark: SparkSession, d: str) -> DataFrame:
    """The release log of all features, stamped in long form."""
    rows = features.feature_panel(T.facts(spark, d), ["capacity", "n_total"], "rolling", **ANOMALY).filter("value is not null")
    return rows.select(F.col("date").alias("observation_time"), F.date_add("date", LAG_DAYS).alias("available_at"), "feature", "value", F.lit("ports").alias("source"), F.lit("daily").alias("frequency"), F.lit("rolling").alias("transform"))


_LONG = T.FACTS + """, logs AS (SELECT 'pw_' || replace(lower(portname), ' ', '_') || '_' || metric || '_z' AS portname, date, ln(1 + v) AS l FROM
 (SELECT portname, date, 'capacity' AS metric, capacity AS v FROM facts UNION ALL SELECT portname, date, 'n_total', n_total FROM facts)),
smooth AS (SELECT portname, date, CASE WHEN count(l) OVER w >= 3 THEN avg(l) OVER w END AS s FROM logs WINDOW w AS (PARTITION BY portname ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)), zs AS (""" + _z("smooth", "s") + f"""),
releases AS (SELECT date AS observation_time, date + {LAG_DAYS} AS available_at, portname AS feature, anomaly AS value, 'ports' AS source, 'daily' AS frequency, 'rolling' AS transform FROM zs WHERE anomaly IS NOT NULL)"""


@query(f"WITH {_LONG} SELECT * FROM releases")
def releases_long(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_releases(spark, d), 5)


_FIN_DAYS = ", fin_days AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders)"
_PIT = _LONG + _FIN_DAYS + """, asked AS (SELECT date, feature FROM fin_days CROSS JOIN (SELECT DISTINCT feature FROM releases)),
pit AS (SELECT a.date, a.feature, r.value FROM asked a ASOF LEFT JOIN releases r ON a.feature = r.feature AND a.date >= r.available_at)"""


@query(f"WITH {_PIT} SELECT * FROM pit")
def pit_asof(spark: SparkSession, d: str) -> DataFrame:
    days = T.read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return rounded(P.as_of(_releases(spark, d), days), 5)


def _feature_cols(f: str) -> str:
    return ", ".join(f"max(value) FILTER (feature = '{x}') AS {x}" for x in FEATURES) if f == "agg" else ", ".join(FEATURES)


@query(f"WITH {_PIT} SELECT date, {_feature_cols('agg')} FROM pit GROUP BY date")
def pit_asof_panel(spark: SparkSession, d: str) -> DataFrame:
    days = T.read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return rounded(P.as_of_panel(_releases(spark, d), days, FEATURES), 5)


_FIN_WIDE = ", fin AS (SELECT date, " + ", ".join(f"round(max(value) FILTER (series = '{s}'), 5) AS {s}" for s in T.SERIES) + " FROM rets GROUP BY date)"


@query(f"WITH {_LONG}, {T.RETURNS} {_FIN_WIDE}, asked AS (SELECT date, feature FROM fin CROSS JOIN (SELECT DISTINCT feature FROM releases)), pit AS (SELECT a.date, a.feature, r.value FROM asked a ASOF LEFT JOIN releases r ON a.feature = r.feature AND a.date >= r.available_at), wide AS (SELECT date, {_feature_cols('agg')} FROM pit GROUP BY date) SELECT fin.*, {_feature_cols('names')} FROM fin LEFT JOIN wide ON fin.date = wide.date")
def public_panel(spark: SparkSession, d: str) -> DataFrame:
    """Daily finance with the physical anomalies that were known on each day."""
    finance = P.wide(T.returns(spark, d), T.SERIES)
    return rounded(P.public_panel(finance, _releases(spark, d), FEATURES), 5)


@query(f"WITH {T.FACTS}, b AS (SELECT lower(portname) AS series, date_trunc('week', date)::DATE AS bin, sum(capacity) AS value FROM facts GROUP BY ALL), s AS (SELECT series, unnest(generate_series(min(bin), max(bin), INTERVAL 7 DAY))::DATE AS bin FROM b GROUP BY series) SELECT series, bin, round(value, 6) AS value FROM s LEFT JOIN b USING (series, bin)")
def resample_weekly_sum(spark: SparkSession, d: str) -> DataFrame:
    rows = T.facts(spark, d).select(F.lower("portname").alias("series"), "date", F.col("capacity").alias("value"))
    return rounded(P.resample(rows, "week"))


@query("WITH b AS (SELECT event_type AS series, date_trunc('month', ts)::DATE AS bin, avg(value) AS value FROM events GROUP BY ALL) SELECT series, bin, round(value, 6) AS value FROM b")
def resample_monthly_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = T.read(spark, d, "events").select(F.col("event_type").alias("series"), F.col("ts").cast("date").alias("date"), "value")
    return rounded(P.resample(rows, "month", "mean"))


@query(f"WITH {T.DAILY} SELECT series AS variable, count(value) AS n, round(1 - count(value) / count(*), 6) AS missing_fraction, {_r('mean')}, {_r('std')}, {_r('min')}, {_r('max')}, {_r('zero_fraction')} FROM (SELECT series, value, avg(value) OVER p AS mean, stddev_samp(value) OVER p AS std, min(value) OVER p AS min, max(value) OVER p AS max, avg((value = 0)::INT) OVER p AS zero_fraction FROM daily WINDOW p AS (PARTITION BY series)) GROUP BY series, mean, std, min, max, zero_fraction")
def panel_audit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.audit(T.daily(spark, d)))


@query(f"""WITH {T.FACTS}, c AS (SELECT count(DISTINCT portname) AS columns FROM facts), r AS (SELECT date, count(DISTINCT portname) AS have FROM facts GROUP BY date),
g AS (SELECT *, date - lag(date) OVER (ORDER BY date) AS gap FROM r)
SELECT min(date) AS start, max(date) AS "end", count(*) AS rows, max(columns) AS columns, sum((have = columns)::INT)::BIGINT AS complete_rows, 0::BIGINT AS duplicate_dates, coalesce(max(gap), 0)::INT AS max_gap_days, coalesce(median(gap), 0)::DOUBLE AS median_gap_days FROM g, c""")
def panel_summary(spark: SparkSession, d: str) -> DataFrame:
    return P.summary(T.facts(spark, d).select(F.col("portname").alias("series"), "date", F.col("capacity").alias("value")))


@query(f"WITH {T.RETURNS} SELECT * FROM (SELECT series, date, {_r('value')}, row_id, " + ", ".join(f"round(lag(value, {k}) OVER (PARTITION BY series ORDER BY row_id), 6) AS lag_{k}" for k in (1, 2, 3)) + " FROM rets) WHERE row_id >= 3")
def lag_design(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.lag_design(T.returns(spark, d), 3))


@query(f"WITH {T.RETURNS}, t AS (" + " UNION ALL ".join(f"SELECT series, date, row_id, {h} AS horizon, sum(value) OVER w AS target, count(value) OVER w AS c, lead(date, {h - 1}) OVER (PARTITION BY series ORDER BY row_id) AS realized_date FROM rets WINDOW w AS (PARTITION BY series ORDER BY row_id ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING)" for h in (1, 5, 10)) + ") SELECT series, date, row_id, horizon, round(target, 6) AS target, realized_date FROM t WHERE c = horizon")
def direct_targets(spark: SparkSession, d: str) -> DataFrame:
    out = X.forward_sums(T.returns(spark, d), [1, 5, 10])
    return rounded(out.drop("value"))


# --- sources' set-based parts ---


@query("WITH e AS (SELECT event_type, ts::DATE AS date, round(value, 6) AS value, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY event_id DESC) AS r FROM events) SELECT event_type, date, value FROM e WHERE r = 1")
def observations_keep_last(spark: SparkSession, d: str) -> DataFrame:
    from lagwise.sources.observations import keep_last

    rows = T.read(spark, d, "events").select("event_type", F.col("ts").cast("date").alias("date"), "value", "event_id")
    return rounded(keep_last(rows, ["event_type", "date"], "event_id").drop("event_id"))


@query("SELECT DISTINCT n_nationkey::VARCHAR AS portid, n_name AS portname FROM nation")
def catalogue(spark: SparkSession, d: str) -> DataFrame:
    from lagwise.sources.observations import catalogue_of

    return catalogue_of(T.read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("portid"), F.col("n_name").alias("portname")))


@query("SELECT event_id, date, metric FROM (SELECT event_id, ts::DATE AS date, round(value, 6) AS metric FROM events)")
def observations_epoch(spark: SparkSession, d: str) -> DataFrame:
    from lagwise.sources.observations import parse_dates

    raw = T.read(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("date"), F.col("value").cast("string").alias("metric"))
    return rounded(parse_dates(raw, ["metric"]))


@query()
def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    asked = T.read(spark, d, "nation").select(F.initcap(F.concat(F.lit("the "), "n_name")).alias("name")).union(T.read(spark, d, "region").select(F.col("r_name").alias("name")))
    known = T.read(spark, d, "nation").select(F.col("n_name").alias("name")).union(T.read(spark, d, "region").select(F.col("r_name").alias("name")))
    return names.resolve(asked, known)


# --- metrics and tests ---

_ERR = "sqrt(avg((prediction - actual) * (prediction - actual))) AS rmse, avg(abs(prediction - actual)) AS mae, avg((sign(actual) = sign(prediction))::INT) AS directional_accuracy"
_SEG = T.FORECASTS + ", seg AS (SELECT *, unnest(CASE WHEN date <= DATE '1998-06-30' THEN ['all', 'early'] ELSE ['all', 'late'] END) AS segment FROM forecasts)"
_MET = _SEG + f", met AS (SELECT segment, horizon, model, target AS variable, count(*) AS n, {_ERR}, CASE WHEN count(*) > 2 AND var_pop(prediction) > 0 THEN corr(actual, prediction) END AS corr FROM seg GROUP BY ALL)"


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.segmented(T.naive_forecasts(spark, d), SEGMENTS).withColumnRenamed("target", "variable")
    return metrics.metrics(rows, ["segment", "horizon", "model", "variable"])


@query(f"WITH {_MET} SELECT segment, horizon, model, variable, n, {_r('rmse', 'mae', 'directional_accuracy', 'corr')} FROM met")
def metrics_by_segment(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_metrics(spark, d))


@query(f"WITH {_MET}, b AS (SELECT *, max(rmse) FILTER (model = 'mean') OVER (PARTITION BY segment, horizon, variable) AS ar_rmse FROM met) SELECT segment, horizon, model, variable, {_r('rmse', 'ar_rmse')}, round(1 - rmse / ar_rmse, 6) AS rmse_skill_vs_ar FROM b")
def skill_vs_ar(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.skill_against(_metrics(spark, d), "mean", ["segment", "horizon", "variable"])
    return rounded(out.select("segment", "horizon", "model", "variable", "rmse", "ar_rmse", "rmse_skill_vs_ar"))


@query(f"WITH {_MET}, b AS (SELECT *, max(rmse) FILTER (model = 'zero') OVER (PARTITION BY segment, horizon, variable) AS base FROM met), s AS (SELECT *, 1 - rmse / base AS skill FROM b WHERE model != 'zero' AND base > 0) SELECT segment, horizon, model, round(avg(skill), 6) AS mean_skill, count(*) FILTER (skill > 0) AS n_better, count(*) AS n_targets FROM s GROUP BY ALL")
def skill_vs_core(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.skill_summary(_metrics(spark, d), "zero", ["segment", "horizon"]))


@query(f"WITH {_MET}, r AS (SELECT horizon, model, avg(rmse) AS mean_rmse FROM met WHERE segment = 'all' GROUP BY ALL) SELECT horizon, " + ", ".join(f"round(max(mean_rmse) FILTER (model = '{m}'), 6) AS \"{m}\"" for m in ("last", "mean", "zero")) + " FROM r GROUP BY horizon")
def report_rmse_by_model(spark: SparkSession, d: str) -> DataFrame:
    from lagwise.plans.reports import skill_table

    return rounded(skill_table(_metrics(spark, d).filter("segment = 'all'"), ["last", "mean", "zero"], "rmse"))


_PAIRS = [("zero", "mean"), ("mean", "last")]
_DM = T.FORECASTS + ", met AS (SELECT horizon, date, target, max(actual) AS actual, " + ", ".join(f"max(prediction) FILTER (model = '{m}') AS {m}" for m in ("last", "mean", "zero")) + """ FROM forecasts GROUP BY horizon, date, target),
ds AS (""" + " UNION ALL ".join(f"SELECT '{c}_vs_{b}' AS comparison, '{b}' AS benchmark, '{c}' AS challenger, horizon, target, date, (actual - {b}) * (actual - {b}) - (actual - {c}) * (actual - {c}) AS dd FROM met WHERE {b} IS NOT NULL AND {c} IS NOT NULL" for b, c in _PAIRS) + """),
cs AS (SELECT *, dd - avg(dd) OVER p AS c, count(*) OVER p AS n, avg(dd) OVER p AS m FROM ds WINDOW p AS (PARTITION BY comparison, horizon, target)),
ls AS (SELECT *, least(greatest(2, horizon - 1), n - 1) AS hac_lags, """ + ", ".join(f"coalesce(c * lag(c, {k}) OVER o, 0) AS p{k}" for k in (1, 2, 3, 4)) + """ FROM cs WINDOW o AS (PARTITION BY comparison, horizon, target ORDER BY date)),
dm AS (SELECT comparison, benchmark, challenger, horizon, target, count(*) AS n, max(m) AS mean_loss_improvement, max(hac_lags)::INT AS hac_lags,
  greatest(sum(c * c) / count(*) + """ + " + ".join(f"CASE WHEN max(hac_lags) >= {k} THEN 2 * (1 - {k} / (max(hac_lags) + 1.0::DOUBLE)) * sum(p{k}) / count(*) ELSE 0 END" for k in (1, 2, 3, 4)) + """, 0) AS lrv FROM ls GROUP BY ALL HAVING count(*) >= 20)"""


@query(f"WITH {_DM} SELECT comparison, benchmark, challenger, horizon, target, n, {_r('mean_loss_improvement')}, hac_lags, {_r('lrv')}, round(mean_loss_improvement / sqrt(lrv / n), 5) AS dm_stat, mean_loss_improvement > 0 AS challenger_better FROM dm")
def nested_dm(spark: SparkSession, d: str) -> DataFrame:
    out = inference.nested_tests(T.naive_forecasts(spark, d), _PAIRS, base_lags=2, horizons=[1, 5], with_p=False)
    return rounded(out.withColumn("dm_stat", F.round("dm_stat", 5)))


@query()
def nested_dm_fdr(spark: SparkSession, d: str) -> DataFrame:
    return inference.nested_tests(T.naive_forecasts(spark, d), _PAIRS, base_lags=2, horizons=[1, 5])


# 1 / (1 + dm_stat^2) lies in (0, 1], falls with |dm_stat|, and both engines can compute it.
_BH = _DM + """, ps AS (SELECT comparison, horizon, target, mean_loss_improvement > 0 AS challenger_better, 1 / (1 + mean_loss_improvement * mean_loss_improvement * n / lrv) AS p FROM dm),
rk AS (SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY p, horizon, target) AS r, count(*) OVER (PARTITION BY comparison) AS m FROM ps),
bh AS (SELECT *, r <= coalesce(max(CASE WHEN p <= 0.1 * r / m THEN r END) OVER (PARTITION BY comparison), 0) AS fdr_reject FROM rk)"""


def _bh(spark: SparkSession, d: str) -> DataFrame:
    out = inference.nested_tests(T.naive_forecasts(spark, d), _PAIRS, base_lags=2, horizons=[1, 5], with_p=False)
    out = out.withColumn("p_value", 1 / (1 + F.col("dm_stat") * F.col("dm_stat")))
    return inference.benjamini_hochberg(out, 0.10, ["comparison"], tie=["horizon", "target"])


@query(f"WITH {_BH} SELECT comparison, horizon, target, round(p, 6) AS p_value, fdr_reject FROM bh")
def bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_bh(spark, d).select("comparison", "horizon", "target", "p_value", "fdr_reject"))


@query(f"WITH {_BH} SELECT comparison, count(*) AS n_tests, count(*) FILTER (challenger_better) AS n_better, count(*) FILTER (fdr_reject) AS n_reject FROM bh GROUP BY comparison")
def comparison_summary(spark: SparkSession, d: str) -> DataFrame:
    return inference.comparison_summary(_bh(spark, d))


@query(f"WITH {_BH}, s AS (SELECT horizon, (1 - p) * CASE WHEN challenger_better THEN 1 ELSE -1 END AS skill, fdr_reject, challenger_better FROM bh) SELECT horizon, round(avg(skill), 6) AS mean_skill, round(median(skill), 6) AS median_skill, count(*) FILTER (skill > 0) AS n_better, count(skill) AS n_targets, count(*) FILTER (fdr_reject AND challenger_better) AS n_fdr_better FROM s GROUP BY horizon")
def lag_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    rows = _bh(spark, d).withColumn("skill", (1 - F.col("p_value")) * F.when(F.col("challenger_better"), 1).otherwise(-1))
    return rounded(metrics.lag_sensitivity(rows, ["horizon"]))


# --- edges ---

THRESHOLD = 0.05
_STAB = T.SNAPSHOTS + f""", stab AS (SELECT source, target, avg((strength >= {THRESHOLD})::INT) AS selection_frequency, avg(strength) AS mean_strength, max_by(strength, date) AS latest_strength,
 CASE WHEN count(*) FILTER (strength >= {THRESHOLD}) > 0 THEN greatest(count(*) FILTER (strength >= {THRESHOLD} AND signed_weight > 0), count(*) FILTER (strength >= {THRESHOLD} AND signed_weight < 0)) / count(*) FILTER (strength >= {THRESHOLD}) END AS sign_stability FROM snapshots GROUP BY ALL)"""


@query(f"WITH {_STAB} SELECT source, target, {_r('selection_frequency', 'mean_strength', 'latest_strength', 'sign_stability')} FROM stab")
def edge_stability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(edges.stability(T.edge_snapshots(spark, d), THRESHOLD))


@query(f"WITH {_STAB} SELECT source, target FROM stab WHERE selection_frequency >= 0.6 AND coalesce(sign_stability, 0) >= 0.75 UNION SELECT DISTINCT source, source FROM stab")
def stability_mask(spark: SparkSession, d: str) -> DataFrame:
    return edges.stability_mask(edges.stability(T.edge_snapshots(spark, d), THRESHOLD), T.SERIES, T.SERIES)


_SURV = T.SNAPSHOTS + f""",{T.CONTRIBUTIONS},{T.AS_OF},
sw AS (SELECT a.as_of, s.*, exp(-ln(2) * greatest(a.as_of - s.date, 0) / 180.0) AS w, strength >= {THRESHOLD} AS sel FROM snapshots s JOIN asat a ON s.date <= a.as_of),
sh AS (SELECT as_of, source, target, count(*) AS n_snapshots, sum(w * sel::INT) / sum(w) AS selection_frequency,
  greatest(coalesce(sum(w) FILTER (sel AND signed_weight > 0), 0), coalesce(sum(w) FILTER (sel AND signed_weight < 0), 0)) / sum(w) FILTER (sel) AS sign_stability,
  sum(w * strength) / sum(w) AS weighted_strength, max_by(strength, date) AS latest_strength FROM sw GROUP BY ALL),
cw AS (SELECT a.as_of, c.*, exp(-ln(2) * greatest(a.as_of - realized_date, 0) / 120.0) AS w FROM contributions c JOIN asat a ON realized_date < a.as_of),
cm AS (SELECT *, sum(w * loss_improvement) OVER p / sum(w) OVER p AS m FROM cw WINDOW p AS (PARTITION BY as_of, source, target)),
co AS (SELECT as_of, source, target, count(*) AS n_contributions, max(m) AS m, sum(w * (loss_improvement > 0)::INT) / sum(w) AS hit,
  max(m) / sqrt(sum(w * (loss_improvement - m) * (loss_improvement - m)) / sum(w) / (sum(w) * sum(w) / sum(w * w))) AS t FROM cm GROUP BY ALL),
sv AS (SELECT sh.*, CASE WHEN weighted_strength > 1e-12 THEN latest_strength / weighted_strength ELSE 0 END AS strength_retention, coalesce(n_contributions, 0) AS n_contributions,
  m AS weighted_mean_loss_improvement, hit AS contribution_hit_rate, t AS contribution_t_stat FROM sh LEFT JOIN co USING (as_of, source, target)),
surv AS (SELECT *, greatest(selection_frequency, 0) * greatest(coalesce(sign_stability, 0), 0) * least(greatest(strength_retention, 0), 1) AS structural_score,
  CASE WHEN contribution_t_stat > 0 THEN tanh(contribution_t_stat / 2) ELSE 0 END AS predictive_score FROM sv)"""
_SURV_COLS = ("selection_frequency", "sign_stability", "weighted_strength", "latest_strength", "strength_retention", "weighted_mean_loss_improvement", "contribution_hit_rate", "contribution_t_stat", "structural_score", "predictive_score")


def _survival(spark: SparkSession, d: str) -> DataFrame:
    snaps = T.edge_snapshots(spark, d)
    return edges.survival(snaps, T.edge_contributions(spark, d), T.snapshot_dates(snaps), THRESHOLD)


@query(f"WITH {_SURV} SELECT as_of, source, target, n_snapshots, n_contributions, {_r(*_SURV_COLS, digits=5)}, round(structural_score * predictive_score, 5) AS survival_score FROM surv")
def edge_survival(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_survival(spark, d), 5)


@query(f"""WITH {_SURV}, ok AS (SELECT *, row_number() OVER (PARTITION BY as_of, target ORDER BY structural_score * predictive_score DESC, source) AS r FROM surv
 WHERE selection_frequency >= 0.5 AND coalesce(sign_stability, 0) >= 0.6 AND strength_retention >= 0.25 AND n_contributions >= 20 AND coalesce(weighted_mean_loss_improvement, '-inf'::DOUBLE) > 0)
SELECT as_of, source, target FROM ok WHERE r <= 3 UNION SELECT DISTINCT as_of, source, source FROM surv""")
def survival_mask(spark: SparkSession, d: str) -> DataFrame:
    return edges.survival_mask(_survival(spark, d), T.SERIES, T.SERIES, max_edges=3, keys=["as_of"])


@query(f"WITH {_SURV}, l AS (SELECT * FROM surv WHERE as_of = (SELECT max(as_of) FROM surv)) SELECT source, target, round(structural_score * predictive_score, 5) AS survival_score FROM l ORDER BY structural_score * predictive_score DESC, selection_frequency DESC, source, target LIMIT 10")
def edge_topk(spark: SparkSession, d: str) -> DataFrame:
    last = metrics.latest(_survival(spark, d).withColumn("one", F.lit(1)), ["one"], "as_of")
    out = metrics.top(last, 10, [F.desc("survival_score"), F.desc("selection_frequency"), "source", "target"])
    return rounded(out.select("source", "target", "survival_score"), 5)


_GATE = T.SNAPSHOTS + f""",{T.CONTRIBUTIONS},{T.AS_OF},
tc AS (SELECT realized_date, target, sum(loss_improvement) AS loss_improvement FROM contributions GROUP BY ALL),
cw AS (SELECT a.as_of, c.*, exp(-ln(2) * greatest(a.as_of - realized_date, 0) / 120.0) AS w FROM tc c JOIN asat a ON realized_date < a.as_of),
cm AS (SELECT *, sum(w * loss_improvement) OVER p / sum(w) OVER p AS m FROM cw WINDOW p AS (PARTITION BY as_of, target)),
co AS (SELECT as_of, target, count(*) AS n, max(m) AS m, sum(w * (loss_improvement > 0)::INT) / sum(w) AS hit,
  max(m) / sqrt(sum(w * (loss_improvement - m) * (loss_improvement - m)) / sum(w) / (sum(w) * sum(w) / sum(w * w))) AS t FROM cm GROUP BY ALL)"""


def _gates(spark: SparkSession, d: str) -> DataFrame:
    total = T.edge_contributions(spark, d).groupBy("realized_date", "target").agg(F.sum("loss_improvement").alias("loss_improvement"))
    return edges.gates(total, T.snapshot_dates(T.edge_snapshots(spark, d)), T.SERIES)


_GATE_COLS = f"as_of, target, n, round(m, 5) AS weighted_mean_loss_improvement, round(hit, 5) AS contribution_hit_rate, round(t, 5) AS contribution_t_stat, round(CASE WHEN n >= 30 AND m > 0 AND t > 0 THEN tanh(t / 2) ELSE 0 END, 5) AS gate"


@query(f"WITH {_GATE} SELECT {_GATE_COLS} FROM co")
def overlay_gates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_gates(spark, d), 5)


@query(f"WITH {_GATE} SELECT {_GATE_COLS} FROM co WHERE as_of = (SELECT max(as_of) FROM co)")
def latest_gates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.latest(_gates(spark, d), ["target"], "as_of"), 5)


# --- experts ---

_EXP = T.FORECASTS + """, met AS (SELECT horizon, target, date, max(actual) AS actual, max(prediction) FILTER (model = 'last') AS f1, max(prediction) FILTER (model = 'mean') AS f2 FROM forecasts GROUP BY ALL),
pos AS (SELECT *, row_number() OVER (PARTITION BY horizon, target ORDER BY date) - 1 AS pos FROM met WHERE f1 IS NOT NULL AND f2 IS NOT NULL AND actual IS NOT NULL),
lo AS (SELECT *, (actual - f1) ** 2 AS l1, (actual - f2) ** 2 AS l2, ((actual - f1) ** 2 + (actual - f2) ** 2) / 2 AS pooled FROM pos),
sc AS (SELECT *, greatest(coalesce(median(pooled) OVER (PARTITION BY horizon, target ORDER BY pos ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING), pooled), 1e-12) AS scale FROM lo),
bo AS (SELECT *, least(greatest(l1 / scale, 0), 5) / 5 AS b1, least(greatest(l2 / scale, 0), 5) / 5 AS b2, pos + 1 AS n, least(1, sqrt(8 * ln(2.0) / (pos + 1))) AS eta FROM sc)"""


@query(f"WITH {_EXP} SELECT horizon, target, date, {_r('l1', 'l2', 'pooled')} FROM lo")
def fixed_share_losses(spark: SparkSession, d: str) -> DataFrame:
    rows = experts.bounded_losses(experts.complete_rows(T.naive_forecasts(spark, d), EXPERTS), EXPERTS)
    return rounded(rows.select("horizon", "target", "date", F.col("losses")[0].alias("l1"), F.col("losses")[1].alias("l2"), "pooled"))


@query(f"WITH {_EXP} SELECT horizon, target, date, {_r('scale', 'b1', 'b2', 'eta')} FROM bo")
def fixed_share_scale(spark: SparkSession, d: str) -> DataFrame:
    rows = experts.bounded_losses(experts.complete_rows(T.naive_forecasts(spark, d), EXPERTS), EXPERTS)
    return rounded(rows.select("horizon", "target", "date", "scale", F.col("bounded")[0].alias("b1"), F.col("bounded")[1].alias("b2"), "eta"))


def _fold(shares: str) -> str:
    return _EXP + f""", sn AS (SELECT share, a.horizon, a.target, a.date, a.pos, a.actual, a.f1, a.f2, b.b1, b.b2, b.eta FROM bo a CROSS JOIN (SELECT unnest({shares}) AS share) LEFT JOIN bo b ON b.horizon = a.horizon AND b.target = a.target AND b.pos = a.pos - a.horizon),
fo(share, horizon, target, pos, date, actual, prediction, w1) AS (
  SELECT share, horizon, target, pos, date, actual, 0.5 * f1 + 0.5 * f2, 0.5::DOUBLE FROM sn WHERE pos = 0
  UNION ALL
  SELECT s.share, s.horizon, s.target, s.pos, s.date, s.actual, w * s.f1 + (1 - w) * s.f2, w FROM (
    SELECT s.*, CASE WHEN s.b1 IS NULL THEN f.w1 ELSE (1 - s.share) * f.w1 * exp(-s.eta * s.b1) / (f.w1 * exp(-s.eta * s.b1) + (1 - f.w1) * exp(-s.eta * s.b2)) + s.share / 2 END AS w
    FROM fo f JOIN sn s ON s.share = f.share AND s.horizon = f.horizon AND s.target = f.target AND s.pos = f.pos + 1) s)"""


_FOLD = _fold("[0.004::DOUBLE]").replace("WITH ", "")


@query(f"WITH RECURSIVE {_FOLD} SELECT horizon, target, date, round(prediction, 5) + 0.0::DOUBLE AS prediction, round(w1, 5) AS weight FROM fo")
def fixed_share_weights(spark: SparkSession, d: str) -> DataFrame:
    out = experts.fixed_share(T.naive_forecasts(spark, d), EXPERTS, [0.004])
    return rounded(out.select("horizon", "target", "date", "prediction", F.col("weights")[0].alias("weight")), 5)


_GRID = _fold("[0.0::DOUBLE, 0.004::DOUBLE, 0.02::DOUBLE]")


@query(f"""WITH RECURSIVE {_GRID}, al AS (SELECT share, 'share' AS model, horizon, target, actual, prediction FROM fo UNION ALL SELECT share, 'zero', horizon, target, actual, 0 FROM fo),
me AS (SELECT share, horizon, model, target, sqrt(avg((prediction - actual) ** 2)) AS rmse FROM al GROUP BY ALL),
ba AS (SELECT *, max(rmse) FILTER (model = 'zero') OVER (PARTITION BY share, horizon, target) AS base FROM me)
SELECT share, horizon, model, round(avg(1 - rmse / base), 5) AS mean_skill, count(*) FILTER (1 - rmse / base > 0) AS n_better, count(*) AS n_targets FROM ba WHERE model != 'zero' AND base > 0 GROUP BY ALL""")
def share_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    out = experts.fixed_share(T.naive_forecasts(spark, d), EXPERTS, [0.0, 0.004, 0.02])
    both = F.array(F.struct(F.lit("share").alias("model"), F.col("prediction")), F.struct(F.lit("zero").alias("model"), F.lit(0.0).alias("prediction")))
    rows = out.select("share", "horizon", F.col("target").alias("variable"), "actual", F.explode(both).alias("m")).select("share", "horizon", "variable", "actual", "m.*")
    got = metrics.metrics(rows, ["share", "horizon", "model", "variable"])
    return rounded(metrics.skill_summary(got, "zero", ["share", "horizon"]), 5)


# --- models ---

from lagwise.operators import walkforward as W  # noqa: E402
from lagwise.plans import experiments as E  # noqa: E402
from lagwise.plans import reports as R  # noqa: E402

SPEC = W.Window_(lags=5, min_train=600, refit_every=20, horizons=(1, 5, 10, 20))
SETTINGS = E.Settings(spec=SPEC, alpha=0.02, overlay_alpha=0.02, threshold=0.02, min_snapshots=3, overlay_min_train=200, mask={"min_frequency": 0.5, "min_sign": 0.6, "min_retention": 0.25, "min_contributions": 20, "max_edges": 3})
CANDIDATES = list(PORTS)
#: What v4 takes over from v3, those of it that are its experts, and its comparisons.
V4_MODELS = ["ar", "financial_direct_sparse", "candidate_overlay_survival", "candidate_overlay_adaptive"]
V4_EXPERTS = ["financial_direct_sparse", "candidate_overlay_survival"]
V4_PAIRS = [("ar", "financial_direct_sparse"), ("financial_direct_sparse", "candidate_overlay_survival"), ("financial_direct_sparse", "online_fixed_share"), ("candidate_overlay_survival", "online_fixed_share")]


def model_panel(spark: SparkSession, d: str) -> DataFrame:
    """(date, series, x): returns of the financial series and daily changes of the ports' capacity, on common days."""
    fin = T.returns(spark, d).select("date", "series", F.col("value").alias("x"))
    ports = T.facts(spark, d).select("date", F.replace(F.lower("portname"), F.lit(" "), F.lit("_")).alias("series"), (F.col("capacity") / 997.0).alias("value"))
    ports = X.transform(P.filled_on_calendar(ports), "difference").filter("value is not null").select("date", "series", F.col("value").alias("x"))
    both = fin.unionByName(ports)
    n = len(T.SERIES) + len(CANDIDATES)
    whole = both.groupBy("date").agg(F.count("x").alias("c")).filter(F.col("c") == n).select("date")
    return both.join(whole, "date", "left_semi")


@query(f"""WITH {T.RETURNS}, z AS (SELECT row_id AS i, value AS y, lag(value) OVER (ORDER BY row_id) AS z FROM rets WHERE series = 'high'),
b AS (SELECT ceil(greatest(0, i + 1 - 600) / 150.0)::INT AS k, count(*) AS n, sum(z) AS sz, sum(y) AS sy, sum(z * z) AS szz, sum(z * y) AS szy, sum(y * y) AS syy FROM z WHERE z IS NOT NULL GROUP BY 1)
SELECT k, (sum(n) OVER w)::DOUBLE AS n, round(sum(sz) OVER w, 5) + 0.0::DOUBLE AS sz, round(sum(sy) OVER w, 5) + 0.0::DOUBLE AS sy, round(sum(szz) OVER w, 5) AS szz, round(sum(szy) OVER w, 5) AS szy, round(sum(syy) OVER w, 5) AS syy FROM b WINDOW w AS (ORDER BY k)""")
def gram_prefix(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np
    import pandas as pd

    panel = E.indexed(T.returns(spark, d).select("date", "series", F.col("value").alias("x")))
    spec = W.Window_(1, 600, 150, (1,))
    out = W.prefixes(W.targets(panel, ["high"], (1,)).join(W.design(panel, ["high"], 1), "i"), 1, ["high"], spec)

    def unpack(parts):
        for part in parts:
            m = [np.frombuffer(x).reshape(3, 3) for x in part["m"]]
            yield pd.DataFrame([(k, x[0, 0], x[0, 1], x[0, 2], x[1, 1], x[1, 2], x[2, 2]) for k, x in zip(part["k"], m, strict=True)], columns=["k", "n", "sz", "sy", "szz", "szy", "syy"])

    return rounded(out.mapInPandas(unpack, "k int, n double, sz double, sy double, szz double, szy double, syy double"), 5)


@query(f"""WITH {T.RETURNS}, z AS (SELECT series, date, row_id AS i, value AS y, lag(value) OVER (PARTITION BY series ORDER BY row_id) AS z FROM rets),
r AS (SELECT unnest(generate_series(0, 100))::INT AS k),
f AS (SELECT series, k, count(*) AS n, corr(z, y) AS c, avg(z) AS mz, avg(y) AS my, stddev_pop(z) AS sz, stddev_pop(y) AS sy FROM z JOIN r ON i <= 600 + 150 * k - 1 WHERE z IS NOT NULL GROUP BY ALL)
SELECT date, z.series AS target, round(my + sy * c * n / (n + 1.0) * (z - mz) / sz, 5) + 0.0::DOUBLE AS prediction, round(y, 5) + 0.0::DOUBLE AS actual FROM z JOIN f ON z.series = f.series AND f.k = (i - 600) // 150 WHERE i >= 600""")
def ridge_ar1_walkforward(spark: SparkSession, d: str) -> DataFrame:
    s = E.Settings(spec=W.Window_(1, 600, 150, (1,)))
    panel = E.indexed(T.returns(spark, d).select("date", "series", F.col("value").alias("x")))
    outcome = W.targets(panel, T.SERIES, (1,))
    ar = E.autoregression(panel, outcome, T.SERIES, s, E.Store())
    return rounded(E.joined({"ar": W.forecast(ar.effects)}, outcome).select("date", "target", "prediction", "actual"), 5)


def _scores(out: dict[str, DataFrame]) -> DataFrame:
    rows = out["forecasts"].withColumnRenamed("target", "variable").withColumn("segment", F.lit("all"))
    return metrics.skill_against(metrics.metrics(rows, ["segment", "horizon", "model", "variable"]), "ar", ["segment", "horizon", "variable"])


@query()
def empirical_v1(spark: SparkSession, d: str) -> DataFrame:
    return _scores(E.run_v1(model_panel(spark, d), T.SERIES, CANDIDATES, SETTINGS))


@query()
def empirical_v2(spark: SparkSession, d: str) -> DataFrame:
    return _scores(E.run_v2(model_panel(spark, d), T.SERIES, CANDIDATES, SETTINGS))


@query()
def empirical_v3(spark: SparkSession, d: str) -> DataFrame:
    return _scores(E.run_v3(model_panel(spark, d), T.SERIES, CANDIDATES, SETTINGS))


def _v4(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """v3's survival and gates, and the forecasts of v3 with those of v4 added."""
    store = E.Store()
    v3 = E.run_v3(model_panel(spark, d), T.SERIES, CANDIDATES, SETTINGS, store)
    paths = store.keep(v3["forecasts"].filter(F.col("model").isin(V4_MODELS)))
    return v3 | {"forecasts": store.keep(E.run_v4(paths, V4_EXPERTS)["forecasts"])}


@query()
def empirical_v4(spark: SparkSession, d: str) -> DataFrame:
    return _scores(_v4(spark, d))


@query()
def overlay_survival(spark: SparkSession, d: str) -> DataFrame:
    return E.run_v3(model_panel(spark, d), T.SERIES, CANDIDATES, SETTINGS)["survival"]


@query()
def overlay_gate_history(spark: SparkSession, d: str) -> DataFrame:
    return E.run_v3(model_panel(spark, d), T.SERIES, CANDIDATES, SETTINGS)["gates"]


@query()
def edge_snapshots_lasso(spark: SparkSession, d: str) -> DataFrame:
    return E.run_v1(model_panel(spark, d), T.SERIES, CANDIDATES, SETTINGS)["snapshots"]


@query()
def rolling_edge_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return E.rolling_edges(model_panel(spark, d), T.SERIES + CANDIDATES, 400, 20, SPEC.lags, 0.02)


@query()
def report_markdown(spark: SparkSession, d: str) -> DataFrame:
    out = _v4(spark, d)
    rows = out["forecasts"].withColumnRenamed("target", "variable")
    tests = inference.nested_tests(out["forecasts"], V4_PAIRS, base_lags=5, horizons=list(SPEC.horizons))

    def latest(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(df.groupBy("h").agg(F.max("as_of").alias("as_of"))), ["h", "as_of"], "left_semi")

    return R.markdown(metrics.metrics(rows, ["horizon", "model", "variable"]), tests, latest(out["survival"]), latest(out["gates"]))
