"""Panels, facts and forecasts made from the star-schema tables; each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagwise.operators import panel as P
from lagwise.operators.metrics import correlation
from lagwise.operators.transforms import along

PRIORITIES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}
SERIES = sorted(PRIORITIES.values())
#: No divisor of a power of ten, so that rounded values have no ties.
UNIT = 999_983.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, date, value): order totals in millions by priority, on every day."""
    o = read(spark, sf_dir, "orders")
    name = F.coalesce(*(F.when(F.col("o_orderpriority") == k, F.lit(v)) for k, v in PRIORITIES.items()), F.lower("o_orderpriority"))
    totals = o.groupBy(name.alias("series"), F.col("o_orderdate").cast("date").alias("date")).agg((F.sum("o_totalprice") / UNIT).alias("value"))
    return P.filled_on_calendar(totals)


_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITIES.items())
DAILY = f"""
totals AS (SELECT CASE o_orderpriority {_CASE} ELSE lower(o_orderpriority) END AS series, o_orderdate::DATE AS date, sum(o_totalprice) / {UNIT} AS value FROM orders GROUP BY 1, 2),
days AS (SELECT unnest(generate_series((SELECT min(date) FROM totals), (SELECT max(date) FROM totals), INTERVAL 1 DAY))::DATE AS date),
daily AS (SELECT s.series, d.date, coalesce(t.value, 0) AS value FROM days d CROSS JOIN (SELECT DISTINCT series FROM totals) s LEFT JOIN totals t ON t.series = s.series AND t.date = d.date)"""


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, date, value, row_id): day-to-day differences, the first day left out."""
    d = daily(spark, sf_dir)
    d = d.withColumn("value", F.col("value") - F.lag("value").over(along(["series"]))).filter("value is not null")
    return P.numbered(d, ["series"])


RETURNS = (
    DAILY
    + """,
diffs AS (SELECT series, date, value - lag(value) OVER (PARTITION BY series ORDER BY date) AS value FROM daily),
rets AS (SELECT series, date, value, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS row_id FROM diffs WHERE value IS NOT NULL)"""
)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, portname, capacity, n_total) by ship date and region of the supplier; the dimensions are small."""
    where = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", F.col("l_shipdate").cast("date").alias("date")).join(where, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("date", F.col("r_name").alias("portname")).agg(F.sum("l_quantity").alias("capacity"), F.count(F.lit(1)).alias("n_total"))


FACTS = """
facts AS (SELECT l_shipdate::DATE AS date, r_name AS portname, sum(l_quantity) AS capacity, count(*) AS n_total
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"""


def naive_forecasts(spark: SparkSession, sf_dir: str, horizons: tuple[int, ...] = (1, 5)) -> DataFrame:
    """(horizon, model, date, target, actual, prediction): the last value and the trailing mean of 20 rows, times h, and zero."""
    w = along(["series"], "row_id")
    past = w.rowsBetween(-20, -1)
    rows = returns(spark, sf_dir).withColumns({"last": F.lag("value").over(w), "mean": F.when(F.count("value").over(past) == 20, F.round(F.avg("value").over(past), 9))})
    sums = [F.struct(F.lit(h).alias("horizon"), F.when(F.count("value").over(w.rowsBetween(0, h - 1)) == h, F.sum("value").over(w.rowsBetween(0, h - 1))).alias("actual")) for h in horizons]
    rows = rows.withColumn("t", F.array(*sums)).withColumn("t", F.explode("t")).filter("t.actual is not null and mean is not null")
    models = F.array(F.struct(F.lit("last").alias("model"), F.col("last").alias("p")), F.struct(F.lit("mean").alias("model"), F.col("mean").alias("p")), F.struct(F.lit("zero").alias("model"), F.lit(0.0).alias("p")))
    rows = rows.withColumn("m", F.explode(models))
    return rows.select(F.col("t.horizon").alias("horizon"), F.col("m.model").alias("model"), "date", F.col("series").alias("target"), F.col("t.actual").alias("actual"), (F.col("m.p") * F.col("t.horizon")).alias("prediction"))


FORECASTS = (
    RETURNS
    + """,
past AS (SELECT *, lag(value) OVER w AS last,
  CASE WHEN count(value) OVER (PARTITION BY series ORDER BY row_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 20
    THEN round(avg(value) OVER (PARTITION BY series ORDER BY row_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 9) END AS mean,
  sum(value) OVER (PARTITION BY series ORDER BY row_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s5,
  count(value) OVER (PARTITION BY series ORDER BY row_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS c5
  FROM rets WINDOW w AS (PARTITION BY series ORDER BY row_id)),
sums AS (SELECT 1 AS horizon, series, date, value AS actual, last, mean FROM past WHERE mean IS NOT NULL
  UNION ALL SELECT 5, series, date, s5, last, mean FROM past WHERE mean IS NOT NULL AND c5 = 5),
forecasts AS (SELECT horizon, 'last' AS model, date, series AS target, actual, last * horizon AS prediction FROM sums
  UNION ALL SELECT horizon, 'mean', date, series, actual, mean * horizon FROM sums
  UNION ALL SELECT horizon, 'zero', date, series, actual, 0.0::DOUBLE FROM sums)"""
)

BLOCK = 120


def edge_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, source, target, strength, signed_weight): one-step lag correlations in blocks of BLOCK rows."""
    r = returns(spark, sf_dir)
    past = r.select(F.col("series").alias("source"), (F.col("row_id") + 1).alias("row_id"), F.col("value").alias("x"))
    rows = r.select(F.col("series").alias("target"), "row_id", "date", F.col("value").alias("y")).join(past, "row_id").withColumn("block", F.floor(F.col("row_id") / BLOCK))
    out = rows.groupBy("block", "source", "target").agg(F.max("date").alias("date"), correlation("x", "y").alias("signed_weight"), F.count(F.lit(1)).alias("n")).filter("n > 2 and signed_weight is not null")
    return out.select("date", "source", "target", F.abs("signed_weight").alias("strength"), "signed_weight")


SNAPSHOTS = (
    RETURNS
    + f""",
pairs AS (SELECT a.row_id, a.date, b.series AS source, a.series AS target, b.value AS x, a.value AS y FROM rets a JOIN rets b ON a.row_id = b.row_id + 1),
blocks AS (SELECT row_id // {BLOCK} AS block, source, target, max(date) AS date, corr(x, y) AS signed_weight, count(*) AS n FROM pairs GROUP BY ALL),
snapshots AS (SELECT date, source, target, abs(signed_weight) AS strength, signed_weight FROM blocks WHERE n > 2 AND signed_weight IS NOT NULL AND NOT isnan(signed_weight))"""
)


def edge_contributions(spark: SparkSession, sf_dir: str, weight: float = -0.3) -> DataFrame:
    """(realized_date, source, target, loss_improvement): squared loss against 0 of weight * x(t - 1)."""
    r = returns(spark, sf_dir)
    past = r.select(F.col("series").alias("source"), (F.col("row_id") + 1).alias("row_id"), F.col("value").alias("x"))
    rows = r.select(F.col("series").alias("target"), "row_id", F.col("date").alias("realized_date"), F.col("value").alias("y")).join(past, "row_id")
    y, x = F.col("y"), F.col("x")
    return rows.select("realized_date", "source", "target", (y * y - (y - weight * x) * (y - weight * x)).alias("loss_improvement"))


CONTRIBUTIONS = """
contributions AS (SELECT date AS realized_date, source, target, y * y - (y + 0.3 * x) * (y + 0.3 * x) AS loss_improvement FROM pairs)"""


def snapshot_dates(snapshots: DataFrame) -> DataFrame:
    """as_of: the day after each snapshot date."""
    return snapshots.select(F.date_add("date", 1).alias("as_of")).distinct()


AS_OF = """
asat AS (SELECT DISTINCT date + 1 AS as_of FROM snapshots)"""
