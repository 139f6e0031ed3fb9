"""Tables behind reports and plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def skill_table(metrics: DataFrame, models: list[str], value: str = "rmse_skill_vs_ar", by: str = "horizon") -> DataFrame:
    """Mean of a metric over variables, a row for each `by`, a column a model."""
    means = metrics.groupBy(by, "model").agg(F.avg(value).alias("v"))
    return means.groupBy(by).pivot("model", models).agg(F.first("v"))


def lines_of(df: DataFrame, limit: int = 200) -> list[str]:
    """A small table as Markdown; more than `limit` rows are an error, not a cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report's table has more than {limit} rows")
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(show(v) for v in r) + " |" for r in rows)]


def markdown(metrics: DataFrame, tests: DataFrame, survival: DataFrame | None = None, gates: DataFrame | None = None, title: str = "Results", more: dict[str, DataFrame] | None = None) -> DataFrame:
    """(line_no, line) of a report: errors by horizon and model, comparisons, the strongest edges and gates, and more tables by title."""
    from lagwise.operators.inference import comparison_summary

    out = [f"# {title}", "", "## Errors by horizon and model", ""]
    out += lines_of(metrics.groupBy("horizon", "model").agg(F.avg("rmse").alias("mean_rmse"), F.avg("directional_accuracy").alias("direction")).orderBy("horizon", "model"))
    out += ["", "## Comparisons", "", *lines_of(comparison_summary(tests).orderBy("comparison"))]
    if survival is not None:
        out += ["", "## Edges", "", *lines_of(survival.orderBy(F.desc("survival_score"), F.desc("selection_frequency"), "source", "target").limit(15))]
    if gates is not None:
        out += ["", "## Gates", "", *lines_of(gates.orderBy(F.desc("gate"), "target").limit(8))]
    for heading, df in (more or {}).items():
        out += ["", f"## {heading}", "", *lines_of(df)]
    spark = metrics.sparkSession
    return spark.createDataFrame(list(enumerate(out, 1)), "line_no int, line string")


# Plot-ready tables: drawing is left to the reader's tools.


def skill_heatmap(metrics: DataFrame, models: list[str]) -> DataFrame:
    return metrics.groupBy("variable").pivot("model", models).agg(F.first("rmse_skill_vs_ar"))


def incremental_bar(metrics: DataFrame, base: str, challenger: str) -> DataFrame:
    """Per variable 1 - rmse(challenger) / rmse(base)."""
    rmse = lambda m: F.max(F.when(F.col("model") == m, F.col("rmse")))
    return metrics.groupBy("variable").agg((1 - F.try_divide(rmse(challenger), rmse(base))).alias("skill")).orderBy(F.desc("skill"))


def edge_lifecycle(snapshots: DataFrame, source: str, target: str) -> DataFrame:
    return snapshots.filter((F.col("source") == source) & (F.col("target") == target)).select("date", "strength", "signed_weight").orderBy("date")


def network(snapshots: DataFrame, n: int = 10) -> DataFrame:
    """The n strongest edges of the last snapshot."""
    last = snapshots.agg(F.max("date").alias("last"))
    rows = snapshots.join(F.broadcast(last), F.col("date") == F.col("last")).filter(F.col("source") != F.col("target"))
    return rows.orderBy(F.desc("strength"), "source", "target").limit(n).select("source", "target", "strength", "signed_weight")


def weight_lifecycle(weights: DataFrame, target: str, experts: list[str]) -> DataFrame:
    return weights.filter(F.col("target") == target).groupBy("date").pivot("expert", experts).agg(F.last("weight")).orderBy("date")


def gate_lifecycle(gates: DataFrame, targets: list[str], horizon: int) -> DataFrame:
    return gates.filter(F.col("h") == horizon).groupBy("as_of").pivot("target", targets).agg(F.last("gate")).orderBy("as_of")


def survival_lifecycle(survival: DataFrame, source: str, target: str) -> DataFrame:
    own = survival.filter((F.col("source") == source) & (F.col("target") == target))
    return own.select("as_of", "selection_frequency", "sign_stability", "contribution_t_stat", "survival_score").orderBy("as_of")
