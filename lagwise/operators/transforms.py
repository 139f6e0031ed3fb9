"""Positional transforms of dated series in long form: (series, date, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("level", "difference", "log_return", "negative_log_return", "pct_change")


def along(keys: list[str], order: str = "date"):
    return Window.partitionBy(*keys).orderBy(order)


def coerce(c: Column | str) -> Column:
    """A number, or null for what is none; NaN and infinities are null as well."""
    v = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def transform(df: DataFrame, method: str, value: str = "value", keys: list[str] | None = None, order: str = "date", out: str | None = None) -> DataFrame:
    """Applies one named transform along each series; steps are rows, not days.

    log returns need positive values: a value <= 0 raises when it is computed, as a silent null
    would look like a gap. A change against 0 is null.
    """
    w = along(keys or ["series"], order)
    x = F.col(value)
    log = F.when(x <= 0, F.raise_error(F.lit("log returns need positive values")).cast("double")).otherwise(F.ln(x))
    made = {
        "level": lambda: x,
        "difference": lambda: x - F.lag(x).over(w),
        "log_return": lambda: F.col("__log") - F.lag("__log").over(w),
        "negative_log_return": lambda: -(F.col("__log") - F.lag("__log").over(w)),
        "pct_change": lambda: F.try_divide(x, F.lag(x).over(w)) - 1,
    }
    if method not in made:
        raise ValueError(f"no transform {method!r}; there are {', '.join(METHODS)}")
    if "log" in method:
        df = df.withColumn("__log", log)
    return df.withColumn(out or value, made[method]()).drop("__log")


def transform_by(df: DataFrame, methods: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """Each series by its own method, in one pass over one window; other series are left out."""
    w = along(keys or ["series"])
    method = F.coalesce(*(F.when(F.col("series") == k, F.lit(v)) for k, v in methods.items()))
    if bad := set(methods.values()) - set(METHODS):
        raise ValueError(f"no transform {sorted(bad)}")
    df = df.withColumn("__m", method).filter("__m is not null")
    logs = F.col("__m").isin("log_return", "negative_log_return")
    df = df.withColumn("__log", F.when(logs & (F.col("value") <= 0), F.raise_error(F.lit("log returns need positive values")).cast("double")).when(logs, F.ln("value")))
    x, before = F.col("value"), F.lag("value").over(w)
    step = F.col("__log") - F.lag("__log").over(w)
    made = F.when(F.col("__m") == "level", x).when(F.col("__m") == "difference", x - before).when(F.col("__m") == "log_return", step).when(F.col("__m") == "negative_log_return", -step).otherwise(F.try_divide(x, before) - 1)
    return df.withColumn("value", made).drop("__m", "__log")


def log1p(c: str) -> Column:
    """log(1 + x); a negative value raises."""
    x = F.col(c)
    return F.when(x < 0, F.raise_error(F.lit("log1p needs values of 0 or more")).cast("double")).otherwise(F.log1p(x))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def days(date: Column) -> Column:
    """A date or timestamp as days, with the time of day as a fraction, by the session's calendar."""
    at = date.cast("timestamp_ntz")
    seconds = F.hour(at) * 3600 + F.minute(at) * 60 + F.extract(F.lit("SECONDS"), at).cast("double")
    return F.datediff(at, F.lit("1970-01-01").cast("date")) + seconds / 86400.0


def decay(as_of: Column, date: Column, half_life: float) -> Column:
    """Weight of a date as of another: a half for each half-life of days, 1 for dates to come."""
    age = F.greatest(days(as_of) - days(date), F.lit(0.0))
    return F.exp(-F.ln(F.lit(2.0)) * age / F.lit(max(float(half_life), 1e-9)))


def lag_design(df: DataFrame, lags: int, value: str = "value", keys: list[str] | None = None, order: str = "row_id") -> DataFrame:
    """Columns lag_1 ... lag_n of each series; rows without all of them are left out."""
    if lags < 1:
        raise ValueError("lags must be 1 or more")
    w = along(keys or ["series"], order)
    out = df.withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in range(1, lags + 1)} | {"__n": F.row_number().over(w)})
    return out.filter(F.col("__n") > lags).drop("__n")


def forward_sums(df: DataFrame, horizons: list[int], value: str = "value", keys: list[str] | None = None, order: str = "row_id", date: str = "date") -> DataFrame:
    """(..., horizon, target, realized_date): sums of the next h values from each row on, where complete."""
    if not horizons or min(horizons) < 1:
        raise ValueError("horizons must be 1 or more")
    w = along(keys or ["series"], order)

    def one(h: int) -> Column:
        frame = w.rowsBetween(0, h - 1)
        return F.struct(F.lit(h).alias("horizon"), F.when(F.count(value).over(frame) == h, F.sum(value).over(frame)).alias("target"), F.lead(date, h - 1).over(w).alias("realized_date"))

    out = df.withColumn("__t", F.array(*(one(h) for h in horizons))).withColumn("__t", F.explode("__t"))
    return out.select(*df.columns, "__t.*").filter("target is not null")
