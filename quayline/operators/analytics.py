"""Descriptive analytics (A1-A19): wide aggregates, group summaries and correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rnd, rnd_signed
from .scan import exact_quantiles, long_values

# fixed values: columns profiled and correlated
DESCRIBE_COLUMNS = ("demand_units", "inventory_units", "supplier_capacity_units", "planned_lead_time_days",
                    "actual_lead_time_days", "delay_days", "unit_cost_usd", "transport_cost_usd",
                    "secondary_supplier_premium_pct", "supplier_reliability", "estimated_primary_cost_usd",
                    "air_freight_cost_usd")


def describe(df: DataFrame, cols=DESCRIBE_COLUMNS) -> DataFrame:
    """A1: mean, sample std, min, quartiles, max and IQR per column (long form)."""
    lv = long_values(df, list(cols))
    # mean to 6 dp from an exact integer sum of micro-units (half-up), so it does not
    # depend on the order in which partial sums are combined
    m = lv.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"),
                                      F.sum(F.round(F.col("value") * 1e6).cast("decimal(38,0)")).alias("_s6"),
                                      F.stddev_samp("value").alias("_std"), F.min("value").alias("min_value"),
                                      F.max("value").alias("max_value"))
    q = exact_quantiles(df, list(cols), [0.25, 0.5, 0.75]).groupBy("column_name").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in ((0.25, "_q1"), (0.5, "_q2"), (0.75, "_q3"))])
    x = m.join(q, "column_name")
    mean = (F.expr("(2 * _s6 + n) div (2 * n)") / 1e6).alias("mean")
    return x.select("column_name", "n", mean, rnd("_std", 6).alias("std"),
                    "min_value", rnd_signed("_q1", 6).alias("q1"), rnd_signed("_q2", 6).alias("median"),
                    rnd_signed("_q3", 6).alias("q3"), "max_value", rnd_signed(F.col("_q3") - F.col("_q1"), 6).alias("iqr"))


def equal_width_hist(df: DataFrame, col: str, bins: int, name: str) -> DataFrame:
    """A3: equal-width histogram over the column's min-max (bounds as a 1-row broadcast)."""
    b = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    x = df.select(col).filter(F.col(col).isNotNull()).crossJoin(F.broadcast(b))
    idx = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)))
    return x.groupBy(F.lit(name).alias("histogram"), idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def trailing_daily(df: DataFrame, date_col: str, value: str, rows: int = 7) -> DataFrame:
    """A5: total per date and the trailing mean over ``rows`` date rows.

    The window runs over the per-date aggregate (one row per date), not row data."""
    d = df.groupBy(date_col).agg(F.sum(value).alias("total"))
    w = Window.orderBy(date_col).rowsBetween(-(rows - 1), 0)
    return d.select(date_col, "total", rnd(F.avg("total").over(w), 4).alias("trailing_mean"))


def five_number(df: DataFrame, col: str, by: str) -> DataFrame:
    """Min, quartiles and max of ``col`` per group (exact, distributed)."""
    q = exact_quantiles(df, [col], [0.0, 0.25, 0.5, 0.75, 1.0], by=[by])
    return q.groupBy(F.col(by).cast("string").alias("group_value")).agg(
        *[rnd_signed(F.max(F.when(F.col("prob") == p, F.col("quantile"))), 6).alias(n)
          for p, n in ((0.0, "min"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "max"))])


def correlations(df: DataFrame, cols=DESCRIBE_COLUMNS) -> DataFrame:
    """Upper-triangle Pearson correlations in one aggregate, unpivoted."""
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs])
    arr = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
                             rnd_signed(F.col(f"{a}__{b}"), 6).alias("pearson")) for a, b in pairs])
    return wide.select(F.explode(arr).alias("r")).select("r.*")


def value_quartile_rates(df: DataFrame, col: str, flag: str) -> DataFrame:
    """Flag rate by value quartile of ``col`` (right-closed edges, ties stay together)."""
    q = exact_quantiles(df, [col], [0.25, 0.5, 0.75]).groupBy().agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in ((0.25, "_e1"), (0.5, "_e2"), (0.75, "_e3"))])
    x = df.select(col, flag).crossJoin(F.broadcast(q))
    v = F.col(col)
    quart = F.when(v <= F.col("_e1"), 1).when(v <= F.col("_e2"), 2).when(v <= F.col("_e3"), 3).otherwise(4)
    return x.groupBy(quart.alias("quartile")).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg(flag), 6).alias("rate"))
