"""Feature engineering (F1-F18): scalar ratios, tiers and past-only window features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rnd, rnd_signed, safe_div
from ..params import DEFAULT_FEAT, FeatureParams
from .slices import HALO, SLICE, cut, slice_offsets, with_halo

# Columns that describe what happened after the event; they must never feed a model.
POST_EVENT_COLUMNS = (
    "actual_lead_time_days", "delay_occurred", "delay_days", "lead_time_variance_days",
    "lead_time_risk", "service_risk",
)

PAIR_KEYS = ("supplier_id", "product_id")
ORDER_KEYS = ("date", "event_id")


def inventory_features(df: DataFrame) -> DataFrame:
    """Coverage (4 dp; null when demand is 0), gap, shortage flag."""
    return df.select(
        "*",
        rnd(safe_div(F.col("inventory_units"), F.col("demand_units")), 4).alias("inventory_coverage_ratio"),
        (F.col("demand_units") - F.col("inventory_units")).alias("inventory_gap_units"),
        (F.col("inventory_units") < F.col("demand_units")).cast("int").alias("shortage_flag"),
    )


def capacity_supplier_features(df: DataFrame) -> DataFrame:
    """Capacity utilisation (alias demand pressure) and supplier risk, 4 dp."""
    util = rnd(safe_div(F.col("demand_units"), F.col("supplier_capacity_units")), 4)
    return df.select(
        "*",
        util.alias("capacity_utilization"),
        util.alias("demand_pressure"),
        rnd(F.lit(1.0) - F.col("supplier_reliability"), 4).alias("supplier_risk_score"),
    )


def cost_features(df: DataFrame) -> DataFrame:
    """Primary cost per unit, secondary and air-freight premiums, 2 dp."""
    return df.select(
        "*",
        rnd(safe_div(F.col("estimated_primary_cost_usd"), F.col("demand_units")), 2).alias("cost_per_demand_unit"),
        rnd_signed(F.col("estimated_secondary_cost_usd") - F.col("estimated_primary_cost_usd"), 2)
        .alias("secondary_cost_difference"),
        rnd_signed(F.col("air_freight_cost_usd") - F.col("transport_cost_usd"), 2).alias("air_freight_premium"),
    )


def lead_time_features(df: DataFrame, p: FeatureParams = DEFAULT_FEAT) -> DataFrame:
    """Lead-time variance and its tier (post-event columns)."""
    var = F.col("actual_lead_time_days") - F.col("planned_lead_time_days")
    return df.select(
        "*",
        var.alias("lead_time_variance_days"),
        F.when(var <= p.lead_low_max, "Low").when(var <= p.lead_medium_max, "Medium").otherwise("High")
        .alias("lead_time_risk"),
    )


HISTORY_COLUMNS = ("delay_days", "delay_occurred", "demand_units", "inventory_units")


def history_features(df: DataFrame, p: FeatureParams = DEFAULT_FEAT, slices: int | None = None) -> DataFrame:
    """Lag-1 and trailing means over the previous ``window`` rows of each (supplier, product)
    pair; the current row is never included.  A pair of more rows than a slice is cut by (date, id), and
    each slice gets copies of the ``window`` rows before it, so no task holds a whole hot pair."""
    x = with_halo(cut(df, list(PAIR_KEYS), list(ORDER_KEYS), slices), p.window, list(HISTORY_COLUMNS))
    w = Window.partitionBy(*PAIR_KEYS, SLICE).orderBy(*ORDER_KEYS)
    prev = w.rowsBetween(-p.window, -1)
    return x.select(
        *df.columns, HALO,
        F.coalesce(F.lag("delay_days", 1).over(w), F.lit(0)).cast("long").alias("previous_delay_days"),
        F.coalesce(F.lag("delay_occurred", 1).over(w), F.lit(0)).cast("int").alias("previous_delay_flag"),
        rnd(F.coalesce(F.avg("delay_days").over(prev), F.lit(0.0)), 2).alias("rolling_average_delay"),
        rnd(F.coalesce(F.avg("demand_units").over(prev), F.col("demand_units").cast("double")), 1)
        .alias("rolling_average_demand"),
        rnd(F.coalesce(F.avg("inventory_units").over(prev), F.col("inventory_units").cast("double")), 1)
        .alias("rolling_average_inventory"),
    ).where(~F.col(HALO)).drop(HALO)


def supplier_past_delay_rate(df: DataFrame, supplier_col: str = "supplier_id", date_col: str = "date",
                             id_col: str = "event_id", flag_col: str = "delay_occurred",
                             out: str = "historical_delay_rate", slices: int | None = None,
                             like: Callable[[int], DataFrame] | None = None) -> DataFrame:
    """share of delayed shipments among all strictly earlier shipments of the supplier (by date, then id).

    Running sums per (supplier, slice): a supplier of more rows than a slice is cut by (date, id), also
    within one day, and the totals of its earlier slices come as a small table.  No history -> 0; 4 dp.  ``like`` is for ``cut``.
    """
    flag = F.coalesce(F.col(flag_col).cast("long"), F.lit(0))
    x = slice_offsets(cut(df, [supplier_col], [date_col, id_col], slices, like=like),
                      {"_pn": F.lit(1), "_pd": flag}, [flag_col])
    wi = (Window.partitionBy(supplier_col, SLICE).orderBy(date_col, id_col)
          .rowsBetween(Window.unboundedPreceding, -1))
    n = F.col("_pn") + F.coalesce(F.count(F.lit(1)).over(wi), F.lit(0))
    d = F.col("_pd") + F.coalesce(F.sum(flag).over(wi), F.lit(0))
    return x.select(*df.columns, rnd(F.when(n > 0, d / n).otherwise(F.lit(0.0)), 4).alias(out))


def service_risk_tier(df: DataFrame, p: FeatureParams = DEFAULT_FEAT, out: str = "service_risk_tier") -> DataFrame:
    """F16: High if delayed or ratio < .70; Medium if ratio < 1 or reliability < .93; else Low."""
    ratio = safe_div(F.col("inventory_units"), F.col("demand_units"))
    return df.withColumn(
        out,
        F.when((F.col("delay_occurred") == 1) | (ratio < p.service_high_ratio), "High")
        .when((ratio < p.service_medium_ratio) | (F.col("supplier_reliability") < p.service_medium_reliability), "Medium")
        .otherwise("Low"))


def derived_costs(df: DataFrame) -> DataFrame:
    """primary and secondary cost estimates and the inventory/demand ratio (3 dp)."""
    prem = F.col("secondary_supplier_premium_pct")
    return df.select(
        "*",
        rnd(F.col("demand_units") * F.col("unit_cost_usd") + F.col("transport_cost_usd"), 2).alias("derived_primary_cost"),
        rnd(F.col("demand_units") * F.col("unit_cost_usd") * (F.lit(1) + prem)
            + F.col("transport_cost_usd") * (F.lit(1) + prem / 2), 2).alias("derived_secondary_cost"),
        rnd(safe_div(F.col("inventory_units"), F.col("demand_units")), 3).alias("derived_inventory_ratio"),
    )


def engineer_all_features(df: DataFrame, p: FeatureParams = DEFAULT_FEAT) -> DataFrame:
    """F1-F14 in order as one lazy plan (one shuffle for the pair window)."""
    out = inventory_features(df)
    out = capacity_supplier_features(out)
    out = cost_features(out)
    out = lead_time_features(out, p)
    return history_features(out, p)


def verify_no_leakage(feature_names) -> None:
    """C14: the model feature list must not contain post-event columns."""
    bad = sorted(set(feature_names) & set(POST_EVENT_COLUMNS))
    if bad:
        raise ValueError(f"post-event columns in feature list: {bad}")
