"""Feature-engineering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features
from ..sources import fixtures
from ..sources.fixtures_sql import with_ctes
from . import sqlbase as S
from .registry import ORACLE, register

R, RS = S.R, S.RS

_W = "PARTITION BY supplier_id, product_id ORDER BY date, event_id"


@register("feat_ratios", with_ctes("supply_events") + f"""
SELECT event_id,
  CASE WHEN demand_units = 0 THEN NULL ELSE {R('inventory_units / demand_units', 4)} END AS inventory_coverage_ratio,
  demand_units - inventory_units AS inventory_gap_units,
  CAST(inventory_units < demand_units AS INTEGER) AS shortage_flag,
  CASE WHEN supplier_capacity_units = 0 THEN NULL ELSE {R('demand_units / supplier_capacity_units', 4)} END AS capacity_utilization,
  CASE WHEN supplier_capacity_units = 0 THEN NULL ELSE {R('demand_units / supplier_capacity_units', 4)} END AS demand_pressure,
  {R('1.0 - supplier_reliability', 4)} AS supplier_risk_score
FROM supply_events
""")
def feat_ratios(spark, sf_dir):
    """F1-F5."""
    ev = fixtures.supply_events(spark, sf_dir)
    x = features.capacity_supplier_features(features.inventory_features(ev))
    return x.select("event_id", "inventory_coverage_ratio", "inventory_gap_units", "shortage_flag",
                    "capacity_utilization", "demand_pressure", "supplier_risk_score")


@register("feat_costs", with_ctes("supply_events") + f"""
SELECT event_id,
  CASE WHEN demand_units = 0 THEN NULL ELSE {R('estimated_primary_cost_usd / demand_units', 2)} END AS cost_per_demand_unit,
  {RS('estimated_secondary_cost_usd - estimated_primary_cost_usd', 2)} AS secondary_cost_difference,
  {RS('air_freight_cost_usd - transport_cost_usd', 2)} AS air_freight_premium
FROM supply_events
""")
def feat_costs(spark, sf_dir):
    """F6-F8."""
    x = features.cost_features(fixtures.supply_events(spark, sf_dir))
    return x.select("event_id", "cost_per_demand_unit", "secondary_cost_difference", "air_freight_premium")


@register("feat_lead_time_tier", with_ctes("supply_events") + """
SELECT event_id, actual_lead_time_days - planned_lead_time_days AS lead_time_variance_days,
  CASE WHEN actual_lead_time_days - planned_lead_time_days <= 0 THEN 'Low'
       WHEN actual_lead_time_days - planned_lead_time_days <= 3 THEN 'Medium' ELSE 'High' END AS lead_time_risk
FROM supply_events
""")
def feat_lead_time_tier(spark, sf_dir):
    """F9-F10."""
    x = features.lead_time_features(fixtures.supply_events(spark, sf_dir))
    return x.select("event_id", "lead_time_variance_days", "lead_time_risk")


@register("feat_service_tier", with_ctes("supply_events") + f"""
SELECT event_id,
  CASE WHEN delay_occurred = 1 OR inventory_units / demand_units < 0.7 THEN 'High'
       WHEN inventory_units / demand_units < 1.0 OR supplier_reliability < 0.93 THEN 'Medium' ELSE 'Low' END
    AS service_risk_tier,
  {R('demand_units * unit_cost_usd + transport_cost_usd', 2)} AS derived_primary_cost,
  {R('demand_units * unit_cost_usd * (1 + secondary_supplier_premium_pct) + transport_cost_usd * (1 + secondary_supplier_premium_pct / 2)', 2)}
    AS derived_secondary_cost,
  {R('inventory_units / demand_units', 3)} AS derived_inventory_ratio
FROM supply_events
""")
def feat_service_tier(spark, sf_dir):
    """F16-F17."""
    x = features.derived_costs(features.service_risk_tier(fixtures.supply_events(spark, sf_dir)))
    return x.select("event_id", "service_risk_tier", "derived_primary_cost", "derived_secondary_cost",
                    "derived_inventory_ratio")


@register("feat_lag", with_ctes("supply_events") + f"""
SELECT event_id,
  CAST(coalesce(lag(delay_days, 1) OVER ({_W}), 0) AS BIGINT) AS previous_delay_days,
  CAST(coalesce(lag(delay_occurred, 1) OVER ({_W}), 0) AS INTEGER) AS previous_delay_flag
FROM supply_events
""")
def feat_lag(spark, sf_dir):
    """F11."""
    x = features.history_features(fixtures.supply_events(spark, sf_dir))
    return x.select("event_id", "previous_delay_days", "previous_delay_flag")


_ROLL = f"""
SELECT event_id,
  {R(f'coalesce(avg(delay_days) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0.0)', 2)} AS rolling_average_delay,
  {R(f'coalesce(avg(demand_units) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), CAST(demand_units AS DOUBLE))', 1)}
    AS rolling_average_demand,
  {R(f'coalesce(avg(inventory_units) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), CAST(inventory_units AS DOUBLE))', 1)}
    AS rolling_average_inventory
FROM supply_events
"""


@register("feat_rolling", with_ctes("supply_events") + _ROLL)
def feat_rolling(spark, sf_dir):
    """Trailing means of the previous four rows of the pair."""
    x = features.history_features(fixtures.supply_events(spark, sf_dir))
    return x.select("event_id", "rolling_average_delay", "rolling_average_demand", "rolling_average_inventory")


@register("feat_supplier_past_rate", with_ctes("supply_events", extra=[("feat", S.FEAT)]) + """
SELECT event_id, historical_delay_rate FROM feat
""")
def feat_supplier_past_rate(spark, sf_dir):
    """past-only supplier delay rate."""
    x = features.supplier_past_delay_rate(fixtures.supply_events(spark, sf_dir))
    return x.select("event_id", "historical_delay_rate")


_ALL = ("inventory_coverage_ratio", "inventory_gap_units", "shortage_flag", "capacity_utilization", "demand_pressure",
        "supplier_risk_score", "cost_per_demand_unit", "secondary_cost_difference", "air_freight_premium",
        "lead_time_variance_days", "lead_time_risk", "previous_delay_days", "previous_delay_flag", "rolling_average_delay",
        "rolling_average_demand", "rolling_average_inventory")


def _body(name: str) -> str:
    return ORACLE[name][len(with_ctes("supply_events")):]


@register("feat_all", with_ctes("supply_events") + f"""
SELECT a.event_id, {', '.join(_ALL)}
FROM ({_body('feat_ratios')}) a JOIN ({_body('feat_costs')}) b USING (event_id)
JOIN ({_body('feat_lead_time_tier')}) c USING (event_id) JOIN ({_body('feat_lag')}) d USING (event_id)
JOIN ({_body('feat_rolling')}) e USING (event_id)
""")
def feat_all(spark, sf_dir):
    """all sixteen features F1-F14 of every event."""
    return features.engineer_all_features(fixtures.supply_events(spark, sf_dir)).select("event_id", *_ALL)
