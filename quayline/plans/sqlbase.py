"""SQL text shared by the oracle queries (DuckDB dialect)."""

from __future__ import annotations

from ..functions.numeric import sql_rnd, sql_rnd_signed
from ..params import DEFAULT_RISK as RP
from ..sources.fixtures_sql import with_ctes

R = sql_rnd
RS = sql_rnd_signed


def clip(x: str) -> str:
    return f"least(greatest({x}, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))"


LATEST_PRED = """
SELECT event_id, delay_probability, predicted_delay_days FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY created_on DESC, prediction_id DESC) AS rn
  FROM predictions) t WHERE rn = 1
"""

FEAT = f"""
SELECT e.*,
  CASE WHEN demand_units = 0 THEN NULL ELSE {R('inventory_units / demand_units', 4)} END AS inventory_coverage_ratio,
  demand_units - inventory_units AS inventory_gap_units,
  CAST(inventory_units < demand_units AS INTEGER) AS shortage_flag,
  CASE WHEN supplier_capacity_units = 0 THEN NULL ELSE {R('demand_units / supplier_capacity_units', 4)} END AS capacity_utilization,
  {R('1.0 - supplier_reliability', 4)} AS supplier_risk_score,
  {R('''CASE WHEN count(*) OVER (PARTITION BY supplier_id ORDER BY date, event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0
        THEN sum(CAST(delay_occurred AS BIGINT)) OVER (PARTITION BY supplier_id ORDER BY date, event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
             / count(*) OVER (PARTITION BY supplier_id ORDER BY date, event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ELSE CAST(0 AS DOUBLE) END''', 4)} AS historical_delay_rate
FROM supply_events e
"""
# note: 1.0 above is a DECIMAL literal; subtracting a DOUBLE promotes to DOUBLE in DuckDB.


def inventory_risk(c: str) -> str:
    crit, low = RP.critical_coverage, RP.low_coverage
    return R(clip(f"""CASE WHEN {c} <= 0 THEN CAST(1 AS DOUBLE)
        WHEN {c} < {crit} THEN CAST(80 AS DOUBLE)/100 + CAST(20 AS DOUBLE)/100 * (1 - {c} / {crit})
        WHEN {c} < {low} THEN CAST(40 AS DOUBLE)/100 + CAST(40 AS DOUBLE)/100 * (1 - ({c} - {crit}) / ({low} - {crit}))
        ELSE CAST(40 AS DOUBLE)/100 * (1 - least(CAST(1 AS DOUBLE), ({c} - {low}) / 1.0)) END"""), 4)


def capacity_risk(d: str, cap: str) -> str:
    u = f"(CAST({d} AS DOUBLE) / CAST({cap} AS DOUBLE))"
    m, h, c = RP.moderate_utilization, RP.high_utilization, RP.critical_utilization
    banded = f"""CASE WHEN {u} >= {c} THEN CAST(85 AS DOUBLE)/100 + CAST(15 AS DOUBLE)/100 * least(CAST(1 AS DOUBLE), ({u} - {c}) / 0.5)
        WHEN {u} >= {h} THEN CAST(60 AS DOUBLE)/100 + CAST(25 AS DOUBLE)/100 * (({u} - {h}) / ({c} - {h}))
        WHEN {u} >= {m} THEN CAST(30 AS DOUBLE)/100 + CAST(30 AS DOUBLE)/100 * (({u} - {m}) / ({h} - {m}))
        ELSE CAST(30 AS DOUBLE)/100 * ({u} / {m}) END"""
    return (f"CASE WHEN {cap} = 0 THEN (CASE WHEN {d} > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) "
            f"ELSE {R(clip(banded), 4)} END")


def service_risk(tier: str, c: str, s: str) -> str:
    t = f"upper(trim({tier}))"
    w = ("CASE " + " ".join(f"WHEN {t} = '{n}' THEN CAST({int(round(v * 100))} AS DOUBLE)/100"
                             for n, v in RP.criticality_weights) + " END")
    exp = f"""CASE WHEN {c} IS NOT NULL THEN
                (CASE WHEN {c} < 0.5 OR ({s} = 1 AND {c} < 1.0) THEN CAST(1 AS DOUBLE)
                      WHEN {c} < 1.0 THEN CAST(80 AS DOUBLE)/100 ELSE CAST(40 AS DOUBLE)/100 END)
              WHEN {s} IS NOT NULL THEN (CASE WHEN {s} = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(40 AS DOUBLE)/100 END)
              ELSE CAST(70 AS DOUBLE)/100 END"""
    return f"CASE WHEN ({w}) IS NOT NULL THEN {R(clip(f'({w}) * ({exp})'), 4)} END"


def supplier_risk(rel: str, rate: str) -> str:
    return R(clip(f"CASE WHEN {rate} IS NULL THEN 1 - {rel} ELSE (1 - {rel}) * 0.7 + {rate} * 0.3 END"), 4)


def composite(d, s, i, c, v) -> str:
    ws = [RP.delay_weight, RP.supplier_weight, RP.inventory_weight, RP.capacity_weight, RP.service_weight]
    num = " + ".join(f"(CASE WHEN {x} IS NOT NULL THEN {x} * {w!r} ELSE CAST(0 AS DOUBLE) END)"
                     for x, w in zip((d, s, i, c, v), ws))
    den = " + ".join(f"(CASE WHEN {x} IS NOT NULL THEN CAST({w!r} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
                     for x, w in zip((d, s, i, c, v), ws))
    return R(clip(f"({num}) / ({den})"), 4)


def level(s: str) -> str:
    return (f"CASE WHEN {s} >= {RP.level_critical} THEN 'CRITICAL' WHEN {s} >= {RP.level_high} THEN 'HIGH' "
            f"WHEN {s} >= {RP.level_medium} THEN 'MEDIUM' ELSE 'LOW' END")


SCORES = f"""
SELECT f.* EXCLUDE (supplier_risk_score), p.delay_probability, p.predicted_delay_days,
  {R(clip('p.delay_probability'), 4)} AS delay_risk_score,
  p.delay_probability >= {RP.classification_threshold} AS predicted_delay,
  {supplier_risk('f.supplier_reliability', 'f.historical_delay_rate')} AS supplier_risk_score,
  {inventory_risk('f.inventory_coverage_ratio')} AS inventory_risk_score,
  {capacity_risk('f.demand_units', 'f.supplier_capacity_units')} AS capacity_risk_score,
  {service_risk('f.criticality_level', 'f.inventory_coverage_ratio', 'f.shortage_flag')} AS service_risk_score
FROM feat f JOIN latest_pred p USING (event_id)
"""


def reason_codes_sql() -> str:
    c = "inventory_coverage_ratio"
    u = "capacity_utilization"
    p = "delay_probability"
    rel = "supplier_reliability"
    items = [
        (f"{p} >= {RP.prob_critical}", "CRITICAL_DELAY_PROBABILITY"),
        (f"{p} < {RP.prob_critical} AND {p} >= {RP.prob_high}", "HIGH_DELAY_PROBABILITY"),
        (f"{rel} < {RP.critical_reliability}", "CRITICAL_SUPPLIER_RELIABILITY"),
        (f"{rel} >= {RP.critical_reliability} AND {rel} < {RP.low_reliability}", "LOW_SUPPLIER_RELIABILITY"),
        (f"historical_delay_rate IS NOT NULL AND historical_delay_rate >= {RP.high_past_delay_rate}",
         "HIGH_HISTORICAL_SUPPLIER_DELAYS"),
        (f"{c} IS NOT NULL AND {c} < {RP.critical_coverage}", "CRITICAL_INVENTORY_SHORTAGE"),
        (f"{c} IS NOT NULL AND {c} >= {RP.critical_coverage} AND {c} < {RP.low_coverage}", "LOW_INVENTORY_COVERAGE"),
        (f"shortage_flag = 1 AND NOT coalesce({c} IS NOT NULL AND {c} < {RP.critical_coverage}, false)",
         "INVENTORY_SHORTAGE"),
        (f"{u} IS NOT NULL AND {u} >= {RP.critical_utilization}", "CRITICAL_CAPACITY_UTILIZATION"),
        (f"{u} IS NOT NULL AND {u} < {RP.critical_utilization} AND {u} >= {RP.high_utilization}",
         "HIGH_CAPACITY_UTILIZATION"),
        (f"upper(criticality_level) IN ('CRITICAL', 'HIGH') AND (({c} IS NOT NULL AND {c} < {RP.low_coverage}) "
         f"OR coalesce(shortage_flag, 0) = 1)", "CRITICAL_PRODUCT_EXPOSURE"),
    ]
    parts = ", ".join(f"CASE WHEN {cond} THEN '{code}' END" for cond, code in items)
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


ASSESSED = f"""
SELECT s.*,
  {composite('delay_risk_score', 'supplier_risk_score', 'inventory_risk_score', 'capacity_risk_score', 'service_risk_score')}
    AS composite_risk_score,
  {reason_codes_sql()} AS risk_reasons
FROM scores s
"""

LEVELED = f"SELECT a.*, {level('composite_risk_score')} AS risk_level FROM assessed a"


def risk_with(extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause up to ``leveled`` (the full assessment), then ``extra``."""
    return with_ctes("supply_events", "predictions", extra=[
        ("latest_pred", LATEST_PRED), ("feat", FEAT), ("scores", SCORES), ("assessed", ASSESSED),
        ("leveled", LEVELED)] + (extra or []))
