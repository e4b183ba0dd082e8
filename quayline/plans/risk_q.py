"""Risk scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import risk
from ..session import materialize
from . import sqlbase as S
from .common import assessed
from .registry import register


@register("risk_scores", S.risk_with() + """
SELECT event_id, delay_risk_score, predicted_delay, supplier_risk_score, inventory_risk_score,
       capacity_risk_score, service_risk_score, composite_risk_score, risk_level
FROM leveled
""")
def risk_scores(spark, sf_dir):
    """R1-R8 and R11 for every event."""
    return assessed(spark, sf_dir).select(
        "event_id", "delay_risk_score", "predicted_delay", "supplier_risk_score", "inventory_risk_score",
        "capacity_risk_score", "service_risk_score", "composite_risk_score", "risk_level")


@register("risk_reasons", S.risk_with() + """
SELECT event_id, array_to_string(risk_reasons, ',') AS reason_codes,
       CAST(len(risk_reasons) AS INTEGER) AS n_reasons
FROM leveled
""")
def risk_reasons(spark, sf_dir):
    """Reason codes in rule order, joined as text."""
    a = assessed(spark, sf_dir)
    return a.select("event_id", F.array_join("risk_reasons", ",").alias("reason_codes"),
                    F.size("risk_reasons").alias("n_reasons"))


@register("risk_level_dist", S.risk_with() + """
SELECT supplier_id, risk_level, count(*) AS n_events,
       (floor(avg(composite_risk_score) * 10000 + 0.5) / 10000) AS mean_composite
FROM leveled GROUP BY supplier_id, risk_level
""")
def risk_level_dist(spark, sf_dir):
    """Minimum slice: risk-level distribution by supplier."""
    from ..functions.numeric import rnd
    return (assessed(spark, sf_dir).groupBy("supplier_id", "risk_level")
            .agg(F.count(F.lit(1)).alias("n_events"), rnd(F.avg("composite_risk_score"), 4).alias("mean_composite")))


from ..functions.numeric import rnd  # noqa: E402
from ..operators import relational  # noqa: E402
from ..sources import fixtures  # noqa: E402
from .common import SCORED, in_steps, kept_events, risk_inputs  # noqa: E402
from ..sources.fixtures_sql import CTES  # noqa: E402

_ALERT_SQL = """
alerts AS (
  SELECT event_id, composite_risk_score,
         CASE WHEN risk_level = 'CRITICAL' OR composite_risk_score >= 0.8 THEN 'CRITICAL'
              WHEN risk_level = 'HIGH' OR composite_risk_score >= 0.6 THEN 'HIGH' END AS severity,
         CASE WHEN risk_level = 'CRITICAL' OR composite_risk_score >= 0.8 THEN 'PRIORITY_DISRUPTION_ALERT'
              WHEN risk_level = 'HIGH' OR composite_risk_score >= 0.6 THEN 'WARNING_DISRUPTION_ALERT' END AS alert_type,
         date
  FROM leveled)
"""


def _alerts(spark, sf_dir):
    return risk.alerts(assessed(spark, sf_dir), keep=("date",))


@register("risk_alerts", S.risk_with() + ", " + _ALERT_SQL.strip() + """
SELECT event_id, alert_type, severity, composite_risk_score FROM alerts WHERE severity IS NOT NULL
""")
def risk_alerts(spark, sf_dir):
    """HIGH and CRITICAL alerts (monitoring notices off by default)."""
    return risk.alerts(assessed(spark, sf_dir)).select("event_id", "alert_type", "severity", "composite_risk_score")


@register("risk_alerts_incremental", S.risk_with() + ", " + _ALERT_SQL.strip() + """
, hist AS (SELECT event_id, alert_type FROM alerts WHERE severity IS NOT NULL AND date < DATE '1998-01-01')
SELECT a.event_id, a.alert_type, a.severity FROM alerts a
WHERE a.severity IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.event_id = a.event_id AND h.alert_type = a.alert_type)
""")
def risk_alerts_incremental(spark, sf_dir):
    """Second run over all events emits only alerts whose key was not raised by the
    first run (events shipped before 1998)."""
    # read twice, scored once
    al = materialize(_alerts(spark, sf_dir).select("event_id", "alert_type", "severity", "alert_message", "date"))
    history = al.filter(F.col("date") < F.lit("1998-01-01").cast("date"))
    return risk.dedup_alerts(al, history).select("event_id", "alert_type", "severity")


@register("risk_alert_counts", S.risk_with() + ", " + _ALERT_SQL.strip() + """
, lv AS (SELECT * FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) t(severity))
SELECT lv.severity, CAST(count(a.event_id) AS BIGINT) AS n_alerts
FROM lv LEFT JOIN alerts a ON a.severity = lv.severity GROUP BY lv.severity
""")
def risk_alert_counts(spark, sf_dir):
    """Alert counts by severity, zero-filled."""
    return risk.alert_counts(risk.alerts(assessed(spark, sf_dir)))


@register("risk_run_summary", S.risk_with() + """
SELECT count(*) AS total_events,
       CAST(0 AS BIGINT) AS failed_events,
       count(*) FILTER (WHERE risk_level = 'CRITICAL') AS n_critical,
       count(*) FILTER (WHERE risk_level = 'HIGH') AS n_high,
       count(*) FILTER (WHERE risk_level = 'MEDIUM') AS n_medium,
       count(*) FILTER (WHERE risk_level = 'LOW') AS n_low,
       (floor(avg(composite_risk_score) * 10000 + 0.5) / 10000) AS mean_composite
FROM leveled
""")
def risk_run_summary(spark, sf_dir):
    """R15 with C24: totals, rejected rows, level counts, mean composite."""
    a = assessed(spark, sf_dir)
    ok = F.col("is_valid")
    return a.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(~ok).alias("failed_events"),
        *[F.count_if(ok & (F.col("risk_level") == lv)).alias(f"n_{lv.lower()}") for lv in risk.LEVELS],
        rnd(F.avg(F.when(ok, F.col("composite_risk_score"))), 4).alias("mean_composite"))


@register("risk_reason_freq", S.risk_with() + """
SELECT reason, count(*) AS n_events FROM (SELECT unnest(risk_reasons) AS reason FROM leveled) t
GROUP BY reason ORDER BY n_events DESC, reason LIMIT 6
""")
def risk_reason_freq(spark, sf_dir):
    """The six most frequent reason codes (a top-k report)."""
    a = assessed(spark, sf_dir)
    return (a.select(F.explode("risk_reasons").alias("reason")).groupBy("reason")
            .agg(F.count(F.lit(1)).alias("n_events"))
            .orderBy(F.col("n_events").desc(), "reason").limit(6))


@register("risk_top_suppliers", S.risk_with() + """
SELECT supplier_id, supplier_name, count(*) AS n_high_risk FROM leveled
WHERE risk_level IN ('HIGH', 'CRITICAL') GROUP BY supplier_id, supplier_name
ORDER BY n_high_risk DESC, supplier_id LIMIT 5
""")
def risk_top_suppliers(spark, sf_dir):
    """Suppliers with most HIGH/CRITICAL events (top 5)."""
    a = assessed(spark, sf_dir).filter(F.col("risk_level").isin("HIGH", "CRITICAL"))
    return (a.groupBy("supplier_id", "supplier_name").agg(F.count(F.lit(1)).alias("n_high_risk"))
            .orderBy(F.col("n_high_risk").desc(), "supplier_id").limit(5))


@register("risk_by_supplier", S.risk_with() + """
SELECT supplier_id,
       (floor(avg(composite_risk_score) * 10000 + 0.5) / 10000) AS mean_composite,
       (floor(avg(supplier_risk_score) * 10000 + 0.5) / 10000) AS mean_supplier_score,
       (floor(avg(delay_risk_score) * 10000 + 0.5) / 10000) AS mean_delay_score,
       count(*) FILTER (WHERE risk_level IN ('HIGH', 'CRITICAL')) AS n_high_risk,
       count(*) AS n_events
FROM leveled GROUP BY supplier_id
""")
def risk_by_supplier(spark, sf_dir):
    """Supplier summary."""
    a = assessed(spark, sf_dir)
    return a.groupBy("supplier_id").agg(
        rnd(F.avg("composite_risk_score"), 4).alias("mean_composite"),
        rnd(F.avg("supplier_risk_score"), 4).alias("mean_supplier_score"),
        rnd(F.avg("delay_risk_score"), 4).alias("mean_delay_score"),
        F.count_if(F.col("risk_level").isin("HIGH", "CRITICAL")).alias("n_high_risk"),
        F.count(F.lit(1)).alias("n_events"))


@register("risk_by_category", S.risk_with() + """
SELECT category, count(*) AS n_events,
       count(*) FILTER (WHERE risk_level IN ('HIGH', 'CRITICAL')) AS n_high_risk,
       (floor(count(*) FILTER (WHERE risk_level IN ('HIGH', 'CRITICAL')) / count(*) * 10000 + 0.5) / 10000)
         AS high_risk_share
FROM leveled GROUP BY category
""")
def risk_by_category(spark, sf_dir):
    """Totals vs HIGH/CRITICAL by category."""
    a = assessed(spark, sf_dir)
    hi = F.count_if(F.col("risk_level").isin("HIGH", "CRITICAL"))
    return a.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_events"), hi.alias("n_high_risk"),
        rnd(hi / F.count(F.lit(1)), 4).alias("high_risk_share"))


@register("risk_level_shares", S.risk_with() + """
SELECT risk_level, count(*) AS n_events,
       (floor(count(*) / (SELECT count(*) FROM leveled) * 10000 + 0.5) / 10000) AS share
FROM leveled GROUP BY risk_level
""")
def risk_level_shares(spark, sf_dir):
    """Level shares (total comes from a one-row aggregate)."""
    a = assessed(spark, sf_dir)
    counts = a.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n_events"))
    total = a.agg(F.count(F.lit(1)).alias("_total"))
    return (counts.crossJoin(F.broadcast(total))
            .select("risk_level", "n_events", rnd(F.col("n_events") / F.col("_total"), 4).alias("share")))


@register("risk_composite_hist", S.risk_with() + """
, b AS (SELECT min(composite_risk_score) AS lo, max(composite_risk_score) AS hi FROM leveled)
SELECT CAST(CASE WHEN b.hi = b.lo THEN 0
                 ELSE least(floor((composite_risk_score - b.lo) / (b.hi - b.lo) * 20), 19) END AS BIGINT) AS bin,
       count(*) AS n_events
FROM leveled, b GROUP BY 1
""")
def risk_composite_hist(spark, sf_dir):
    """20 equal-width bins of the composite over its min-max (bounds are a 1-row broadcast)."""
    a = assessed(spark, sf_dir)
    b = a.agg(F.min("composite_risk_score").alias("lo"), F.max("composite_risk_score").alias("hi"))
    x = a.select("composite_risk_score").crossJoin(F.broadcast(b))
    binc = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("composite_risk_score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 20), F.lit(19)))
    return x.groupBy(binc.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n_events"))


@register("risk_exposure", S.risk_with() + """
SELECT count(*) FILTER (WHERE inventory_risk_score > 0.4) AS inventory_elevated,
       count(*) FILTER (WHERE inventory_risk_score >= 0.8) AS inventory_critical,
       count(*) FILTER (WHERE capacity_risk_score >= 0.6) AS capacity_high,
       count(*) FILTER (WHERE capacity_risk_score >= 0.85) AS capacity_critical
FROM leveled
""")
def risk_exposure(spark, sf_dir):
    """Exposure counts."""
    a = assessed(spark, sf_dir)
    return a.agg(F.count_if(F.col("inventory_risk_score") > 0.4).alias("inventory_elevated"),
                 F.count_if(F.col("inventory_risk_score") >= 0.8).alias("inventory_critical"),
                 F.count_if(F.col("capacity_risk_score") >= 0.6).alias("capacity_high"),
                 F.count_if(F.col("capacity_risk_score") >= 0.85).alias("capacity_critical"))


@register("risk_export_high", S.risk_with() + """
SELECT event_id, date, supplier_id, supplier_name, product_id, category, demand_units, inventory_units,
       supplier_capacity_units, delay_probability, composite_risk_score, risk_level,
       array_to_string(risk_reasons, ',') AS reason_codes
FROM leveled WHERE risk_level IN ('HIGH', 'CRITICAL')
""")
def risk_export_high(spark, sf_dir):
    """HIGH/CRITICAL rows with their context columns (aligned by key, not position)."""
    a = assessed(spark, sf_dir).filter(F.col("risk_level").isin("HIGH", "CRITICAL"))
    return a.select("event_id", "date", "supplier_id", "supplier_name", "product_id", "category", "demand_units",
                    "inventory_units", "supplier_capacity_units", "delay_probability", "composite_risk_score",
                    "risk_level", F.array_join("risk_reasons", ",").alias("reason_codes"))


@register("risk_optimizer_contract", S.risk_with() + """
SELECT event_id, delay_probability, predicted_delay, delay_risk_score, supplier_risk_score, inventory_risk_score,
       capacity_risk_score, service_risk_score, composite_risk_score AS risk_score, risk_level,
       array_to_string(risk_reasons, ',') AS reason_codes
FROM leveled
""")
def risk_optimizer_contract(spark, sf_dir):
    """The 11-field contract handed to allocation (composite renamed risk_score)."""
    a = assessed(spark, sf_dir)
    return a.select("event_id", "delay_probability", "predicted_delay", "delay_risk_score", "supplier_risk_score",
                    "inventory_risk_score", "capacity_risk_score", "service_risk_score",
                    F.col("composite_risk_score").alias("risk_score"), "risk_level",
                    F.array_join("risk_reasons", ",").alias("reason_codes"))


def kept_stock(spark, sf_dir, ev):
    """``asof_inventory`` as a step of its own."""
    kept = materialize(asof_inventory(spark, sf_dir, ev).select("event_id", "latest_available_units"))
    out = relational.with_id_hash(kept)
    out._kept_at = kept._kept_at
    return out


def asof_inventory(spark, sf_dir, ev):
    """Newest stock snapshot of the event's part dated on or before the event."""
    snap = relational.asof_last(ev, fixtures.inventory(spark, sf_dir), "part_key", "product_id", "date", "inventory_date",
                                "inventory_id", "available_units", "event_id", "latest_available_units",
                                like=lambda n: fixtures.part_date_sample(spark, sf_dir, n))
    return relational.with_id_hash(snap)


@register("risk_service_path", S.risk_with() + f"""
, inv AS ({CTES["inventory"][1]}),
snap AS (
  SELECT e.event_id, i.available_units,
         row_number() OVER (PARTITION BY e.event_id ORDER BY i.inventory_date DESC, i.inventory_id ASC) AS rn
  FROM supply_events e JOIN inv i ON i.product_id = e.part_key AND i.inventory_date <= e.date),
sp AS (
  SELECT e.event_id, e.demand_units, greatest(coalesce(s.available_units, 0), 0) AS stock,
         e.supplier_reliability, e.historical_delay_rate, e.criticality_level, e.supplier_capacity_units,
         p.delay_probability
  FROM feat e JOIN latest_pred p USING (event_id) LEFT JOIN (SELECT * FROM snap WHERE rn = 1) s USING (event_id)),
sp2 AS (
  SELECT *, CASE WHEN demand_units = 0 THEN 999.0 ELSE stock / demand_units END AS cov,
         CAST(NULL AS INTEGER) AS short FROM sp),
sp3 AS (
  SELECT event_id,
    {S.R(S.clip('delay_probability'), 4)} AS d,
    {S.supplier_risk('supplier_reliability', 'historical_delay_rate')} AS s,
    {S.inventory_risk('cov')} AS i,
    {S.capacity_risk('demand_units', 'supplier_capacity_units')} AS c,
    {S.service_risk('criticality_level', 'cov', 'short')} AS v
  FROM sp2)
SELECT event_id, i AS inventory_risk_score, v AS service_risk_score,
       {S.composite('d', 's', 'i', 'c', 'v')} AS composite_risk_score
FROM sp3
""")
def risk_service_path(spark, sf_dir):
    """Service-path assessment using the as-of latest stock snapshot of the part
    instead of the event's own inventory figure."""
    if in_steps(spark, sf_dir):
        ev = kept_events(spark, sf_dir, SCORED)
        snap, x = kept_stock(spark, sf_dir, ev), risk_inputs(spark, sf_dir, ev)
    else:
        x = risk_inputs(spark, sf_dir)
        snap = asof_inventory(spark, sf_dir, x)
    return risk.service_path(x, snap).select("event_id", "inventory_risk_score", "service_risk_score",
                                             "composite_risk_score")
