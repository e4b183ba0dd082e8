"""Data-quality queries (C1-C24) over the fixture event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import quality, relational
from ..sources import fixtures
from ..sources.fixtures_sql import with_ctes
from .registry import register

DIRTY_COLS = ("event_id", "date", "supplier_id", "supplier_name", "supplier_country", "supplier_reliability",
              "product_id", "part_key", "demand_units", "supplier_capacity_units", "planned_lead_time_days",
              "delay_occurred", "delay_days", "unit_cost_usd", "transport_cost_usd", "secondary_supplier_premium_pct",
              "criticality_level", "order_key", "line_number", "actual_lead_time_days", "inventory_demand_ratio",
              "estimated_primary_cost_usd", "estimated_secondary_cost_usd", "air_freight_cost_usd", "service_risk",
              "inventory_units", "category", "copy_no")
PROFILE_COLS = ("demand_units", "inventory_units", "supplier_capacity_units", "planned_lead_time_days",
                "actual_lead_time_days", "delay_days", "unit_cost_usd", "transport_cost_usd", "air_freight_cost_usd",
                "supplier_reliability")


def _q(col, p):
    return f"quantile_cont({col}, {p})"


@register("dq_missing_counts", with_ctes("dirty_events") + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM dirty_events"
    for c in DIRTY_COLS))
def dq_missing_counts(spark, sf_dir):
    """Null count per column of the dirty input."""
    return quality.null_counts(fixtures.dirty_events(spark, sf_dir).select(*DIRTY_COLS))


@register("dq_impute", with_ctes("dirty_events") + """
, med AS (SELECT quantile_cont(inventory_units, 0.5) AS m FROM dirty_events),
mo AS (SELECT category AS c FROM dirty_events WHERE category IS NOT NULL
       GROUP BY category ORDER BY count(*) DESC, category LIMIT 1)
SELECT event_id, copy_no, coalesce(CAST(inventory_units AS DOUBLE), med.m) AS inventory_units,
       coalesce(category, mo.c) AS category
FROM dirty_events, med, mo
""")
def dq_impute(spark, sf_dir):
    """Median imputation of inventory, mode imputation of category."""
    d = fixtures.dirty_events(spark, sf_dir).select("event_id", "copy_no", "inventory_units", "category")
    return quality.impute(d, ["inventory_units"], ["category"])


def _dedup(spark, sf_dir):
    d = fixtures.dirty_events(spark, sf_dir)
    exact = quality.drop_exact_duplicates(d, ["copy_no"], [F.col("copy_no")])
    keyed = quality.dedup_by_key(exact, ["date", "supplier_id", "product_id"], [F.col("event_id"), F.col("copy_no")])
    return d, exact, keyed


_DEDUP_SQL = with_ctes("dirty_events") + """
, ex AS (SELECT * FROM dirty_events WHERE copy_no = 0),
ky AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, supplier_id, product_id
                                                    ORDER BY event_id, copy_no) AS rn FROM ex) t WHERE rn = 1)
"""


@register("dq_dedup_keyed", _DEDUP_SQL + "SELECT event_id, date, supplier_id, product_id FROM ky")
def dq_dedup_keyed(spark, sf_dir):
    """Exact duplicates removed, then first row per (date, supplier, product)."""
    return _dedup(spark, sf_dir)[2].select("event_id", "date", "supplier_id", "product_id")


@register("dq_dedup_counts", _DEDUP_SQL + """
SELECT (SELECT count(*) FROM dirty_events) AS initial_records,
       (SELECT count(*) FROM dirty_events) - (SELECT count(*) FROM ex) AS exact_duplicates,
       (SELECT count(*) FROM ex) - (SELECT count(*) FROM ky) AS key_duplicates,
       (SELECT count(*) FROM dirty_events) - (SELECT count(*) FROM ky) AS records_removed,
       (SELECT count(*) FROM ky) AS final_records
""")
def dq_dedup_counts(spark, sf_dir):
    """C4-C5 counts (C13 run summary fields)."""
    d, exact, keyed = _dedup(spark, sf_dir)
    a = d.agg(F.count(F.lit(1)).alias("n0"))
    b = exact.agg(F.count(F.lit(1)).alias("n1"))
    c = keyed.agg(F.count(F.lit(1)).alias("n2"))
    x = a.crossJoin(b).crossJoin(c)
    return x.select(F.col("n0").alias("initial_records"), (F.col("n0") - F.col("n1")).alias("exact_duplicates"),
                    (F.col("n1") - F.col("n2")).alias("key_duplicates"),
                    (F.col("n0") - F.col("n2")).alias("records_removed"), F.col("n2").alias("final_records"))


@register("dq_rule_counts", with_ctes("supply_events") + """
SELECT count(*) FILTER (WHERE supplier_reliability < 0 OR supplier_reliability > 1) AS invalid_reliability,
       count(*) FILTER (WHERE demand_units <= 0 OR inventory_units < 0 OR supplier_capacity_units <= 0) AS invalid_demand_inv,
       count(*) FILTER (WHERE planned_lead_time_days <= 0 OR actual_lead_time_days < planned_lead_time_days
                          OR actual_lead_time_days <> planned_lead_time_days + delay_days) AS invalid_lead_times,
       count(*) FILTER (WHERE (delay_occurred = 0 AND delay_days <> 0) OR (delay_occurred = 1 AND delay_days <= 0))
         AS invalid_delays,
       count(*) FILTER (WHERE unit_cost_usd <= 0 OR transport_cost_usd <= 0 OR air_freight_cost_usd <= 0
                          OR secondary_supplier_premium_pct < 0.05 OR secondary_supplier_premium_pct > 0.20)
         AS invalid_costs
FROM supply_events
""")
def dq_rule_counts(spark, sf_dir):
    """Domain-rule violation counts."""
    return quality.operational_rule_counts(fixtures.supply_events(spark, sf_dir))


_GATE_NULLS = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in quality.GATE_COLUMNS)


@register("dq_dataset_gate", with_ctes("dirty_events") + f"""
, g AS (SELECT count(*) AS n_rows,
       coalesce(sum({_GATE_NULLS}), 0) AS n_nulls,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_events) d) AS n_repeated_rows,
       count(*) FILTER (WHERE supplier_reliability < 0 OR supplier_reliability > 1) AS bad_reliability,
       count(*) FILTER (WHERE unit_cost_usd <= 0 OR transport_cost_usd <= 0 OR air_freight_cost_usd <= 0
                          OR estimated_primary_cost_usd <= 0 OR estimated_secondary_cost_usd <= 0
                          OR secondary_supplier_premium_pct < 0 OR secondary_supplier_premium_pct > 1) AS bad_costs,
       count(*) FILTER (WHERE planned_lead_time_days <= 0 OR actual_lead_time_days < planned_lead_time_days
                          OR actual_lead_time_days <> planned_lead_time_days + delay_days) AS bad_lead_times,
       count(*) FILTER (WHERE (delay_occurred = 0 AND delay_days <> 0) OR (delay_occurred = 1 AND delay_days <= 0)
                          OR delay_occurred NOT IN (0, 1)) AS bad_delays,
       count(*) FILTER (WHERE demand_units <= 0 OR inventory_units < 0 OR supplier_capacity_units <= 0) AS bad_units,
       count(*) FILTER (WHERE coalesce(category NOT IN {quality.GATE_CATEGORIES}, true)) AS bad_category,
       count(*) FILTER (WHERE coalesce(service_risk NOT IN {quality.GATE_TIERS}, true)) AS bad_tier
  FROM dirty_events)
SELECT * REPLACE (CAST(n_nulls AS BIGINT) AS n_nulls),
       n_nulls + n_repeated_rows + bad_reliability + bad_costs + bad_lead_times + bad_delays + bad_units + bad_category
         + bad_tier = 0 AND n_rows >= 500 AS passed
FROM g
""")
def dq_dataset_gate(spark, sf_dir):
    """The whole validation gate with its pass flag."""
    return quality.dataset_gate(fixtures.dirty_events(spark, sf_dir))


_IQR_SQL = with_ctes("supply_events") + " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, q1, q3, q1 - (q3 - q1) * 1.5 AS lower, q3 + (q3 - q1) * 1.5 AS upper,
       (SELECT count(*) FROM supply_events WHERE {c} < b.q1 - (b.q3 - b.q1) * 1.5 OR {c} > b.q3 + (b.q3 - b.q1) * 1.5)
         AS n_outliers
FROM (SELECT {_q(c, 0.25)} AS q1, {_q(c, 0.75)} AS q3 FROM supply_events) b""" for c in quality.IQR_COLUMNS)


@register("dq_iqr_outliers", "SELECT column_name, " + ", ".join(
    f"(sign({c}) * floor(abs({c}) * 100000000 + 0.5) / 100000000) AS {c}" for c in ("q1", "q3", "lower", "upper"))
    + ", n_outliers FROM (" + _IQR_SQL + ") z")
def dq_iqr_outliers(spark, sf_dir):
    """IQR fences and outlier counts for nine columns."""
    return quality.iqr_outliers(fixtures.supply_events(spark, sf_dir))


@register("dq_percentile_flags", with_ctes("supply_events") + f"""
, b AS (SELECT {_q('demand_units', 0.01)} AS d1, {_q('demand_units', 0.99)} AS d99,
               {_q('inventory_units', 0.01)} AS i1, {_q('inventory_units', 0.99)} AS i99,
               {_q('unit_cost_usd', 0.98)} AS u98, {_q('transport_cost_usd', 0.98)} AS t98,
               {_q('actual_lead_time_days', 0.98)} AS l98 FROM supply_events)
SELECT event_id,
  CAST(demand_units < d1 OR demand_units > d99 AS INTEGER) AS demand_outlier_flag,
  CAST(inventory_units < i1 OR inventory_units > i99 AS INTEGER) AS inventory_outlier_flag,
  CAST(unit_cost_usd > u98 OR transport_cost_usd > t98 AS INTEGER) AS cost_outlier_flag,
  CAST(actual_lead_time_days > l98 AS INTEGER) AS lead_time_outlier_flag
FROM supply_events, b
""")
def dq_percentile_flags(spark, sf_dir):
    """C11: percentile-based outlier flags per event."""
    r = quality.percentile_flags(fixtures.supply_events(spark, sf_dir))
    return r.select("event_id", "demand_outlier_flag", "inventory_outlier_flag", "cost_outlier_flag",
                    "lead_time_outlier_flag")


@register("dq_profile", with_ctes("dirty_events") + " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_missing,
  (floor(count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100 * 10000 + 0.5) / 10000) AS missing_pct,
  count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value,
  (sign(avg(CAST({c} AS DOUBLE))) * floor(abs(avg(CAST({c} AS DOUBLE))) * 1000000 + 0.5) / 1000000) AS mean_value,
  (sign(median(CAST({c} AS DOUBLE))) * floor(abs(median(CAST({c} AS DOUBLE))) * 1000000 + 0.5) / 1000000) AS median_value
FROM dirty_events""" for c in PROFILE_COLS))
def dq_profile(spark, sf_dir):
    """Column profile of the dirty input."""
    return quality.profile(fixtures.dirty_events(spark, sf_dir), list(PROFILE_COLS))


_CHECKS_SQL = [
    ("supply_events", "demand_positive", "demand_units > 0"),
    ("supply_events", "capacity_positive", "supplier_capacity_units > 0"),
    ("supply_events", "reliability_unit_range", "supplier_reliability >= 0 AND supplier_reliability <= 1"),
    ("supply_events", "delay_days_non_negative", "delay_days >= 0"),
    ("supply_events", "premium_unit_range", "secondary_supplier_premium_pct >= 0 AND secondary_supplier_premium_pct <= 1"),
    ("supply_events", "criticality_enum", "criticality_level IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL')"),
    ("supply_events", "inventory_units_non_negative", "inventory_units >= 0"),
    ("supply_events", "planned_lead_positive", "planned_lead_time_days > 0"),
    ("supply_events", "actual_lead_non_negative", "actual_lead_time_days >= 0"),
    ("supply_events", "delay_flag_binary", "delay_occurred IN (0, 1)"),
    ("supply_events", "unit_cost_non_negative", "unit_cost_usd >= 0"),
    ("supply_events", "transport_cost_non_negative", "transport_cost_usd >= 0"),
    ("supply_events", "air_cost_positive", "air_freight_cost_usd > 0"),
    ("supply_events", "primary_cost_non_negative", "estimated_primary_cost_usd >= 0"),
    ("supply_events", "secondary_cost_non_negative", "estimated_secondary_cost_usd >= 0"),
    ("supply_events", "service_tier_enum", "service_risk IN ('Low', 'Medium', 'High')"),
    ("inventory", "inventory_non_negative", "inventory_units >= 0"),
    ("inventory", "reserved_non_negative", "reserved_units >= 0"),
    ("inventory", "available_non_negative", "available_units >= 0"),
    ("inventory", "available_identity", "available_units = inventory_units - reserved_units"),
    ("predictions", "probability_unit_range", "delay_probability >= 0 AND delay_probability <= 1"),
    ("predictions", "predicted_days_non_negative", "predicted_delay_days >= 0"),
    ("outcomes", "actual_cost_non_negative", "actual_cost >= 0"),
    ("predictions", "version_positive", "version >= 1"),
    ("outcomes", "estimated_cost_non_negative", "estimated_cost >= 0"),
    ("outcomes", "estimated_service_unit_range", "estimated_service_level >= 0 AND estimated_service_level <= 1"),
    ("outcomes", "estimated_risk_unit_range", "estimated_risk >= 0 AND estimated_risk <= 1"),
    ("outcomes", "actual_risk_unit_range", "actual_risk >= 0 AND actual_risk <= 1"),
    ("outcomes", "actual_delay_non_negative", "actual_delay_days >= 0"),
    ("outcomes", "estimated_delay_non_negative", "estimated_delay_days >= 0"),
    ("outcomes", "service_unit_range", "actual_service_level >= 0 AND actual_service_level <= 1"),
    ("outcomes", "decision_status_enum",
     "decision_status IN ('PENDING', 'APPROVED', 'REJECTED', 'OVERRIDDEN', 'CANCELLED')"),
    ("outcomes", "execution_status_enum", "execution_status IN ('NOT_STARTED', 'IN_PROGRESS', 'COMPLETED', 'FAILED')"),
]


@register("dq_constraint_violations", with_ctes("supply_events", "predictions", "inventory", "outcomes") + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{r}' AS rule_name, count(*) FILTER (WHERE NOT coalesce({cond}, true)) AS n_violations "
    f"FROM {t}" for t, r, cond in _CHECKS_SQL))
def dq_constraint_violations(spark, sf_dir):
    """Table constraint report (rule table -> violation counts)."""
    ev = fixtures.supply_events(spark, sf_dir)
    tables = {"supply_events": ev, "predictions": fixtures.predictions(spark, sf_dir, ev),
              "inventory": fixtures.inventory(spark, sf_dir), "outcomes": fixtures.outcomes(spark, sf_dir)}
    return quality.constraint_report([(t, r, tables[t], F.expr(cond)) for t, r, cond in _CHECKS_SQL])


@register("dq_unique_violations", with_ctes("supply_events", "predictions", "inventory") + """
SELECT 'inventory' AS table_name, CAST(product_id AS VARCHAR) || '|' || warehouse_code || '|' || CAST(inventory_date AS VARCHAR)
         AS key_value, count(*) AS n_rows
FROM inventory GROUP BY product_id, warehouse_code, inventory_date HAVING count(*) > 1
UNION ALL
SELECT 'supply_events', event_id, count(*) FROM supply_events GROUP BY event_id HAVING count(*) > 1
UNION ALL
SELECT 'predictions', event_id || '|' || CAST(version AS VARCHAR), count(*) FROM predictions
GROUP BY event_id, version HAVING count(*) > 1
""")
def dq_unique_violations(spark, sf_dir):
    """C17: duplicate business keys."""
    ev = fixtures.supply_events(spark, sf_dir)
    inv = fixtures.inventory(spark, sf_dir)
    pr = fixtures.predictions(spark, sf_dir, ev)
    return (relational.unique_violations(inv, ["product_id", "warehouse_code", "inventory_date"], "inventory")
            .unionByName(relational.unique_violations(ev, ["event_id"], "supply_events"))
            .unionByName(relational.unique_violations(pr, ["event_id", "version"], "predictions")))


@register("dq_orphans", with_ctes("outcomes") + """
SELECT 'outcomes' AS table_name, CAST(o.order_key AS VARCHAR) AS key_value
FROM outcomes o WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = o.order_key)
UNION ALL
SELECT 'lineitem_part', CAST(l_partkey AS VARCHAR) FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)
UNION ALL
SELECT 'lineitem_supplier', CAST(l_suppkey AS VARCHAR) FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey)
""")
def dq_orphans(spark, sf_dir):
    """Referential checks as left-anti joins."""
    from ..sources.tables import read_table
    li = read_table(spark, sf_dir, "lineitem", ["l_partkey", "l_suppkey"])
    return (relational.orphans(fixtures.outcomes(spark, sf_dir), read_table(spark, sf_dir, "orders", ["o_orderkey"]),
                               "order_key", "o_orderkey", "outcomes")
            .unionByName(relational.orphans(li, read_table(spark, sf_dir, "part", ["p_partkey"]),
                                            "l_partkey", "p_partkey", "lineitem_part"))
            .unionByName(relational.orphans(li, read_table(spark, sf_dir, "supplier", ["s_suppkey"]),
                                            "l_suppkey", "s_suppkey", "lineitem_supplier")))


@register("dq_probability_guard", with_ctes("supply_events", "predictions") + """
SELECT count(*) FILTER (WHERE delay_probability IS NOT NULL AND NOT isnan(delay_probability)
                          AND delay_probability >= 0 AND delay_probability <= 1) AS n_valid,
       count(*) FILTER (WHERE NOT (delay_probability IS NOT NULL AND NOT isnan(delay_probability)
                          AND delay_probability >= 0 AND delay_probability <= 1)) AS n_invalid
FROM predictions
""")
def dq_probability_guard(spark, sf_dir):
    """Valid vs rejected probabilities."""
    from ..operators.risk import probability_valid
    p = fixtures.predictions(spark, sf_dir)
    ok = probability_valid("delay_probability")
    return p.agg(F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_invalid"))


@register("dq_search", with_ctes("supply_events") + """
SELECT event_id, product_id, supplier_name FROM supply_events
WHERE product_id ILIKE '%brand#1%' OR event_id ILIKE '%brand#1%'
""")
def dq_search(spark, sf_dir):
    """Case-insensitive substring search on event or product."""
    ev = fixtures.supply_events(spark, sf_dir)
    return quality.search(ev, "brand#1", ["product_id", "event_id"]).select("event_id", "product_id", "supplier_name")


@register("dq_standardized_types", with_ctes("dirty_events") + """
SELECT event_id, copy_no, CAST(round_even(CAST(demand_units AS DOUBLE) / 3, 0) AS BIGINT) AS demand_thirds,
       CAST(date AS DATE) AS date
FROM dirty_events
""")
def dq_standardized_types(spark, sf_dir):
    """Integers by round-half-even then cast (demand in thirds exercises the tie rule)."""
    d = fixtures.dirty_events(spark, sf_dir).select(
        "event_id", "copy_no", (F.col("demand_units").cast("double") / 3).alias("demand_thirds"), "date")
    return quality.standardize_types(d, ["demand_thirds"], [], [])
