"""The fixture adapter as ANSI SQL CTEs (DuckDB dialect) for the oracle queries.

Each CTE computes the same values as :mod:`quayline.sources.fixtures` with the
same operation order, so doubles agree bit for bit.
"""

from __future__ import annotations

_EVENT_ID = ("'EVT_' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) || '_' || "
             "CAST(l_partkey AS VARCHAR) || '_' || CAST(l_suppkey AS VARCHAR) || '_' || "
             "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)")

CTES: dict[str, tuple[tuple[str, ...], str]] = {}

CTES["se_base"] = ((), f"""
SELECT {_EVENT_ID} AS event_id,
       CAST(l_shipdate AS DATE) AS date,
       l_suppkey AS supplier_id, s_name AS supplier_name, n_name AS supplier_country,
       (60 + (l_suppkey * 37) % 40) / 100 AS supplier_reliability,
       p_brand AS product_id, p_type AS category, l_partkey AS part_key,
       CAST(l_quantity AS BIGINT) * 20 AS demand_units,
       (l_partkey * 131 + l_orderkey * 17) % 2001 AS inventory_units,
       300 + (l_suppkey * 97 + l_partkey * 31) % 1201 AS supplier_capacity_units,
       2 + l_suppkey % 15 AS planned_lead_time_days,
       CASE WHEN (l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31) % 100
                 < 2 + (100 - (60 + (l_suppkey * 37) % 40)) / 2
                   + CAST(l_quantity AS BIGINT) * 20 * 10 / (300 + (l_suppkey * 97 + l_partkey * 31) % 1201)
            THEN 1 ELSE 0 END AS delay_occurred,
       p_retailprice / 10 AS unit_cost_usd,
       500 + l_extendedprice / 20 AS transport_cost_usd,
       CAST(5 AS DOUBLE) / 100 + l_discount AS secondary_supplier_premium_pct,
       CASE p_size % 5 WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' WHEN 4 THEN 'CRITICAL' END
           AS criticality_level,
       l_orderkey AS order_key, l_linenumber AS line_number
FROM lineitem
JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey
""")

CTES["se_mid"] = (("se_base",), """
SELECT *, delay_occurred * (1 + order_key % 15) AS delay_days
FROM se_base
""")

CTES["supply_events"] = (("se_mid",), """
SELECT event_id, date, supplier_id, supplier_name, supplier_country, supplier_reliability,
       product_id, category, part_key, demand_units, inventory_units, supplier_capacity_units,
       planned_lead_time_days, delay_occurred, delay_days, unit_cost_usd, transport_cost_usd,
       secondary_supplier_premium_pct, criticality_level, order_key, line_number,
       planned_lead_time_days + delay_days AS actual_lead_time_days,
       inventory_units / demand_units AS inventory_demand_ratio,
       demand_units * unit_cost_usd + transport_cost_usd AS estimated_primary_cost_usd,
       demand_units * unit_cost_usd * (1 + secondary_supplier_premium_pct)
         + transport_cost_usd * (1 + secondary_supplier_premium_pct / 2) AS estimated_secondary_cost_usd,
       CASE WHEN order_key % 4 = 0 THEN CAST(0 AS DOUBLE)
            ELSE transport_cost_usd * 3 + demand_units * 3 / 2 END AS air_freight_cost_usd,
       CASE WHEN delay_occurred = 1 OR inventory_units / demand_units < CAST(70 AS DOUBLE) / 100 THEN 'High'
            WHEN inventory_units / demand_units < CAST(1 AS DOUBLE)
                 OR supplier_reliability < CAST(93 AS DOUBLE) / 100 THEN 'Medium'
            ELSE 'Low' END AS service_risk
FROM se_mid
""")

CTES["pred_cur"] = (("supply_events",), """
SELECT event_id, order_key, planned_lead_time_days, 2 AS version, date AS created_on,
       least(CAST(99 AS DOUBLE) / 100,
             CAST(2 AS DOUBLE) / 100 + (1 - supplier_reliability) * 5 / 4
             + least(demand_units / supplier_capacity_units, CAST(2 AS DOUBLE)) / 5) AS delay_probability
FROM supply_events
""")

CTES["predictions"] = (("pred_cur",), """
SELECT 'PRD_' || event_id || '_' || CAST(version AS VARCHAR) AS prediction_id,
       event_id, version, created_on, delay_probability,
       CASE WHEN delay_probability >= CAST(65 AS DOUBLE) / 100 THEN planned_lead_time_days
            ELSE CAST(0 AS BIGINT) END AS predicted_delay_days
FROM (SELECT * FROM pred_cur
      UNION ALL
      SELECT event_id, order_key, planned_lead_time_days, 1 AS version,
             CAST(created_on - INTERVAL 7 DAY AS DATE) AS created_on, delay_probability / 2
      FROM pred_cur WHERE order_key % 3 = 0) u
""")

CTES["inventory"] = ((), f"""
SELECT {_EVENT_ID} AS inventory_id, l_partkey AS product_id,
       'WH-' || CAST(l_linenumber AS VARCHAR) AS warehouse_code,
       CAST(l_shipdate AS DATE) AS inventory_date,
       (l_partkey * 131 + l_orderkey * 17) % 2001 AS inventory_units,
       CAST(l_quantity AS BIGINT) * 10 AS reserved_units,
       (l_partkey * 131 + l_orderkey * 17) % 2001 - CAST(l_quantity AS BIGINT) * 10 AS available_units
FROM lineitem
""")

CTES["outcomes"] = ((), f"""
SELECT {_EVENT_ID} AS outcome_id,
       CASE l_linenumber % 4 WHEN 0 THEN 'AIR_FREIGHT' WHEN 1 THEN 'SECONDARY_SUPPLIER'
            WHEN 2 THEN 'DELAY_LAUNCH' ELSE 'PRIMARY_SUPPLIER' END AS strategy_type,
       l_extendedprice AS estimated_cost,
       l_extendedprice * (1 - l_discount) * (1 + l_tax) * (CASE WHEN l_orderkey % 50 = 0 THEN 4 ELSE 1 END)
         * (9 + l_partkey % 5) / 10 AS actual_cost,
       CASE l_linenumber % 4 WHEN 0 THEN CAST(2 AS BIGINT) WHEN 1 THEN CAST(7 AS BIGINT)
            ELSE 2 + l_suppkey % 15 END AS estimated_delay_days,
       greatest(CAST(0 AS BIGINT), CASE l_linenumber % 4 WHEN 0 THEN CAST(2 AS BIGINT) WHEN 1 THEN CAST(7 AS BIGINT)
            ELSE 2 + l_suppkey % 15 END + l_orderkey % 9 - 2) AS actual_delay_days,
       CAST(95 AS DOUBLE) / 100 AS estimated_service_level,
       (75 + l_partkey % 26) / 100 AS actual_service_level,
       CASE l_linenumber % 4 WHEN 0 THEN CAST(8 AS DOUBLE) / 100 WHEN 1 THEN CAST(15 AS DOUBLE) / 100
            WHEN 2 THEN CAST(35 AS DOUBLE) / 100 ELSE CAST(25 AS DOUBLE) / 100 END AS estimated_risk,
       CASE l_linenumber % 4 WHEN 0 THEN CAST(8 AS DOUBLE) / 100 WHEN 1 THEN CAST(15 AS DOUBLE) / 100
            WHEN 2 THEN CAST(35 AS DOUBLE) / 100 ELSE CAST(25 AS DOUBLE) / 100 END
         + (l_orderkey % 7 - 3) / 100 AS actual_risk,
       CASE WHEN l_returnflag = 'R' THEN 'OVERRIDDEN'
            WHEN l_returnflag = 'N' AND l_orderkey % 10 = 0 THEN 'CANCELLED'
            ELSE 'APPROVED' END AS decision_status,
       CASE WHEN l_linestatus = 'F' THEN 'COMPLETED' ELSE 'IN_PROGRESS' END AS execution_status,
       CAST(l_shipdate AS DATE) AS evaluation_date,
       l_orderkey AS order_key
FROM lineitem
""")

CTES["dirty_events"] = (("supply_events",), """
SELECT * EXCLUDE (inventory_units, category),
       CASE WHEN order_key % 97 = 0 THEN CAST(NULL AS BIGINT) ELSE inventory_units END AS inventory_units,
       CASE WHEN part_key % 89 = 0 THEN CAST(NULL AS VARCHAR) ELSE category END AS category,
       0 AS copy_no
FROM supply_events
UNION ALL
SELECT * EXCLUDE (inventory_units, category),
       CASE WHEN order_key % 97 = 0 THEN CAST(NULL AS BIGINT) ELSE inventory_units END AS inventory_units,
       CASE WHEN part_key % 89 = 0 THEN CAST(NULL AS VARCHAR) ELSE category END AS category,
       1 AS copy_no
FROM supply_events WHERE order_key % 101 = 0
""")

CTES["lifecycle_log"] = ((), """
SELECT user_id AS decision_id, CAST(ts AS TIMESTAMP) AS ts, event_id AS request_id,
       CASE WHEN event_type IN ('click', 'signup') THEN 'decision'
            WHEN event_type IN ('view', 'purchase', 'error') THEN 'execution' END AS kind,
       CASE event_type WHEN 'click' THEN 'APPROVED' WHEN 'signup' THEN 'REJECTED'
            WHEN 'view' THEN 'IN_PROGRESS' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' END
           AS target_status
FROM events
""")

CTES["suppliers"] = ((), """
SELECT s_suppkey AS supplier_id, s_name AS supplier_name, n_name AS country,
       (60 + (s_suppkey * 37) % 40) / 100 AS reliability_score,
       300 + (s_suppkey * 97) % 1201 AS supplier_capacity_units,
       2 + s_suppkey % 15 AS average_lead_time_days
FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")


def with_ctes(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause holding ``names`` and their dependencies, then ``extra`` CTEs in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n][1].strip()})" for n in order]
    for n, body in extra or []:
        parts.append(f"{n} AS ({body.strip()})")
    return "WITH " + ",\n".join(parts) + "\n"
