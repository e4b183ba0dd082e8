"""Allocation and recommendation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rnd, rnd_signed
from ..operators import allocation, ranking, risk
from ..params import DEFAULT_ALLOC as AP
from ..sources import fixtures
from ..sources.fixtures_sql import CTES
from . import sqlbase as S
from .common import assessed, in_steps, kept_events, risk_inputs
from .registry import register
from .risk_q import asof_inventory, kept_stock

R, RS = S.R, S.RS


def alloc_inputs(spark, sf_dir, keep=(), ev=None, pred=None, multipliers=None):
    """Allocation inputs.  Of large tables the rated events and the as-of stock are steps of their own, ``inputs.steps``; ``ev``
    and ``pred`` are those that a caller has kept already."""
    steps = ()
    if ev is not None or in_steps(spark, sf_dir):
        ev = kept_events(spark, sf_dir) if ev is None else ev
        snap = kept_stock(spark, sf_dir, ev)
        steps = (ev, snap)
        a = risk.assess(risk_inputs(spark, sf_dir, ev, pred))
    else:
        a = assessed(spark, sf_dir)
        snap = asof_inventory(spark, sf_dir, fixtures.supply_events(spark, sf_dir))
    out = allocation.assemble_inputs(a, snap, fixtures.suppliers(spark, sf_dir), multipliers=multipliers, keep=keep)
    out.steps = steps
    return out


# ---------------------------------------------------------------- oracle SQL
_INPUTS_SQL = f"""
, inv AS ({CTES["inventory"][1]}),
sups AS ({CTES["suppliers"][1]}),
snap AS (
  SELECT e.event_id, i.available_units,
         row_number() OVER (PARTITION BY e.event_id ORDER BY i.inventory_date DESC, i.inventory_id ASC) AS rn
  FROM supply_events e JOIN inv i ON i.product_id = e.part_key AND i.inventory_date <= e.date),
top1 AS (SELECT supplier_id AS id1, supplier_capacity_units AS cap1 FROM sups
         ORDER BY supplier_capacity_units DESC, supplier_id LIMIT 1),
top2 AS (SELECT t.id1, t.cap1, (SELECT max(supplier_capacity_units) FROM sups WHERE supplier_id <> t.id1) AS cap2,
                (SELECT count(*) FROM sups) AS n FROM top1 t),
ain AS (
  SELECT l.event_id, CAST(l.demand_units AS BIGINT) AS demand_units,
         CAST(coalesce(s.available_units, 0) AS BIGINT) AS available_inventory,
         l.unit_cost_usd AS unit_cost, l.transport_cost_usd AS base_transport_cost,
         CAST(l.supplier_capacity_units AS BIGINT) AS primary_capacity,
         CAST(CASE WHEN t.n > 1 AND l.supplier_id = t.id1 THEN t.cap2 WHEN t.n > 1 THEN t.cap1
                   ELSE l.supplier_capacity_units END AS BIGINT) AS secondary_capacity,
         CAST(greatest(l.demand_units * 2, {AP.air_min_capacity}) AS BIGINT) AS air_capacity,
         CASE WHEN l.secondary_supplier_premium_pct > 0 THEN l.secondary_supplier_premium_pct
              ELSE CAST({AP.default_premium!r} AS DOUBLE) END AS premium_rate,
         CASE WHEN l.air_freight_cost_usd > 0 THEN l.air_freight_cost_usd END AS air_base_cost,
         CAST(l.predicted_delay_days AS DOUBLE) AS predicted_delay_days,
         l.composite_risk_score AS composite_risk,
         {R('l.demand_units * l.unit_cost_usd + l.transport_cost_usd', 2)} AS baseline_cost,
         CAST(1 AS DOUBLE) AS air_multiplier, CAST(1 AS DOUBLE) AS secondary_multiplier
  FROM leveled l LEFT JOIN (SELECT * FROM snap WHERE rn = 1) s USING (event_id) CROSS JOIN top2 t),
feas AS (
  SELECT *, NOT (demand_units < 0 OR available_inventory < 0 OR primary_capacity < 0 OR secondary_capacity < 0
                 OR air_capacity < 0) AS is_feasible
  FROM ain)
"""


def _d(x) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def _coef_sql(objective: str) -> str:
    D = "CAST(demand_units AS DOUBLE)"
    max_d = f"greatest({D}, {_d(1)})"
    ref_cost = f"greatest({_d(1)}, {D} * unit_cost * {AP.ref_cost_factor!r})"
    ref_delay = f"greatest({_d(1)}, predicted_delay_days + {AP.ref_delay_extra!r})"
    o = objective.upper()
    if o == "MIN_COST":
        kc, kr, kt = _d(1), _d(0), _d(0)
    elif o == "MIN_RISK":
        kc, kr, kt = f"{_d(AP.dominant_cost_share)} / {ref_cost}", _d(AP.dominant_other_share), _d(0)
    elif o == "MIN_DELAY":
        kc, kr, kt = f"{_d(AP.dominant_cost_share)} / {ref_cost}", _d(0), _d(AP.dominant_other_share)
    else:
        wc, wr, wt = AP.weights("BALANCED")
        kc, kr, kt = f"{_d(wc)} / {ref_cost}", _d(wr), _d(wt)
    kc, kr, kt = f"({kc})", f"({kr})", f"({kt})"
    has_base = "(air_base_cost IS NOT NULL AND air_base_cost > 0)"
    c_sec = f"unit_cost * ({_d(1)} + premium_rate) * secondary_multiplier"
    return f"""
      {kc} * unit_cost + {kt} * (predicted_delay_days / {max_d} / {ref_delay}) AS a_p,
      {kc} * ({c_sec}) AS a_s,
      CASE WHEN {has_base} THEN {_d(0)} ELSE {kc} * ({_d(AP.air_unit_cost)} * air_multiplier) END AS a_a,
      {kc} * {_d(AP.shortage_penalty)} + {kr} * ({_d(AP.unmet_risk)} / {max_d}) AS a_u,
      {kc} * (CASE WHEN {has_base} THEN air_base_cost * air_multiplier ELSE {_d(AP.air_fixed_cost)} * air_multiplier END)
        + {kr} * {_d(AP.air_risk)} + {kt} * ({_d(AP.air_days)} / {ref_delay}) AS f_a,
      {kr} * {_d(AP.secondary_risk)} + {kt} * ({_d(AP.secondary_days)} / {ref_delay}) AS f_s,
      {kc} * ({_d(AP.delay_fixed_cost)} + {_d(AP.delay_daily_cost)} * predicted_delay_days) + {kr} * {_d(AP.delay_risk)}
        + {kt} * (predicted_delay_days / {ref_delay}) AS f_d"""


def _finish_sql(src: str, opt: str) -> str:
    """Solution columns from a relation with qp, qs, qa, qu, ya, ys, yd and flag ``opt``."""
    qp = f"(CASE WHEN {opt} THEN qp ELSE CAST(0 AS BIGINT) END)"
    qs = f"(CASE WHEN {opt} THEN qs ELSE CAST(0 AS BIGINT) END)"
    qa = f"(CASE WHEN {opt} THEN qa ELSE CAST(0 AS BIGINT) END)"
    qu = f"(CASE WHEN {opt} THEN qu ELSE demand_units END)"
    yd = f"({opt} AND yd = 1)"
    air = f"({opt} AND ({qa} > 0 OR ya = 1))"
    sec = f"({opt} AND ({qs} > 0 OR ys = 1))"
    base = f"(CASE WHEN {air} THEN air_base_cost END)"
    c_pp = f"({qp} * unit_cost)"
    c_pt = f"(CASE WHEN {qp} > 0 THEN base_transport_cost ELSE {_d(0)} END)"
    c_sp = f"({qs} * unit_cost)"
    c_sprem = f"({qs} * unit_cost * premium_rate * secondary_multiplier)"
    c_air = (f"(CASE WHEN {base} IS NOT NULL AND {base} > 0 THEN (CASE WHEN {qa} > 0 THEN {base} ELSE {_d(0)} END) * air_multiplier "
             f"ELSE ((CASE WHEN {qa} > 0 THEN {_d(AP.air_fixed_cost)} ELSE {_d(0)} END) + {qa} * {_d(AP.air_unit_cost)}) * air_multiplier END)")
    c_short = f"({qu} * {_d(AP.shortage_penalty)})"
    c_delay = f"(CASE WHEN {yd} THEN {_d(AP.delay_fixed_cost)} + {_d(AP.delay_daily_cost)} * predicted_delay_days ELSE {_d(0)} END)"
    total = f"({c_pp} + {c_pt} + {c_sp} + {c_sprem} + {c_air} + {c_short} + {c_delay})"
    ful = f"(available_inventory + {qp} + {qs} + {qa})"
    service = (f"(CASE WHEN NOT {opt} THEN {_d(0)} WHEN demand_units = 0 THEN {_d(1)} "
               f"ELSE least({_d(1)}, {ful} / demand_units) END)")
    days = (f"(CASE WHEN NOT {opt} THEN predicted_delay_days WHEN {air} THEN {_d(AP.air_days)} "
            f"WHEN {sec} THEN {_d(AP.secondary_days)} ELSE predicted_delay_days END)")
    risk = (f"(CASE WHEN NOT {opt} THEN {_d(1)} WHEN {air} THEN {_d(AP.air_risk)} WHEN {sec} THEN {_d(AP.secondary_risk)} "
            f"WHEN {yd} THEN {_d(AP.delay_risk)} ELSE composite_risk END)")
    strategies = (f"(CASE WHEN NOT {opt} THEN '' ELSE coalesce(nullif(concat_ws(',', "
                  f"CASE WHEN {air} THEN 'AIR_FREIGHT' END, CASE WHEN {sec} THEN 'SECONDARY_SUPPLIER' END, "
                  f"CASE WHEN {yd} THEN 'DELAY_LAUNCH' END, CASE WHEN {qp} > 0 THEN 'PRIMARY_SUPPLIER' END), ''), "
                  f"'PRIMARY_SUPPLIER') END)")
    return f"""SELECT *, CASE WHEN {opt} THEN 'OPTIMAL' ELSE 'INFEASIBLE' END AS solver_status,
      {qp} AS primary_quantity, {qs} AS secondary_quantity, {qa} AS air_quantity, {qu} AS unmet_demand,
      {yd} AS is_launch_delayed, {strategies} AS strategies,
      {c_pp} AS c_pp, {c_pt} AS c_pt, {c_sp} AS c_sp, {c_sprem} AS c_sprem, {c_air} AS c_air,
      {c_short} AS c_short, {c_delay} AS c_delay, {total} AS c_total,
      CASE WHEN {opt} THEN {total} ELSE {_d(0)} END AS estimated_total_cost,
      {service} AS service_level_achieved, {days} AS estimated_delivery_days, {risk} AS estimated_risk,
      {ful} + {qu} - demand_units AS demand_fulfillment_slack,
      primary_capacity - {qp} AS primary_capacity_remaining,
      secondary_capacity - {qs} AS secondary_capacity_remaining, air_capacity - {qa} AS air_capacity_remaining
    FROM {src}"""


def _struct(c, i, cap):
    return f"{{'c': {c}, 'i': {i}, 'cap': CAST({cap} AS BIGINT)}}"


def _solve_sql(objective: str) -> str:
    combos = ", ".join(f"({ya}, {ys}, {yd}, {allocation._combo_order(ya, ys, yd)[0]}, "
                       f"{allocation._combo_order(ya, ys, yd)[1]})" for ya, ys, yd in allocation._COMBOS)
    N = "greatest(CAST(0 AS BIGINT), demand_units - available_inventory)"
    M = (f"(CASE WHEN demand_units > 0 THEN greatest(CAST(0 AS BIGINT), "
         f"CAST(floor(demand_units * {_d(AP.service_level_target)}) AS BIGINT) - available_inventory) ELSE CAST(0 AS BIGINT) END)")
    U = "greatest(demand_units, CAST(100000 AS BIGINT))"
    return f"""
, co AS (SELECT *, {_coef_sql(objective)} FROM feas),
cb AS (SELECT * FROM (VALUES {combos}) t(ya, ys, yd, nb, ord)),
s1 AS (
  SELECT co.*, cb.*,
    CASE WHEN cb.yd = 1 THEN CAST(0 AS BIGINT) ELSE {M} END AS m_req,
    CASE WHEN cb.yd = 1 THEN CAST(0 AS BIGINT) ELSE {N} END AS n_req,
    list_sort([{_struct('a_p', 0, 'primary_capacity')}, {_struct('a_s', 1, 'secondary_capacity * cb.ys')},
               {_struct('a_a', 2, 'air_capacity * cb.ya')}]) AS src
  FROM co CROSS JOIN cb),
s2 AS (
  SELECT *, greatest(CAST(0 AS BIGINT), least(src[1].cap, m_req)) AS m0 FROM s1),
s3 AS (SELECT *, greatest(CAST(0 AS BIGINT), least(src[2].cap, m_req - m0)) AS m1 FROM s2),
s4 AS (SELECT *, greatest(CAST(0 AS BIGINT), least(src[3].cap, m_req - m0 - m1)) AS m2 FROM s3),
s5 AS (SELECT *, list_sort([{_struct('src[1].c', 'src[1].i', 'src[1].cap - m0')}, {_struct('src[2].c', 'src[2].i', 'src[2].cap - m1')},
                            {_struct('src[3].c', 'src[3].i', 'src[3].cap - m2')}, {_struct('a_u', 3, U)}]) AS rst,
              n_req - (m0 + m1 + m2) AS r_req FROM s4),
s6 AS (SELECT *, greatest(CAST(0 AS BIGINT), least(rst[1].cap, r_req)) AS r0 FROM s5),
s7 AS (SELECT *, greatest(CAST(0 AS BIGINT), least(rst[2].cap, r_req - r0)) AS r1 FROM s6),
s8 AS (SELECT *, greatest(CAST(0 AS BIGINT), least(rst[3].cap, r_req - r0 - r1)) AS r2 FROM s7),
s9 AS (SELECT *, greatest(CAST(0 AS BIGINT), least(rst[4].cap, r_req - r0 - r1 - r2)) AS r3 FROM s8),
qq AS (
  SELECT *, """ + ",\n    ".join(
        "(" + " + ".join([f"(CASE WHEN src[{k+1}].i = {i} THEN m{k} ELSE CAST(0 AS BIGINT) END)" for k in range(3)]
                         + [f"(CASE WHEN rst[{k+1}].i = {i} THEN r{k} ELSE CAST(0 AS BIGINT) END)" for k in range(4)])
        + f") AS {n}" for i, n in ((0, "qp"), (1, "qs"), (2, "qa"), (3, "qu"))) + """
  FROM s9),
ev AS (
  SELECT *, a_p * qp + a_s * qs + a_a * qa + a_u * qu + f_a * ya + f_s * ys + f_d * yd AS objective,
         CASE WHEN (m0 + m1 + m2) >= m_req AND (m0 + m1 + m2 + r0 + r1 + r2 + r3) >= n_req THEN 0 ELSE 1 END AS infeasible
  FROM qq),
bst AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id
                   ORDER BY infeasible, objective, qp + qs + qa + qu, nb, ord) AS brn FROM ev) t WHERE brn = 1),
sol AS (""" + _finish_sql("bst", "(is_feasible AND infeasible = 0)") + ")\n"


def _solve_with(objective: str) -> str:
    return S.risk_with() + _INPUTS_SQL + _solve_sql(objective)


_SOL_COLS_SQL = f"""event_id, solver_status,
  CASE WHEN solver_status = 'OPTIMAL' THEN {R('objective', 6)} END AS objective_value,
  primary_quantity, secondary_quantity, air_quantity, unmet_demand, is_launch_delayed, strategies,
  {R('estimated_total_cost', 2)} AS estimated_total_cost, {R('service_level_achieved', 4)} AS service_level_achieved,
  estimated_delivery_days, estimated_risk"""


def _sol_cols(df):
    return df.select(
        "event_id", "solver_status", rnd("objective_value", 6).alias("objective_value"),
        "primary_quantity", "secondary_quantity", "air_quantity", "unmet_demand", "is_launch_delayed",
        F.array_join("selected_strategies", ",").alias("strategies"),
        rnd("estimated_total_cost", 2).alias("estimated_total_cost"),
        rnd("service_level_achieved", 4).alias("service_level_achieved"),
        "estimated_delivery_days", "estimated_risk")


@register("opt_inputs", S.risk_with() + _INPUTS_SQL + """
SELECT event_id, demand_units, available_inventory, unit_cost, base_transport_cost, primary_capacity,
       secondary_capacity, air_capacity, premium_rate, air_base_cost, predicted_delay_days, composite_risk,
       baseline_cost
FROM ain
""")
def opt_inputs(spark, sf_dir):
    """Allocation inputs per event (as-of stock, other-supplier capacity, premium,
    air base cost, air capacity, predicted delay, composite risk, baseline cost)."""
    return alloc_inputs(spark, sf_dir).drop("air_multiplier", "secondary_multiplier")


@register("opt_feasibility", S.risk_with() + _INPUTS_SQL + """
SELECT event_id, is_feasible,
  CAST((CASE WHEN demand_units < 0 THEN 1 ELSE 0 END) + (CASE WHEN available_inventory < 0 THEN 1 ELSE 0 END)
     + (CASE WHEN primary_capacity < 0 THEN 1 ELSE 0 END) + (CASE WHEN secondary_capacity < 0 THEN 1 ELSE 0 END)
     + (CASE WHEN air_capacity < 0 THEN 1 ELSE 0 END) AS INTEGER) AS n_violations,
  CAST(CASE WHEN NOT is_feasible THEN 0
       ELSE (CASE WHEN available_inventory + primary_capacity + secondary_capacity + air_capacity < demand_units THEN 1 ELSE 0 END)
          + (CASE WHEN available_inventory >= demand_units THEN 1 ELSE 0 END) END AS INTEGER) AS n_warnings,
  CASE WHEN NOT is_feasible THEN greatest(0, demand_units - greatest(0, available_inventory))
       ELSE greatest(0, demand_units - available_inventory) END AS net_demand_units,
  CASE WHEN NOT is_feasible THEN CAST(0 AS DOUBLE) WHEN demand_units = 0 THEN CAST(1 AS DOUBLE)
       ELSE (floor(least(CAST(1 AS DOUBLE), (available_inventory + primary_capacity + secondary_capacity + air_capacity)
                                               / demand_units) * 10000 + 0.5) / 10000) END AS max_service_level
FROM feas
""")
def opt_feasibility(spark, sf_dir):
    """O1: feasibility pre-check per event."""
    f = allocation.feasibility(alloc_inputs(spark, sf_dir))
    return f.select("event_id", "is_feasible", F.size("violations").alias("n_violations"),
                    F.size("warnings").alias("n_warnings"), "net_demand_units",
                    rnd("max_service_level", 4).alias("max_service_level"))


def _register_objective(obj: str):
    name = f"opt_allocation_{obj.lower()}"

    @register(name, _solve_with(obj) + f"SELECT {_SOL_COLS_SQL} FROM sol")
    def q(spark, sf_dir):
        return _sol_cols(allocation.solve(alloc_inputs(spark, sf_dir), obj))

    q.__doc__ = f"O8, O11-O14: exact optimal allocation per event under {obj}."
    q.__name__ = name
    return q


for _obj in allocation.OBJECTIVES:
    _register_objective(_obj)


@register("opt_cost_breakdown", _solve_with("MIN_COST") + f"""
SELECT event_id, {R('c_pp', 2)} AS primary_procurement_cost, {R('c_pt', 2)} AS primary_transport_cost,
       {R('c_sp', 2)} AS secondary_procurement_cost, {R('c_sprem', 2)} AS secondary_premium_cost,
       {R('c_air', 2)} AS air_freight_cost, {R('c_short', 2)} AS shortage_penalty_cost,
       {R('c_delay', 2)} AS launch_delay_cost, {R('c_total', 2)} AS total_cost
FROM sol
""")
def opt_cost_breakdown(spark, sf_dir):
    """Seven cost components and total of the MIN_COST allocation."""
    s = allocation.solve(alloc_inputs(spark, sf_dir), "MIN_COST")
    b = "cost_breakdown"
    return s.select("event_id", *[rnd(f"{b}.{c}", 2).alias(c) for c in (
        "primary_procurement_cost", "primary_transport_cost", "secondary_procurement_cost", "secondary_premium_cost",
        "air_freight_cost", "shortage_penalty_cost", "launch_delay_cost", "total_cost")])


@register("opt_slack", _solve_with("BALANCED") + """
SELECT event_id, demand_fulfillment_slack, primary_capacity_remaining, secondary_capacity_remaining,
       air_capacity_remaining FROM sol WHERE solver_status = 'OPTIMAL'
""")
def opt_slack(spark, sf_dir):
    """Constraint slack of the BALANCED allocation."""
    s = allocation.solve(alloc_inputs(spark, sf_dir), "BALANCED").filter(F.col("solver_status") == "OPTIMAL")
    return s.select("event_id", "slack.demand_fulfillment_slack", "slack.primary_capacity_remaining",
                    "slack.secondary_capacity_remaining", "slack.air_capacity_remaining")


# ---------------------------------------------------------------- X1-X8
_FORCED_SQL = S.risk_with() + _INPUTS_SQL + """
, st AS (SELECT * FROM (VALUES (0, 'AIR_FREIGHT', 'ALT_A'), (1, 'SECONDARY_SUPPLIER', 'ALT_B'),
                              (2, 'DELAY_LAUNCH', 'ALT_C'), (3, 'PRIMARY_SUPPLIER', 'ALT_D')) t(candidate_ordinal, strategy_type, recommendation_code)),
fx AS (
  SELECT f.*, st.*, greatest(CAST(0 AS BIGINT), demand_units - available_inventory) AS need FROM feas f CROSS JOIN st),
fy AS (
  SELECT *,
    CASE WHEN strategy_type = 'PRIMARY_SUPPLIER' THEN need ELSE CAST(0 AS BIGINT) END AS qp,
    CASE WHEN strategy_type = 'SECONDARY_SUPPLIER' THEN need ELSE CAST(0 AS BIGINT) END AS qs,
    CASE WHEN strategy_type = 'AIR_FREIGHT' THEN need ELSE CAST(0 AS BIGINT) END AS qa,
    CAST(0 AS BIGINT) AS qu,
    CAST(strategy_type = 'AIR_FREIGHT' AS INTEGER) AS ya, CAST(strategy_type = 'SECONDARY_SUPPLIER' AS INTEGER) AS ys,
    CAST(strategy_type = 'DELAY_LAUNCH' AS INTEGER) AS yd,
    is_feasible AND CASE strategy_type WHEN 'AIR_FREIGHT' THEN need <= air_capacity
      WHEN 'SECONDARY_SUPPLIER' THEN need <= secondary_capacity WHEN 'DELAY_LAUNCH' THEN true
      ELSE need <= primary_capacity END AS fok
  FROM fx),
forced AS (""" + _finish_sql("fy", "fok") + """),
alts AS (SELECT * FROM forced WHERE solver_status = 'OPTIMAL')
"""


@register("opt_forced", _FORCED_SQL + f"""
SELECT event_id, strategy_type, solver_status, primary_quantity, secondary_quantity, air_quantity,
       {R('estimated_total_cost', 2)} AS estimated_total_cost, estimated_delivery_days, estimated_risk,
       {R('service_level_achieved', 4)} AS service_level_achieved
FROM forced
""")
def opt_forced(spark, sf_dir):
    """All four forced strategies per event, feasible or not."""
    inp = alloc_inputs(spark, sf_dir)
    cands = F.explode(F.array(*[F.lit(s) for s in allocation.STRATEGIES]))
    f = allocation.solve_forced(inp.withColumn("_s", cands), F.col("_s"))
    return f.select("event_id", "strategy_type", "solver_status", "primary_quantity", "secondary_quantity",
                    "air_quantity", rnd("estimated_total_cost", 2).alias("estimated_total_cost"),
                    "estimated_delivery_days", "estimated_risk",
                    rnd("service_level_achieved", 4).alias("service_level_achieved"))


def _rank_sql(mode: str) -> str:
    if mode == "MIN_RISK":
        keys = "estimated_risk, estimated_total_cost, estimated_delivery_days"
    elif mode == "MIN_DELAY":
        keys = "estimated_delivery_days, estimated_total_cost, estimated_risk"
    elif mode == "BALANCED":
        keys = "bscore, estimated_total_cost"
    else:
        keys = "estimated_total_cost, estimated_delivery_days, estimated_risk"
    src = "alts"
    if mode == "BALANCED":
        src = ("(SELECT *, estimated_total_cost / greatest(max(estimated_total_cost) OVER (PARTITION BY event_id), 1.0) * 0.34"
               " + estimated_risk / greatest(max(estimated_risk) OVER (PARTITION BY event_id), 0.01) * 0.33"
               " + estimated_delivery_days / greatest(max(estimated_delivery_days) OVER (PARTITION BY event_id), 1.0) * 0.33"
               " AS bscore FROM alts) ab")
    return f"""
, rk AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY {keys}, candidate_ordinal) AS rank FROM {src}),
rk2 AS (SELECT *, rank = 1 AS is_recommended,
   estimated_total_cost - first_value(estimated_total_cost) OVER (PARTITION BY event_id ORDER BY rank) AS cost_difference,
   estimated_risk - first_value(estimated_risk) OVER (PARTITION BY event_id ORDER BY rank) AS risk_difference FROM rk)
"""


def _register_rank(mode: str):
    name = f"rec_rank_{mode.lower()}"

    @register(name, _FORCED_SQL + _rank_sql(mode) + f"""
SELECT event_id, recommendation_code, strategy_type, CAST(rank AS INTEGER) AS rank, is_recommended,
       {RS('cost_difference', 2)} AS cost_difference, {RS('risk_difference', 4)} AS risk_difference
FROM rk2
""")
    def q(spark, sf_dir):
        r = ranking.rank_candidates(alloc_inputs(spark, sf_dir), mode)
        return r.select("event_id", "recommendation_code", "strategy_type", "rank", "is_recommended",
                        rnd_signed("cost_difference", 2).alias("cost_difference"),
                        rnd_signed("risk_difference", 4).alias("risk_difference"))

    q.__doc__ = f"X2-X5: candidates ranked under {mode}."
    q.__name__ = name
    return q


for _m in ranking.MODES:
    _register_rank(_m)


@register("rec_best_code", _FORCED_SQL + """
SELECT event_id, coalesce(first(recommendation_code
    ORDER BY estimated_total_cost, estimated_delivery_days, estimated_risk, candidate_ordinal)
    FILTER (WHERE solver_status = 'OPTIMAL'), 'ALT_A') AS recommended_code
FROM forced GROUP BY event_id
""")
def rec_best_code(spark, sf_dir):
    """Recommended code per run (``ALT_A`` when no option is feasible)."""
    return ranking.recommended_code(alloc_inputs(spark, sf_dir), "MIN_COST")


@register("rec_comparison", _FORCED_SQL + _rank_sql("MIN_COST") + f"""
SELECT event_id, recommendation_code, strategy_type AS strategy,
       '$' || format('{{:,.2f}}', {R('estimated_total_cost', 2)}) AS estimated_cost,
       format('{{:.1f}}', {R('estimated_delivery_days', 1)}) || ' days' AS delivery_time,
       format('{{:.2f}}', {R('estimated_risk', 2)}) AS risk,
       format('{{:.1f}}', {R('service_level_achieved * 100', 1)}) || '%' AS service_level,
       CAST(rank AS INTEGER) AS rank, is_recommended, 'FEASIBLE' AS feasibility
FROM rk2
""")
def rec_comparison(spark, sf_dir):
    """Formatted comparison table."""
    return ranking.comparison(ranking.rank_candidates(alloc_inputs(spark, sf_dir), "MIN_COST"))


@register("rec_explanations")
def rec_explanations(spark, sf_dir):
    """Strategy explanations with the option's figures (wording is ours; rows-only check)."""
    e = ranking.explanations(ranking.rank_candidates(alloc_inputs(spark, sf_dir), "MIN_COST"))
    return e.select("event_id", "recommendation_code", "strategy_type", "description",
                    F.array_join("advantages", "; ").alias("advantages"),
                    F.array_join("disadvantages", "; ").alias("disadvantages"), "rationale")
