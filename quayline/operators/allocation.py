"""Recovery allocation (O1-O14) as an exact, row-local column plan.

With the three strategy switches (air, secondary, postpone) fixed, the integer program has linear unit
costs, box capacities and two nested covering constraints: supply including unmet demand >= N = max(0, D-I),
supply without unmet >= M = max(0, floor(D*sla) - I); postponement covers both.  The optimum for a fixed
switch setting is therefore a greedy fill in order of unit cost: M from the cheapest real sources, then N-M
from the cheapest of what is left or unmet.

Two facts prune the eight settings.  Switch costs are never negative and a postponed launch needs no
supply, so of the four postponed settings the one with both other switches off dominates.  And one order of the
four unit costs serves every setting, as an open or closed switch only changes a capacity: the order is
six comparisons a row, and a source's fill is what the capacities before it leave over.  No sort, no shuffle,
no per-event loop, no solver process.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..params import DEFAULT_ALLOC, AllocationParams
from .relational import id_keys

OBJECTIVES = ("MIN_COST", "MIN_RISK", "MIN_DELAY", "BALANCED")
STRATEGIES = ("AIR_FREIGHT", "SECONDARY_SUPPLIER", "DELAY_LAUNCH", "PRIMARY_SUPPLIER")
CODES = {"AIR_FREIGHT": "ALT_A", "SECONDARY_SUPPLIER": "ALT_B", "DELAY_LAUNCH": "ALT_C",
         "PRIMARY_SUPPLIER": "ALT_D", "PARTIAL_ALLOCATION": "ALT_E"}

# Input columns expected by the solver (see ``assemble_inputs``):
#   demand_units D, available_inventory I, unit_cost, base_transport_cost, primary_capacity,
#   secondary_capacity, air_capacity, premium_rate, air_base_cost (nullable), predicted_delay_days,
#   composite_risk, air_multiplier, secondary_multiplier


def _d(x) -> Column:
    return F.lit(float(x))


def top2_capacity(suppliers: DataFrame) -> DataFrame:
    """O3 helper: one row (id1, cap1, cap2) of the two largest supplier capacities.
    A fixed-size 1-row result, safe to broadcast."""
    s = suppliers.select("supplier_id", F.col("supplier_capacity_units").alias("cap"))
    best = s.agg(F.max_by("supplier_id", F.struct("cap", -F.col("supplier_id"))).alias("_id1"),
                 F.max("cap").alias("_cap1"), F.count(F.lit(1)).alias("_n"))
    second = (s.crossJoin(F.broadcast(best)).filter(F.col("supplier_id") != F.col("_id1"))
              .agg(F.max("cap").alias("_cap2")))
    return best.crossJoin(second)


def assemble_inputs(ev: DataFrame, snapshots: DataFrame, suppliers: DataFrame, p: AllocationParams = DEFAULT_ALLOC,
                    air_base_override: float | None = None, premium_override: float | None = None,
                    multipliers: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One allocation input row per event.

    ``ev`` carries the event columns plus ``predicted_delay_days`` and
    ``composite_risk_score``; ``snapshots`` is (event_id, latest_available_units)
    from the as-of stock join; ``multipliers`` is (strategy_type, multiplier_applied); ``keep`` names event
    columns that travel along.
    """
    top = F.broadcast(top2_capacity(suppliers))
    x = ev.join(snapshots, id_keys(ev, snapshots), "left").crossJoin(top)
    prem = (F.lit(float(premium_override)) if premium_override is not None else
            F.when(F.col("secondary_supplier_premium_pct") > 0, F.col("secondary_supplier_premium_pct"))
            .otherwise(_d(p.default_premium)))
    air = (F.lit(float(air_base_override)) if air_base_override is not None else
           F.when(F.col("air_freight_cost_usd") > 0, F.col("air_freight_cost_usd")).otherwise(F.lit(None).cast("double")))
    sec_cap = F.when((F.col("_n") > 1) & (F.col("supplier_id") == F.col("_id1")), F.col("_cap2")) \
        .when(F.col("_n") > 1, F.col("_cap1")).otherwise(F.col("supplier_capacity_units"))
    out = x.select(
        "event_id",
        F.col("demand_units").cast("long").alias("demand_units"),
        F.coalesce(F.col("latest_available_units"), F.lit(0)).cast("long").alias("available_inventory"),
        F.col("unit_cost_usd").alias("unit_cost"),
        F.col("transport_cost_usd").alias("base_transport_cost"),
        F.col("supplier_capacity_units").cast("long").alias("primary_capacity"),
        sec_cap.cast("long").alias("secondary_capacity"),
        F.greatest(F.col("demand_units") * 2, F.lit(p.air_min_capacity)).cast("long").alias("air_capacity"),
        prem.alias("premium_rate"),
        air.alias("air_base_cost"),
        F.col("predicted_delay_days").cast("double").alias("predicted_delay_days"),
        F.col("composite_risk_score").alias("composite_risk"),
        rnd(F.col("demand_units") * F.col("unit_cost_usd") + F.col("transport_cost_usd"), 2).alias("baseline_cost"),
        *keep,
    )
    if multipliers is not None:
        m = multipliers.groupBy().agg(
            F.max(F.when(F.col("strategy_type") == "AIR_FREIGHT", F.col("multiplier_applied"))).alias("_ma"),
            F.max(F.when(F.col("strategy_type") == "SECONDARY_SUPPLIER", F.col("multiplier_applied"))).alias("_ms"))
        out = out.crossJoin(F.broadcast(m)).select(
            *out.columns, F.coalesce("_ma", _d(1)).alias("air_multiplier"),
            F.coalesce("_ms", _d(1)).alias("secondary_multiplier"))
    else:
        out = out.select("*", _d(1).alias("air_multiplier"), _d(1).alias("secondary_multiplier"))
    return out


# ---- O1 ---------------------------------------------------------------------
def _feasible(p: AllocationParams) -> Column:
    """No violation: the flag alone, without the texts of ``violations``."""
    D = F.col("demand_units")
    parts = [D, *[F.col(c) for c in ("available_inventory", "primary_capacity", "secondary_capacity", "air_capacity")]]
    bad = F.lit(False)
    for v in parts:
        bad = bad | F.coalesce(v < 0, F.lit(False))
    if not (p.allow_unmet_demand or p.allow_launch_delay):
        bad = bad | F.coalesce(parts[1] + parts[2] + parts[3] + parts[4] < F.floor(D * _d(p.service_level_target)), F.lit(False))
    return ~bad


def feasibility(inp: DataFrame, p: AllocationParams = DEFAULT_ALLOC) -> DataFrame:
    """O1: violations (make the event infeasible), warnings, net demand, max service level."""
    D, I = F.col("demand_units"), F.col("available_inventory")
    Cp, Cs, Ca = F.col("primary_capacity"), F.col("secondary_capacity"), F.col("air_capacity")
    sla = _d(p.service_level_target)
    neg = [(D < 0, "negative demand"), (I < 0, "negative available inventory"),
           (Cp < 0, "negative primary capacity"), (Cs < 0, "negative secondary capacity"),
           (Ca < 0, "negative air capacity")]
    basic = F.array_compact(F.array(*[F.when(c, F.concat(F.lit(t + ": "), v.cast("string")))
                                      for (c, t), v in zip(neg, (D, I, Cp, Cs, Ca))]))
    supply = I + Cp + Cs + Ca
    required = F.floor(D * sla)
    strict = F.when((supply < required) & F.lit(not p.allow_unmet_demand) & F.lit(not p.allow_launch_delay),
                    F.concat(F.lit("network supply "), supply.cast("string"), F.lit(" below required "),
                             required.cast("string")))
    violations = F.when(F.size(basic) > 0, basic).otherwise(F.array_compact(F.array(strict)))
    warnings = F.when(F.size(basic) > 0, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(
        F.when(supply < D, F.concat(F.lit("network supply "), supply.cast("string"), F.lit(" below demand "),
                                    D.cast("string"))),
        F.when(I >= D, F.lit("stock already covers demand")))))
    return inp.select(
        "*",
        _feasible(p).alias("is_feasible"),
        violations.alias("violations"),
        warnings.alias("warnings"),
        F.when(F.size(basic) > 0, F.greatest(F.lit(0), D - F.greatest(F.lit(0), I)))
        .otherwise(F.greatest(F.lit(0), D - I)).alias("net_demand_units"),
        F.when(F.size(basic) > 0, _d(0)).when(D == 0, _d(1))
        .otherwise(F.least(_d(1), supply / D)).alias("max_service_level"),
    )


# ---- O8 coefficients ----------------------------------------------------------
def _coefficients(objective: str, p: AllocationParams):
    D = F.col("demand_units").cast("double")
    unit = F.col("unit_cost")
    pdd = F.col("predicted_delay_days")
    ma, ms = F.col("air_multiplier"), F.col("secondary_multiplier")
    base = F.col("air_base_cost")
    has_base = base.isNotNull() & (base > 0)
    max_d = F.greatest(D, _d(1))
    ref_cost = F.greatest(_d(1), D * unit * p.ref_cost_factor)
    ref_delay = F.greatest(_d(1), pdd + p.ref_delay_extra)
    obj = objective.upper()
    if obj == "MIN_COST":
        kc, kr, kt = _d(1), _d(0), _d(0)
    elif obj == "MIN_RISK":
        kc, kr, kt = _d(p.dominant_cost_share) / ref_cost, _d(p.dominant_other_share), _d(0)
    elif obj == "MIN_DELAY":
        kc, kr, kt = _d(p.dominant_cost_share) / ref_cost, _d(0), _d(p.dominant_other_share)
    else:
        wc, wr, wt = p.weights("BALANCED")
        kc, kr, kt = _d(wc) / ref_cost, _d(wr), _d(wt)
    c_sec = unit * (_d(1) + F.col("premium_rate")) * ms
    coef = {
        "a_p": kc * unit + kt * (pdd / max_d / ref_delay),
        "a_s": kc * c_sec,
        "a_a": F.when(has_base, _d(0)).otherwise(kc * (_d(p.air_unit_cost) * ma)),
        "a_u": kc * _d(p.shortage_penalty) + kr * (_d(p.unmet_risk) / max_d),
        "f_a": kc * F.when(has_base, base * ma).otherwise(_d(p.air_fixed_cost) * ma)
        + kr * _d(p.air_risk) + kt * (_d(p.air_days) / ref_delay),
        "f_s": kr * _d(p.secondary_risk) + kt * (_d(p.secondary_days) / ref_delay),
        "f_d": kc * (_d(p.delay_fixed_cost) + _d(p.delay_daily_cost) * pdd) + kr * _d(p.delay_risk)
        + kt * (pdd / ref_delay),
    }
    return coef


_COMBOS = [(ya, ys, yd) for yd in (0, 1) for ys in (0, 1) for ya in (0, 1)]


def _combo_order(ya, ys, yd):
    # tie order: fewest switches, then air < secondary < postpone
    return ya + ys + yd, (0 if ya else 1) * 4 + (0 if ys else 1) * 2 + (0 if yd else 1)


def _stage(df: DataFrame, cols: dict) -> DataFrame:
    """One projection per fill step keeps the expression tree linear (Catalyst does
    not inline a non-trivial expression that is referenced more than once)."""
    return df.select("*", *[v.alias(k) for k, v in cols.items()])


def end_stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` as it is, with the never null column ``name`` sent through a one-element ``explode``.

    Catalyst inlines nothing over it, and the lambda of ``array_compact`` ends the code generation stage:
    one method for the whole solve would pass the 8 KB above which the JVM interprets it for every row."""
    return df.select(*[F.explode(F.array_compact(F.array(F.col(c)))).alias(c) if c == name else F.col(c) for c in df.columns])


def pass_rows(df: DataFrame) -> DataFrame:
    """``df`` as it is, behind a ``coalesce`` to more partitions than there are: no row is copied or moved.

    It ends the code generation stage like ``end_stage`` at no cost a row, but hides how the rows are partitioned from
    the operators above, so it is for places with no join or grouping after them."""
    return df.coalesce(1 << 20)


def solve(inp: DataFrame, objective: str = "MIN_COST", p: AllocationParams = DEFAULT_ALLOC) -> DataFrame:
    """Optimal allocation per event under ``objective``.

    The undominated settings are filled side by side in staged projections and the best (objective,
    total quantity, switch count, order) struct is taken with ``least`` over structs.
    """
    names = inp.columns
    x = _stage(inp, {"is_feasible": _feasible(p)})
    x = _stage(x, {f"_{k}": v for k, v in _coefficients(objective, p).items()})
    D, I = F.col("demand_units"), F.col("available_inventory")
    zero = F.lit(0).cast("long")
    cost = {n: F.col(f"_a_{n}") for n in "psau"}
    # _b_xy: 1 where source x is used up before y (equal costs: primary, secondary, air, unmet)
    order = "psau"
    before = {f"_b_{m}{n}": (cost[m] <= cost[n]) if order.index(m) < order.index(n) else (cost[m] < cost[n])
              for m in order for n in order if m != n}
    x = _stage(x, {
        "_N": F.greatest(zero, D - I),
        "_M": F.when(D > 0, F.greatest(zero, F.floor(D * _d(p.service_level_target)).cast("long") - I)).otherwise(zero),
        **before})
    x = pass_rows(x)
    capacity = {"p": F.col("primary_capacity"), "s": F.col("secondary_capacity"), "a": F.col("air_capacity")}

    def left_of(n, used, need, amount):
        """``need`` less what the sources used before ``n`` give."""
        for m in used:
            if m != n:
                need = need - F.when(F.col(f"_b_{m}{n}"), amount(m)).otherwise(zero)
        return need

    def fill(need, cap):
        return F.greatest(zero, F.least(cap, need))

    settings = [(ya, ys) for ys in (0, 1) for ya in (0, 1)]
    real = {k: "p" + "s" * ys + "a" * ya for k, (ya, ys) in enumerate(settings)}
    unmet = "u" if p.allow_unmet_demand else ""
    # the service-level part M, from real sources only
    x = _stage(x, {f"_m{k}{n}": fill(left_of(n, on, F.col("_M"), capacity.get), capacity[n])
                   for k, on in real.items() for n in on})
    x = _stage(x, {f"_got{k}": sum((F.col(f"_m{k}{n}") for n in on), zero) for k, on in real.items()})

    def rest(k):
        # unmet demand never exceeds the whole need
        return lambda m: F.col("_N") if m == "u" else capacity[m] - F.col(f"_m{k}{m}")

    x = _stage(x, {f"_r{k}{n}": fill(left_of(n, on + unmet, F.col("_N") - F.col(f"_got{k}"), rest(k)), rest(k)(n))
                   for k, on in real.items() for n in on + unmet})
    x = pass_rows(x)
    structs = []
    for k, (ya, ys) in enumerate(settings):
        on = real[k]
        q = {n: F.col(f"_m{k}{n}") + F.col(f"_r{k}{n}") if n in on else F.col(f"_r{k}u") if n == "u" and unmet else zero
             for n in order}
        ok = (F.col(f"_got{k}") >= F.col("_M")) & (q["p"] + q["s"] + q["a"] + q["u"] >= F.col("_N"))
        structs.append(_option(ok, q, ya, ys, 0))
    if p.allow_launch_delay:
        structs.append(_option(F.lit(True), {n: zero for n in order}, 0, 0, 1))
    x = _stage(x, {"_best": F.least(*structs)})
    # filters on solver outputs stay above this point, never inlined into the staged fill
    x = end_stage(x.select(*names, "is_feasible", "_best"), "_best")
    return _finish(x, p, optimal=F.col("is_feasible") & (F.col("_best.infeasible") == 0))


def _option(ok: Column, q: dict, ya: int, ys: int, yd: int) -> Column:
    """One switch setting as a struct whose order is the choice between settings."""
    value = (F.col("_a_p") * q["p"] + F.col("_a_s") * q["s"] + F.col("_a_a") * q["a"] + F.col("_a_u") * q["u"]
             + F.col("_f_a") * ya + F.col("_f_s") * ys + F.col("_f_d") * yd)
    switches, order = _combo_order(ya, ys, yd)
    return F.struct(
        F.when(ok, F.lit(0)).otherwise(F.lit(1)).alias("infeasible"), value.alias("objective"),
        (q["p"] + q["s"] + q["a"] + q["u"]).alias("total_qty"), F.lit(switches).alias("nb"), F.lit(order).alias("ord"),
        q["p"].alias("qp"), q["s"].alias("qs"), q["a"].alias("qa"), q["u"].alias("qu"),
        F.lit(ya).alias("ya"), F.lit(ys).alias("ys"), F.lit(yd).alias("yd"))


def _finish(x: DataFrame, p: AllocationParams, optimal: Column) -> DataFrame:
    """Solution shape shared by the free solve and the forced strategies (O10-O14), staged."""
    base_cols = [c for c in x.columns if c != "_best"]
    D = F.col("demand_units")
    I = F.col("available_inventory")
    zero = F.lit(0).cast("long")
    x = _stage(x, {"_opt": optimal})
    opt = F.col("_opt")
    x = _stage(x, {
        "primary_quantity": F.when(opt, F.col("_best.qp")).otherwise(zero),
        "secondary_quantity": F.when(opt, F.col("_best.qs")).otherwise(zero),
        "air_quantity": F.when(opt, F.col("_best.qa")).otherwise(zero),
        "unmet_demand": F.when(opt, F.col("_best.qu")).otherwise(D),
        "is_launch_delayed": opt & (F.col("_best.yd") == 1),
        "_ya": F.col("_best.ya"), "_ys": F.col("_best.ys"), "_obj": F.col("_best.objective")})
    qp, qs, qa, qu = (F.col(c) for c in ("primary_quantity", "secondary_quantity", "air_quantity", "unmet_demand"))
    yd = F.col("is_launch_delayed")
    x = _stage(x, {"_air": opt & ((qa > 0) | (F.col("_ya") == 1)), "_sec": opt & ((qs > 0) | (F.col("_ys") == 1))})
    use_air, use_sec = F.col("_air"), F.col("_sec")
    strategies = F.array_compact(F.array(F.when(use_air, F.lit("AIR_FREIGHT")), F.when(use_sec, F.lit("SECONDARY_SUPPLIER")),
                                         F.when(yd, F.lit("DELAY_LAUNCH")), F.when(opt & (qp > 0), F.lit("PRIMARY_SUPPLIER"))))
    ma, ms = F.col("air_multiplier"), F.col("secondary_multiplier")
    unit = F.col("unit_cost")
    base = F.when(use_air, F.col("air_base_cost"))
    x = _stage(x, {
        "selected_strategies": F.when(~opt, F.array().cast("array<string>"))
        .when(F.size(strategies) == 0, F.array(F.lit("PRIMARY_SUPPLIER"))).otherwise(strategies),
        "_c_pp": qp * unit,
        "_c_pt": F.when(qp > 0, F.col("base_transport_cost")).otherwise(_d(0)),
        "_c_sp": qs * unit,
        "_c_sprem": qs * unit * F.col("premium_rate") * ms,
        "_c_air": F.when(base.isNotNull() & (base > 0), F.when(qa > 0, base).otherwise(_d(0)) * ma)
        .otherwise((F.when(qa > 0, _d(p.air_fixed_cost)).otherwise(_d(0)) + qa * _d(p.air_unit_cost)) * ma),
        "_c_short": qu * _d(p.shortage_penalty),
        "_c_delay": F.when(yd, _d(p.delay_fixed_cost) + _d(p.delay_daily_cost) * F.col("predicted_delay_days"))
        .otherwise(_d(0)),
        "_ful": I + qp + qs + qa})
    total = (F.col("_c_pp") + F.col("_c_pt") + F.col("_c_sp") + F.col("_c_sprem") + F.col("_c_air")
             + F.col("_c_short") + F.col("_c_delay"))
    x = _stage(x, {"_total": total})
    ful = F.col("_ful")
    service = F.when(~opt, _d(0)).when(D == 0, _d(1)).otherwise(F.least(_d(1), ful / D))
    x = _stage(x, {"service_level_achieved": service})
    days = F.when(~opt, F.col("predicted_delay_days")).when(use_air, _d(p.air_days)) \
        .when(use_sec, _d(p.secondary_days)).otherwise(F.col("predicted_delay_days"))
    risk = F.when(~opt, _d(1)).when(use_air, _d(p.air_risk)).when(use_sec, _d(p.secondary_risk)) \
        .when(yd, _d(p.delay_risk)).otherwise(F.col("composite_risk"))
    return x.select(
        *base_cols,
        F.when(opt, F.lit("OPTIMAL")).otherwise(F.lit("INFEASIBLE")).alias("solver_status"),
        F.when(opt, F.col("_obj")).alias("objective_value"),
        "primary_quantity", "secondary_quantity", "air_quantity", "unmet_demand", "is_launch_delayed",
        "selected_strategies",
        F.struct(F.col("_c_pp").alias("primary_procurement_cost"), F.col("_c_pt").alias("primary_transport_cost"),
                 F.col("_c_sp").alias("secondary_procurement_cost"), F.col("_c_sprem").alias("secondary_premium_cost"),
                 F.col("_c_air").alias("air_freight_cost"), F.col("_c_short").alias("shortage_penalty_cost"),
                 F.col("_c_delay").alias("launch_delay_cost"), F.col("_total").alias("total_cost")).alias("cost_breakdown"),
        F.when(opt, F.col("_total")).otherwise(_d(0)).alias("estimated_total_cost"),
        "service_level_achieved",
        days.alias("estimated_delivery_days"),
        risk.alias("estimated_risk"),
        F.when(opt, F.struct(
            (ful + qu - D).alias("demand_fulfillment_slack"),
            (F.col("primary_capacity") - qp).alias("primary_capacity_remaining"),
            (F.col("secondary_capacity") - qs).alias("secondary_capacity_remaining"),
            (F.col("air_capacity") - qa).alias("air_capacity_remaining"),
            _d(p.service_level_target).alias("service_level_target"),
            F.col("service_level_achieved").alias("service_level_achieved"))).alias("slack"),
    )


def solve_forced(inp: DataFrame, strategy, p: AllocationParams = DEFAULT_ALLOC) -> DataFrame:
    """Evaluate a strategy with its fixed switches; closed form (need = max(0, D - I)).

    ``strategy`` is a name or a string column (one strategy per row)."""
    st = F.lit(strategy) if isinstance(strategy, str) else strategy
    x = feasibility(inp, p).withColumn("strategy_type", st)
    st = F.col("strategy_type")
    D, I = F.col("demand_units"), F.col("available_inventory")
    need = F.greatest(F.lit(0).cast("long"), D - I)
    zero = F.lit(0).cast("long")
    is_air, is_sec = st == "AIR_FREIGHT", st == "SECONDARY_SUPPLIER"
    is_delay, is_prim = st == "DELAY_LAUNCH", st == "PRIMARY_SUPPLIER"
    ok = (F.when(is_air, need <= F.col("air_capacity")).when(is_sec, need <= F.col("secondary_capacity"))
          .when(is_delay, F.lit(True)).when(is_prim, need <= F.col("primary_capacity")).otherwise(F.lit(False)))
    best = F.struct(F.lit(0).alias("infeasible"), F.lit(None).cast("double").alias("objective"),
                    F.when(is_prim, need).otherwise(zero).alias("qp"),
                    F.when(is_sec, need).otherwise(zero).alias("qs"),
                    F.when(is_air, need).otherwise(zero).alias("qa"), zero.alias("qu"),
                    is_air.cast("int").alias("ya"), is_sec.cast("int").alias("ys"), is_delay.cast("int").alias("yd"))
    x = x.withColumn("_best", best)
    code = F.lit(None).cast("string")
    for name, c in CODES.items():
        code = F.when(st == name, F.lit(c)).otherwise(code)
    out = _finish(x, p, optimal=F.col("is_feasible") & ok)
    return out.withColumn("recommendation_code", code)


#: Fields of a candidate, in the order of ``candidate_columns``'s structs.
CANDIDATE = ("candidate_ordinal", "strategy_type", "recommendation_code", "estimated_total_cost",
             "estimated_delivery_days", "estimated_risk", "service_level_achieved")


def candidate_columns(p: AllocationParams = DEFAULT_ALLOC) -> list[Column]:
    """X1 beside its event: per strategy the forced candidate as a ``CANDIDATE`` struct, null if it is not feasible.

    The closed forms of ``solve_forced``, one per strategy, so an event's candidates never leave its row."""
    D, I, unit = F.col("demand_units"), F.col("available_inventory"), F.col("unit_cost")
    ma, ms, pdd, base = (F.col(c) for c in ("air_multiplier", "secondary_multiplier", "predicted_delay_days", "air_base_cost"))
    zero = F.lit(0).cast("long")
    need = F.greatest(zero, D - I)
    some = need > 0
    air = F.when(base > 0, F.when(some, base).otherwise(_d(0)) * ma).otherwise(
        (F.when(some, _d(p.air_fixed_cost)).otherwise(_d(0)) + need * _d(p.air_unit_cost)) * ma)
    forms = {
        "AIR_FREIGHT": (need <= F.col("air_capacity"), air, need, _d(p.air_days), _d(p.air_risk)),
        "SECONDARY_SUPPLIER": (need <= F.col("secondary_capacity"), need * unit + need * unit * F.col("premium_rate") * ms,
                               need, _d(p.secondary_days), _d(p.secondary_risk)),
        "DELAY_LAUNCH": (F.lit(True), _d(p.delay_fixed_cost) + _d(p.delay_daily_cost) * pdd, zero, pdd, _d(p.delay_risk)),
        "PRIMARY_SUPPLIER": (need <= F.col("primary_capacity"),
                             need * unit + F.when(some, F.col("base_transport_cost")).otherwise(_d(0)), need, pdd,
                             F.col("composite_risk")),
    }
    feasible = _feasible(p)
    out = []
    for k, name in enumerate(STRATEGIES):
        ok, cost, supply, days, risk = forms[name]
        service = F.when(D == 0, _d(1)).otherwise(F.least(_d(1), (I + supply) / D))
        values = (F.lit(k), F.lit(name), F.lit(CODES[name]), cost, days, risk, service)
        out.append(F.when(feasible & ok, F.struct(*[v.alias(n) for n, v in zip(CANDIDATE, values)])))
    return out


def alternatives(inp: DataFrame, p: AllocationParams = DEFAULT_ALLOC) -> DataFrame:
    """The four forced candidates per event (one scan, ``explode`` x4), feasible ones only."""
    cands = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(STRATEGIES)]))
    x = inp.withColumn("_cand", cands)
    x = x.withColumn("candidate_ordinal", F.col("_cand.k"))
    out = solve_forced(x, F.col("_cand.s"), p).drop("_cand")
    return out.filter(F.col("solver_status") == "OPTIMAL")
