"""O8 against exhaustive enumeration on small instances; golden forced strategies; ranking."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quayline.operators import allocation, ranking
from quayline.params import AllocationParams

P = AllocationParams()
COLS = ("event_id string, demand_units long, available_inventory long, unit_cost double, base_transport_cost double, "
        "primary_capacity long, secondary_capacity long, air_capacity long, premium_rate double, air_base_cost double, "
        "predicted_delay_days double, composite_risk double, air_multiplier double, secondary_multiplier double")


def brute(row, objective):
    (eid, D, I, unit, tr, Cp, Cs, Ca, prem, base, pdd, comp, ma, ms) = row
    ref_cost = max(1.0, D * unit * 1.5)
    ref_delay = max(1.0, pdd + 5.0)
    maxd = max(1, D)
    wc, wr, wt = {"MIN_COST": (1, 0, 0), "MIN_RISK": (0.2 / ref_cost, 0.8, 0),
                  "MIN_DELAY": (0.2 / ref_cost, 0, 0.8), "BALANCED": (0.34 / ref_cost, 0.33, 0.33)}[objective]
    best = None
    M = max(0, int(D * 0.95) - I) if D > 0 else 0
    N = max(0, D - I)
    for ya, ys, yd in itertools.product((0, 1), repeat=3):
        for xp in range(Cp + 1):
            for xs in range(Cs * ys + 1):
                for xa in range(Ca * ya + 1):
                    for u in range(max(D, 0) + 1):
                        if I + xp + xs + xa + u + D * yd < D:
                            continue
                        if D > 0 and I + xp + xs + xa + D * yd < int(D * 0.95):
                            continue
                        cost = unit * xp + unit * (1 + prem) * ms * xs + 250 * u + (5000 + 1200 * pdd) * yd
                        cost += (base * ma * ya) if base else (2500 * ma * ya + 12.5 * ma * xa)
                        risk = 0.08 * ya + 0.15 * ys + 0.35 * yd + 0.95 * u / maxd
                        delay = 2 * ya + 7 * ys + pdd * yd + pdd * xp / maxd
                        obj = cost * wc + wr * risk + wt * delay / ref_delay
                        if best is None or obj < best - 1e-9:
                            best = obj
    return best


def test_allocation_matches_enumeration(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(40):
        D = rnd.randint(0, 6)
        rows.append((f"e{i}", D, rnd.randint(0, 4), float(rnd.randint(1, 9)), float(rnd.randint(0, 50)),
                     rnd.randint(0, 4), rnd.randint(0, 4), rnd.randint(0, 4), rnd.choice([0.05, 0.1, 0.2]),
                     rnd.choice([None, 30.0]), float(rnd.randint(0, 9)), 0.3, 1.0, 1.0))
    df = spark.createDataFrame(rows, COLS)
    for obj in allocation.OBJECTIVES:
        got = {r["event_id"]: r["objective_value"] for r in allocation.solve(df, obj).collect()}
        for row in rows:
            assert got[row[0]] == pytest.approx(brute(row, obj), rel=1e-9, abs=1e-9), (obj, row)


def golden(spark, demand=1000, inventory=0):
    row = ("G", demand, inventory, 125.5, 2000.0, 5000, 5000, max(2 * demand, 25000), 0.10, 15000.0, 14.0, 0.5, 1.0, 1.0)
    return spark.createDataFrame([row], COLS)


def test_golden_forced_strategies(spark):
    alts = {r["strategy_type"]: r for r in allocation.alternatives(golden(spark)).collect()}
    assert alts["AIR_FREIGHT"]["estimated_total_cost"] == pytest.approx(15000.0)
    assert alts["AIR_FREIGHT"]["estimated_delivery_days"] == 2.0
    assert alts["SECONDARY_SUPPLIER"]["estimated_total_cost"] == pytest.approx(138050.0)
    assert alts["SECONDARY_SUPPLIER"]["estimated_delivery_days"] == 7.0
    assert alts["DELAY_LAUNCH"]["estimated_total_cost"] == pytest.approx(21800.0)
    assert alts["DELAY_LAUNCH"]["estimated_delivery_days"] == 14.0
    assert alts["PRIMARY_SUPPLIER"]["estimated_total_cost"] == pytest.approx(127500.0)


def test_zero_demand(spark):
    r = allocation.solve(golden(spark, demand=0), "MIN_COST").first()
    assert r["estimated_total_cost"] == 0.0 and r["service_level_achieved"] == 1.0


def test_infeasible_without_escape(spark):
    p = AllocationParams(allow_unmet_demand=False, allow_launch_delay=False)
    row = ("X", 100, 0, 10.0, 5.0, 0, 0, 0, 0.1, None, 3.0, 0.5, 1.0, 1.0)
    r = allocation.solve(spark.createDataFrame([row], COLS), "MIN_COST", p).first()
    assert r["solver_status"] == "INFEASIBLE" and r["unmet_demand"] == 100 and r["estimated_risk"] == 1.0


def test_ranking_modes(spark):
    rows = [("R", "ALT_A", "AIR_FREIGHT", 15000.0, 2.0, 0.08, 0), ("R", "ALT_B", "SECONDARY_SUPPLIER", 138050.0, 7.0, 0.15, 1),
            ("R", "ALT_C", "DELAY_LAUNCH", 21800.0, 14.0, 0.35, 2)]
    c = spark.createDataFrame(rows, "event_id string, recommendation_code string, strategy_type string, "
                                    "estimated_total_cost double, estimated_delivery_days double, estimated_risk double, "
                                    "candidate_ordinal int")
    expect = {"MIN_COST": "ACB", "MIN_RISK": "ABC", "MIN_DELAY": "ABC"}
    for mode, order in expect.items():
        r = ranking.rank(c, mode).orderBy("rank").collect()
        assert "".join(x["recommendation_code"][-1] for x in r) == order
        assert r[0]["is_recommended"] and r[0]["cost_difference"] == 0.0


def test_candidates_in_the_row_equal_the_ranked_table(spark):
    rnd = random.Random(4)
    rows = [(f"e{i}", rnd.randint(0, 60), rnd.randint(-1, 40), float(rnd.randint(1, 9)), float(rnd.randint(0, 50)), rnd.randint(0, 40),
             rnd.randint(0, 40), rnd.randint(0, 40), 0.1, rnd.choice([None, 30.0, 0.0]), float(rnd.randint(0, 9)), 0.3, 1.1, 0.9)
            for i in range(60)]
    df = spark.createDataFrame(rows, COLS)
    fields = ("event_id", "recommendation_code", "strategy_type", "estimated_total_cost", "estimated_delivery_days", "estimated_risk",
              "service_level_achieved", "rank", "is_recommended", "cost_difference", "risk_difference", "ranking_mode")
    for mode in (*ranking.MODES, "other"):
        want = {tuple(r) for r in ranking.rank(allocation.alternatives(df), mode).select(*fields).collect()}
        got = {tuple(r) for r in ranking.rank_candidates(df, mode).select(*fields).collect()}
        assert got == want, mode


def test_free_optimum_is_never_worse_than_a_forced_strategy(spark):
    rnd = random.Random(8)
    rows = [(f"e{i}", rnd.randint(0, 900), rnd.randint(0, 400), float(rnd.randint(1, 90)), float(rnd.randint(0, 5000)), rnd.randint(0, 900),
             rnd.randint(0, 900), rnd.randint(0, 2000), 0.1, rnd.choice([None, 3000.0]), float(rnd.randint(0, 20)), 0.3, 1.0, 1.0)
            for i in range(80)]
    df = spark.createDataFrame(rows, COLS)
    for obj in allocation.OBJECTIVES:
        free = {r.event_id: r for r in allocation.solve(df, obj).collect()}
        co = allocation._coefficients(obj, AllocationParams())
        x = df.select("event_id", "demand_units", "available_inventory", "primary_capacity", "secondary_capacity", "air_capacity",
                      *[v.alias(k) for k, v in co.items()]).collect()
        for r in x:
            need = max(0, r.demand_units - r.available_inventory)
            forced = [r.f_d]
            forced += [r.a_p * need] if need <= r.primary_capacity else []
            forced += [r.a_s * need + r.f_s] if need <= r.secondary_capacity else []
            forced += [r.a_a * need + r.f_a] if need <= r.air_capacity else []
            assert free[r.event_id].solver_status == "OPTIMAL"
            assert free[r.event_id].objective_value <= min(forced) + 1e-9, (obj, r)
