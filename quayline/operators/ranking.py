"""Recommendation ranking.

Candidates that come from the solver are ranked beside their event, before they become rows (``rank_candidates``);
a stored table of candidates is ranked by windows over each run (``rank``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..params import DEFAULT_ALLOC, DEFAULT_RANK, AllocationParams, RankingParams
from .allocation import CANDIDATE, STRATEGIES, candidate_columns, end_stage

MODES = ("MIN_COST", "MIN_RISK", "MIN_DELAY", "BALANCED")


def _keys(mode: str, run_keys, rp: RankingParams) -> list[Column]:
    cost, risk, days = F.col("estimated_total_cost"), F.col("estimated_risk"), F.col("estimated_delivery_days")
    m = mode.upper()
    if m == "MIN_RISK":
        return [risk, cost, days]
    if m == "MIN_DELAY":
        return [days, cost, risk]
    if m == "BALANCED":
        w = Window.partitionBy(*run_keys)
        mc = F.greatest(F.max(cost).over(w), F.lit(rp.cost_floor))
        mr = F.greatest(F.max(risk).over(w), F.lit(rp.risk_floor))
        md = F.greatest(F.max(days).over(w), F.lit(rp.delay_floor))
        score = cost / mc * rp.cost_weight + risk / mr * rp.risk_weight + days / md * rp.time_weight
        return [score, cost]
    return [cost, days, risk]  # MIN_COST and unknown modes


def rank(cands: DataFrame, mode: str, run_keys=("event_id",), rp: RankingParams = DEFAULT_RANK) -> DataFrame:
    """Rank per run under ``mode`` (stable: candidate ordinal breaks ties),
    flag rank 1, and cost / risk differences to rank 1."""
    run_keys = list(run_keys)
    keys = _keys(mode, run_keys, rp)
    x = cands.select("*", *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    w = Window.partitionBy(*run_keys).orderBy(*[F.col(f"_k{i}") for i in range(len(keys))], "candidate_ordinal")
    x = x.withColumn("rank", F.row_number().over(w))
    first = Window.partitionBy(*run_keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return x.select(
        *cands.columns, "rank", (F.col("rank") == 1).alias("is_recommended"),
        (F.col("estimated_total_cost") - F.first("estimated_total_cost").over(first)).alias("cost_difference"),
        (F.col("estimated_risk") - F.first("estimated_risk").over(first)).alias("risk_difference"),
        F.lit(mode.upper() if mode.upper() in MODES else "MIN_COST").alias("ranking_mode"))


def placed_candidates(inp: DataFrame, mode: str, rp: RankingParams = DEFAULT_RANK,
                      p: AllocationParams = DEFAULT_ALLOC) -> DataFrame:
    """``inp`` with every candidate of its event as a struct ``_c0`` .. ``_c3`` (null where it is not feasible) and
    its place ``_p0`` .. ``_p3`` (from 1), the number of candidates before it: comparisons of two sort keys, no sort
    and no lambda, so the whole step is compiled."""
    names, m = inp.columns, mode.upper()
    every = range(len(STRATEGIES))
    cands = [F.col(f"_c{i}") for i in every]
    x = end_stage(inp.select("*", F.struct(*[c.alias(f"_c{i}") for i, c in enumerate(candidate_columns(p))]).alias("_all")), "_all")
    x = x.select(*names, "_all.*")
    if m == "BALANCED":
        x = x.select("*", *[F.greatest(*[c[n] for c in cands], F.lit(low)).alias(w) for n, low, w in (
            ("estimated_total_cost", rp.cost_floor, "_mc"), ("estimated_risk", rp.risk_floor, "_mr"),
            ("estimated_delivery_days", rp.delay_floor, "_md"))])

    def keys(c):
        cost, risk, days = c["estimated_total_cost"], c["estimated_risk"], c["estimated_delivery_days"]
        if m == "BALANCED":
            return (cost / F.col("_mc") * rp.cost_weight + risk / F.col("_mr") * rp.risk_weight
                    + days / F.col("_md") * rp.time_weight, cost)
        return {"MIN_RISK": (risk, cost, days), "MIN_DELAY": (days, cost, risk)}.get(m, (cost, days, risk))

    x = x.select(*names, *cands, *[F.when(c.isNotNull(), F.struct(
        *[k.alias(f"k{j}") for j, k in enumerate(keys(c))], c["candidate_ordinal"].alias("o"))).alias(f"_k{i}")
        for i, c in enumerate(cands)])
    # one flag a pair: whether the first of the two comes first; where one is missing, neither is before the other
    x = x.select(*names, *cands, *[(F.col(f"_k{i}") < F.col(f"_k{j}")).alias(f"_b{i}{j}")
                                   for i in every for j in every if i < j])

    def before(i, j):
        return F.when(F.col(f"_b{i}{j}") if i < j else ~F.col(f"_b{j}{i}"), 1).otherwise(0)

    return x.select(*names, *cands, *[F.when(cands[i].isNotNull(), F.lit(1) + sum(before(j, i) for j in every if j != i))
                                      .alias(f"_p{i}") for i in every])


def at_place(place: int, field: str) -> Column:
    """``field`` of the candidate at ``place`` (null if there are fewer) beside ``placed_candidates``."""
    return F.coalesce(*[F.when(F.col(f"_p{i}") == place, F.col(f"_c{i}")[field]) for i in range(len(STRATEGIES))])


def rank_candidates(inp: DataFrame, mode: str, keep=("event_id",), rp: RankingParams = DEFAULT_RANK,
                    p: AllocationParams = DEFAULT_ALLOC) -> DataFrame:
    """X1-X4 without a shuffle: allocation inputs -> ranked candidates with the ``keep`` columns of their event."""
    x = placed_candidates(inp, mode, rp, p).select(
        *keep, at_place(1, "estimated_total_cost").alias("_cost"), at_place(1, "estimated_risk").alias("_risk"),
        F.explode(F.array(*[F.when(F.col(f"_p{i}").isNotNull(), F.struct(F.col(f"_p{i}").alias("at"), F.col(f"_c{i}").alias("c")))
                            for i in range(len(STRATEGIES))])).alias("_o")).where(F.col("_o").isNotNull())
    c, at = F.col("_o.c"), F.col("_o.at")
    return x.select(
        *keep, *[c[f].alias(f) for f in CANDIDATE], at.alias("rank"), (at == 1).alias("is_recommended"),
        (c["estimated_total_cost"] - F.col("_cost")).alias("cost_difference"),
        (c["estimated_risk"] - F.col("_risk")).alias("risk_difference"),
        F.lit(mode.upper() if mode.upper() in MODES else "MIN_COST").alias("ranking_mode"))


def recommended_code(inp: DataFrame, mode: str = "MIN_COST", keep=("event_id",)) -> DataFrame:
    """X8 beside the event: the best candidate's code, ``ALT_A`` when none is feasible."""
    return placed_candidates(inp, mode).select(
        *keep, F.coalesce(at_place(1, "recommendation_code"), F.lit("ALT_A")).alias("recommended_code"))


def best_code(ranked: DataFrame, runs: DataFrame, run_keys=("event_id",)) -> DataFrame:
    """Recommended code per run; ``ALT_A`` when a run has no feasible option."""
    best = ranked.groupBy(*run_keys).agg(F.min_by("recommendation_code", "rank").alias("_code"))
    return runs.select(*run_keys).join(best, list(run_keys), "left").select(
        *run_keys, F.coalesce("_code", F.lit("ALT_A")).alias("recommended_code"))


def comparison(ranked: DataFrame) -> DataFrame:
    """Display table with formatted cost, days, risk and service level."""
    return ranked.select(
        "event_id", "recommendation_code", F.col("strategy_type").alias("strategy"),
        F.concat(F.lit("$"), F.format_number(rnd(F.col("estimated_total_cost"), 2), 2)).alias("estimated_cost"),
        F.concat(F.format_number(rnd(F.col("estimated_delivery_days"), 1), 1), F.lit(" days")).alias("delivery_time"),
        F.format_number(rnd(F.col("estimated_risk"), 2), 2).alias("risk"),
        F.concat(F.format_number(rnd(F.col("service_level_achieved") * 100, 1), 1), F.lit("%")).alias("service_level"),
        "rank", "is_recommended", F.lit("FEASIBLE").alias("feasibility"))


# Explanation wording (ours); fields: description, pros, cons, rationale template.
_EXPLAIN = {
    "AIR_FREIGHT": ("Expedite the shortfall by air", "fastest recovery|lowest disruption risk",
                    "highest freight spend|capacity booked at short notice",
                    "Air covers the gap in %s days at $%s with risk %s."),
    "SECONDARY_SUPPLIER": ("Source the shortfall from a backup supplier", "moderate lead time|keeps launch date",
                           "premium on unit price|new supplier onboarding",
                           "A backup supplier covers the gap in %s days at $%s with risk %s."),
    "DELAY_LAUNCH": ("Postpone the launch until primary supply arrives", "no extra procurement|no expedite cost",
                     "revenue and brand impact|longest delivery time",
                     "Postponing costs $%2$s over %1$s days with risk %3$s."),
    "PRIMARY_SUPPLIER": ("Keep ordering from the primary supplier", "no switching cost|known supplier",
                         "exposed to the predicted delay|no risk reduction",
                         "The primary supplier delivers in %s days at $%s with risk %s."),
    "PARTIAL_ALLOCATION": ("Split the shortfall across sources", "spreads risk|uses spare capacity",
                           "coordination overhead|partial exposure remains",
                           "A split plan delivers in %s days at $%s with risk %s."),
}


def explanations(ranked: DataFrame) -> DataFrame:
    """Description, pros, cons and a rationale with the option's own figures."""
    st = F.col("strategy_type")
    days = F.format_number(rnd(F.col("estimated_delivery_days"), 1), 1)
    cost = F.format_number(rnd(F.col("estimated_total_cost"), 2), 2)
    risk = F.format_number(rnd(F.col("estimated_risk"), 2), 2)
    desc = pros = cons = rat = F.lit(None).cast("string")
    for name, (d, pr, co, tmpl) in _EXPLAIN.items():
        hit = st == name
        desc = F.when(hit, F.lit(d)).otherwise(desc)
        pros = F.when(hit, F.lit(pr)).otherwise(pros)
        cons = F.when(hit, F.lit(co)).otherwise(cons)
        rat = F.when(hit, F.format_string(tmpl, days, cost, risk)).otherwise(rat)
    return ranked.select("event_id", "recommendation_code", "strategy_type", desc.alias("description"),
                         F.split(pros, r"\|").alias("advantages"), F.split(cons, r"\|").alias("disadvantages"),
                         rat.alias("rationale"))
