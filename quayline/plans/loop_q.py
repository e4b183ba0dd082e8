"""Closed-loop compositions: overview KPIs (A19), the batch loop (A20) and learned costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import allocation, learning, lifecycle, ranking, relational
from ..sources import fixtures
from ..sources.fixtures_sql import with_ctes
from . import sqlbase as S
from ..session import discard, materialize
from .alloc_q import _INPUTS_SQL, _SOL_COLS_SQL, _sol_cols, _solve_sql, alloc_inputs
from .common import assessed, in_steps
from .learning_q import _LEARN_SQL, _checked, recorded
from .lifecycle_q import _requests, _validate_sql
from .registry import register

R, RS = S.R, S.RS
_LEARN_TAIL = _LEARN_SQL[len(with_ctes("outcomes")):]


@register("ana_overview_kpis", S.risk_with() + f", outcomes AS ({with_ctes('outcomes')[len('WITH outcomes AS ('):-2]})"
          + _LEARN_TAIL + f"""
SELECT (SELECT count(*) FROM leveled) AS n_events,
       (SELECT count(*) FROM leveled WHERE risk_level IN ('HIGH', 'CRITICAL')) AS n_high_or_critical,
       (SELECT count(*) FROM leveled WHERE risk_level = 'CRITICAL') AS n_critical,
       (SELECT count(*) FROM outcomes WHERE execution_status <> 'COMPLETED') AS n_pending_execution,
       (SELECT count(*) FROM outcomes WHERE execution_status = 'COMPLETED') AS n_completed,
       (SELECT {RS('avg(cost_variance)', 2)} FROM cls) AS mean_cost_variance
""")
def ana_overview_kpis(spark, sf_dir):
    """Overview KPIs over risk, decisions and outcomes (one-row frames cross-joined)."""
    a = assessed(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("risk_level").isin("HIGH", "CRITICAL")).alias("n_high_or_critical"),
        F.count_if(F.col("risk_level") == "CRITICAL").alias("n_critical"))
    d = fixtures.outcomes(spark, sf_dir).agg(
        F.count_if(F.col("execution_status") != "COMPLETED").alias("n_pending_execution"),
        F.count_if(F.col("execution_status") == "COMPLETED").alias("n_completed"))
    from ..functions.numeric import rnd_signed
    o = recorded(spark, sf_dir).agg(rnd_signed(F.avg("cost_variance"), 2).alias("mean_cost_variance"))
    return a.crossJoin(d).crossJoin(o)


@register("loop_batch", _validate_sql() + _LEARN_TAIL + """
, best AS (SELECT event_id, recommendation_code AS recommended_code FROM rk2 WHERE rank = 1)
SELECT f.event_id, f.risk_level, coalesce(b.recommended_code, 'ALT_A') AS recommended_code,
       len(v.failures) = 0 AS decision_accepted,
       CASE WHEN v.top IS NOT NULL AND NOT v.top AND upper(v.decision_status) = 'APPROVED' THEN 'OVERRIDDEN'
            ELSE upper(v.decision_status) END AS effective_status,
       c.outcome_status,
       CASE WHEN c.outcome_id IS NULL THEN NULL ELSE coalesce(m.multiplier, 1.0) END AS strategy_multiplier
FROM leveled f
LEFT JOIN best b USING (event_id)
LEFT JOIN vf v ON v.event_id = f.event_id
LEFT JOIN cls c ON c.outcome_id = f.event_id
LEFT JOIN mult m ON m.strategy_type = c.strategy_type
""")
def loop_batch(spark, sf_dir):
    """The closed loop as one lazy plan: score -> allocate alternatives -> rank -> decide
    -> measure -> learn, chained by keys (events without a step get nulls, not a failure)."""
    inp = alloc_inputs(spark, sf_dir, keep=(relational.ID_HASH, "risk_level"))
    # the candidates of an event stay in its row: the best one is the recommendation, and the request
    # is checked against the whole list
    by = [relational.ID_HASH, "event_id"]
    ev = ranking.placed_candidates(inp, "MIN_COST").select(
        *by, "risk_level", ranking.at_place(1, "recommendation_code").alias("recommended_code"),
        F.array_compact(F.array(*[F.when(F.col(f"_p{i}").isNotNull(), F.struct(
            F.col(f"_c{i}.recommendation_code").alias("code"), (F.col(f"_p{i}") == 1).alias("top")))
            for i in range(len(allocation.STRATEGIES))])).alias("_opts"))
    c = _checked(spark, sf_dir)
    m = learning.ewma_by_strategy(c)
    if inp.steps:  # large tables: the recommendations and the multipliers are steps too
        ev, m = materialize(ev), materialize(m)
        discard(*inp.steps)
    failures, status = lifecycle.decision_checks(F.col("_opts"))
    asked = F.col("decision_id").isNotNull()
    x = ev.join(relational.with_id_hash(_requests(spark, sf_dir)), by, "left").select(
        *by, "risk_level", "recommended_code",
        F.when(asked, F.size(failures) == 0).alias("decision_accepted"), F.when(asked, status).alias("effective_status"))
    done = c.select(relational.ID_HASH, F.col("outcome_id").alias("event_id"), "outcome_status", "strategy_type")
    out = (x.join(done, by, "left")
           .join(m.select("strategy_type", "multiplier"), "strategy_type", "left"))
    return out.select("event_id", "risk_level", F.coalesce("recommended_code", F.lit("ALT_A")).alias("recommended_code"),
                      "decision_accepted", "effective_status", "outcome_status",
                      F.when(F.col("outcome_status").isNotNull(), F.coalesce("multiplier", F.lit(1.0)))
                      .alias("strategy_multiplier"))


_LEARNED_INPUTS = _INPUTS_SQL.replace(
    "CAST(1 AS DOUBLE) AS air_multiplier, CAST(1 AS DOUBLE) AS secondary_multiplier",
    f"coalesce((SELECT {R('multiplier', 2)} FROM mult WHERE strategy_type = 'AIR_FREIGHT'), CAST(1 AS DOUBLE)) AS air_multiplier, "
    f"coalesce((SELECT {R('multiplier', 2)} FROM mult WHERE strategy_type = 'SECONDARY_SUPPLIER'), CAST(1 AS DOUBLE)) "
    "AS secondary_multiplier")


@register("opt_allocation_learned", S.risk_with() + f", outcomes AS ({with_ctes('outcomes')[len('WITH outcomes AS ('):-2]})"
          + _LEARN_TAIL + _LEARNED_INPUTS + _solve_sql("MIN_COST") + f"SELECT {_SOL_COLS_SQL} FROM sol")
def opt_allocation_learned(spark, sf_dir):
    """MIN_COST allocation with the learned multipliers (2 dp, as applied) of air and secondary."""
    m = learning.ewma_by_strategy(_checked(spark, sf_dir)).select("strategy_type", "multiplier_applied")
    inp = alloc_inputs(spark, sf_dir, multipliers=materialize(m) if in_steps(spark, sf_dir) else m)
    return _sol_cols(allocation.solve(inp, "MIN_COST"))
