"""Outcome measurement (V1-V5) and feedback learning (L1-L10) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning, outcomes
from ..sources import fixtures
from ..sources.fixtures_sql import with_ctes
from . import sqlbase as S
from .registry import register

R, RS = S.R, S.RS

_OUT_SQL = with_ctes("outcomes") + f"""
, rec AS (SELECT * FROM outcomes WHERE execution_status = 'COMPLETED'),
var AS (
  SELECT *, {RS('actual_cost - estimated_cost', 2)} AS cost_variance,
    {RS('CASE WHEN estimated_cost > 0 THEN (actual_cost - estimated_cost) / estimated_cost * 100.0 ELSE 0.0 END', 2)}
      AS cost_variance_pct,
    actual_cost - estimated_cost <= 0 AS is_cost_favorable,
    {RS('CAST(actual_delay_days - estimated_delay_days AS DOUBLE)', 2)} AS delay_variance,
    actual_delay_days - estimated_delay_days <= 0 AS is_delay_favorable,
    {RS('actual_service_level - estimated_service_level', 4)} AS service_level_variance,
    actual_service_level - estimated_service_level >= 0 AS is_service_favorable
  FROM rec),
cls AS (
  SELECT *, CASE WHEN decision_status = 'CANCELLED' THEN 'CANCELLED'
    WHEN actual_service_level < 0.8 OR delay_variance > 5.0
         OR (CASE WHEN estimated_cost > 0 THEN cost_variance / estimated_cost ELSE 0.0 END) > 0.5 THEN 'FAILED'
    WHEN actual_service_level >= 0.95 AND delay_variance <= 0.5
         AND (CASE WHEN estimated_cost > 0 THEN cost_variance / estimated_cost ELSE 0.0 END) <= 0.25 THEN 'SUCCESS'
    ELSE 'PARTIAL_SUCCESS' END AS outcome_status
  FROM var)
"""


def recorded(spark, sf_dir):
    o = fixtures.outcomes(spark, sf_dir)
    return outcomes.classify(outcomes.variances(outcomes.gate(o)))


@register("out_variance", _OUT_SQL + """
SELECT outcome_id, cost_variance, cost_variance_pct, is_cost_favorable, delay_variance, is_delay_favorable,
       service_level_variance, is_service_favorable, outcome_status FROM cls
""")
def out_variance(spark, sf_dir):
    """V1-V3: variances and outcome class of every recorded (COMPLETED) outcome."""
    return recorded(spark, sf_dir).select(
        "outcome_id", "cost_variance", "cost_variance_pct", "is_cost_favorable", "delay_variance",
        "is_delay_favorable", "service_level_variance", "is_service_favorable", "outcome_status")


@register("out_kpis", _OUT_SQL + f"""
SELECT (SELECT count(*) FROM outcomes WHERE execution_status = 'COMPLETED') AS total_executed_decisions,
       count(*) AS total_evaluated_outcomes,
       count(*) FILTER (WHERE outcome_status = 'SUCCESS') AS successful_decisions,
       count(*) FILTER (WHERE outcome_status = 'PARTIAL_SUCCESS') AS partial_success_decisions,
       count(*) FILTER (WHERE outcome_status = 'FAILED') AS failed_decisions,
       coalesce({RS('avg(cost_variance)', 2)}, 0.0) AS average_cost_variance,
       coalesce({RS('avg(delay_variance)', 2)}, 0.0) AS average_delay_variance,
       coalesce({R('avg(actual_service_level)', 4)}, 1.0) AS average_service_level
FROM cls
""")
def out_kpis(spark, sf_dir):
    """V4: aggregate outcome KPIs."""
    return outcomes.kpis(fixtures.outcomes(spark, sf_dir), recorded(spark, sf_dir))


@register("out_by_strategy", _OUT_SQL + f"""
SELECT coalesce(strategy_type, 'UNKNOWN') AS strategy_type, count(*) AS n_outcomes,
       {RS('sum(cost_variance)', 2)} AS total_cost_variance,
       {RS('sum(cost_variance) / count(*)', 2)} AS avg_cost_variance,
       count(*) FILTER (WHERE outcome_status = 'SUCCESS') AS successes,
       {R("count(*) FILTER (WHERE outcome_status = 'SUCCESS') / count(*) * 100.0", 1)} AS success_rate_pct
FROM cls GROUP BY 1
""")
def out_by_strategy(spark, sf_dir):
    """V5: outcome performance per strategy."""
    return outcomes.by_strategy(recorded(spark, sf_dir))


_LEARN_SQL = _OUT_SQL + f"""
, lc AS (
  SELECT *, CASE WHEN estimated_cost > 0 THEN actual_cost / estimated_cost END AS cost_ratio,
    CASE WHEN outcome_status = 'CANCELLED' THEN 'cancelled outcome'
         WHEN estimated_cost <= 0 THEN 'estimate not positive'
         WHEN actual_cost < 0 THEN 'negative actual cost'
         WHEN actual_cost / estimated_cost < 0.2 OR actual_cost / estimated_cost > 3.0
           THEN 'ratio ' || format('{{:,.2f}}', {R('actual_cost / estimated_cost', 2)}) || ' outside permitted range'
    END AS reject_reason
  FROM cls),
vr AS (
  SELECT strategy_type, cost_ratio,
         row_number() OVER (PARTITION BY strategy_type ORDER BY evaluation_date DESC, outcome_id DESC) AS back
  FROM lc WHERE reject_reason IS NULL),
ew AS (
  SELECT strategy_type, count(*) AS n_observations,
         pow(0.8, count(*)) * 1.0 + sum(cost_ratio * pow(0.8, back - 1) * 0.2) AS mu
  FROM vr GROUP BY strategy_type),
mult AS (
  SELECT strategy_type, n_observations,
    CASE WHEN n_observations >= 3 THEN {R('least(greatest(mu, 0.7), 1.3)', 4)} ELSE 1.0 END AS multiplier,
    n_observations >= 3 AND (mu < 0.7 OR mu > 1.3) AS was_clamped
  FROM ew),
fb AS (
  SELECT l.outcome_id, l.strategy_type, l.evaluation_date,
    {RS('l.actual_cost - l.estimated_cost', 2)} AS cost_error,
    {RS('CAST(l.actual_delay_days - l.estimated_delay_days AS DOUBLE)', 2)} AS delay_error,
    {RS('l.actual_risk - l.estimated_risk', 4)} AS risk_error,
    CASE WHEN l.reject_reason IS NULL AND coalesce(m.n_observations, 0) >= 3
         THEN {RS('m.multiplier - 1.0', 4)} ELSE 0.0 END AS weight_adjustment,
    CASE WHEN l.reject_reason IS NOT NULL THEN 'REJECTED' WHEN coalesce(m.n_observations, 0) >= 3 THEN 'LEARNED'
         ELSE 'BASELINE' END AS signal,
    l.reject_reason,
    CASE WHEN l.reject_reason IS NULL THEN CASE WHEN coalesce(m.n_observations, 0) >= 3 THEN {R('m.multiplier', 2)} ELSE 1.0 END END
      AS multiplier_applied,
    coalesce(m.n_observations, 0) AS n_observations,
    coalesce(m.n_observations, 0) >= 3 AND coalesce(m.was_clamped, false) AS was_clamped
  FROM lc l LEFT JOIN mult m USING (strategy_type))
"""


def _checked(spark, sf_dir):
    return learning.candidate_check(recorded(spark, sf_dir))


@register("learn_candidates", _LEARN_SQL + """
SELECT outcome_id, reject_reason IS NULL AS is_valid, reject_reason FROM lc
""")
def learn_candidates(spark, sf_dir):
    """L1: learning safeguard per recorded outcome."""
    return _checked(spark, sf_dir).select("outcome_id", "is_valid", "reject_reason")


@register("learn_ewma", _LEARN_SQL + f"""
SELECT strategy_type, n_observations, multiplier, was_clamped, {R('multiplier', 2)} AS multiplier_applied,
       CASE WHEN n_observations >= 3 THEN {RS('multiplier - 1.0', 4)} ELSE 0.0 END AS weight_adjustment
FROM mult
""")
def learn_ewma(spark, sf_dir):
    """Clamped EWMA cost multiplier per strategy (all rows folded)."""
    return learning.ewma_by_strategy(_checked(spark, sf_dir))


def _feedback(spark, sf_dir):
    c = _checked(spark, sf_dir)
    return learning.feedback_rows(c, learning.ewma_by_strategy(c)), c


@register("learn_feedback", _LEARN_SQL + """
SELECT outcome_id, strategy_type, cost_error, delay_error, risk_error, weight_adjustment, signal, reject_reason, multiplier_applied,
       n_observations, was_clamped FROM fb
""")
def learn_feedback(spark, sf_dir):
    """Feedback rows (rejected ones kept with a marker)."""
    fb, _ = _feedback(spark, sf_dir)
    return fb.drop("evaluation_date")


@register("learn_multipliers", _LEARN_SQL + """
SELECT strategy_type, arg_max(multiplier_applied, (evaluation_date, outcome_id)) AS multiplier_applied
FROM fb WHERE signal <> 'REJECTED' GROUP BY strategy_type
""")
def learn_multipliers(spark, sf_dir):
    """Active multiplier per strategy: that of the newest accepted signal."""
    fb, _ = _feedback(spark, sf_dir)
    return learning.active_multipliers(fb)


@register("learn_strategy_metrics", _LEARN_SQL + f"""
SELECT f.strategy_type, count(*) AS n_feedback, {RS('avg(f.cost_error)', 2)} AS mean_cost_error,
       {RS('avg(f.delay_error)', 2)} AS mean_delay_error,
       {R('arg_max(CASE WHEN l.estimated_cost > 0 THEN l.actual_cost / l.estimated_cost END, (f.evaluation_date, f.outcome_id))', 3)}
         AS latest_cost_ratio
FROM fb f JOIN lc l USING (outcome_id) GROUP BY f.strategy_type
""")
def learn_strategy_metrics(spark, sf_dir):
    """Strategy accuracy metrics."""
    fb, c = _feedback(spark, sf_dir)
    return learning.strategy_metrics(fb, c)
