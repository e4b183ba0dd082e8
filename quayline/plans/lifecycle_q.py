"""Decision lifecycle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle, relational
from ..session import discard, materialize
from ..sources import fixtures
from ..sources.fixtures_sql import with_ctes
from .registry import register

_ACCEPT_SQL = """
CASE WHEN l.kind = 'decision' THEN
       l.target_status = r.d
       OR (r.d = 'PENDING' AND l.target_status IN ('APPROVED', 'REJECTED', 'OVERRIDDEN', 'CANCELLED'))
       OR (r.d = 'APPROVED' AND l.target_status IN ('OVERRIDDEN', 'CANCELLED'))
       OR (r.d = 'OVERRIDDEN' AND l.target_status IN ('APPROVED', 'CANCELLED'))
       OR (r.d = 'REJECTED' AND l.target_status = 'CANCELLED')
     WHEN l.kind = 'execution' THEN
       l.target_status = r.e
       OR (NOT (l.target_status IN ('IN_PROGRESS', 'COMPLETED') AND r.d NOT IN ('APPROVED', 'OVERRIDDEN'))
           AND ((r.e = 'NOT_STARTED' AND l.target_status IN ('IN_PROGRESS', 'FAILED'))
             OR (r.e = 'IN_PROGRESS' AND l.target_status IN ('COMPLETED', 'FAILED'))
             OR (r.e = 'FAILED' AND l.target_status = 'IN_PROGRESS')))
     ELSE false END
"""


@register("dec_lifecycle", "WITH RECURSIVE " + with_ctes("lifecycle_log")[len("WITH "):] + f"""
, lg AS (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY ts, request_id) AS rn FROM lifecycle_log),
st AS (
  SELECT r.decision_id, r.rn, r.d, r.e, r.rej, r.done, l.kind, l.target_status, l.ts,
         {_ACCEPT_SQL} AS ok
  FROM (SELECT 1) z, lg l, (SELECT NULL::BIGINT AS decision_id, 0 AS rn, '' AS d, '' AS e, 0 AS rej,
                                   NULL::TIMESTAMP AS done) r WHERE false),
rec(decision_id, rn, d, e, rej, done) AS (
  SELECT decision_id, CAST(0 AS BIGINT), 'PENDING', 'NOT_STARTED', CAST(0 AS BIGINT), CAST(NULL AS TIMESTAMP)
  FROM (SELECT DISTINCT decision_id FROM lg) s
  UNION ALL
  SELECT r.decision_id, r.rn + 1,
         CASE WHEN ({_ACCEPT_SQL}) AND l.kind = 'decision' THEN l.target_status ELSE r.d END,
         CASE WHEN ({_ACCEPT_SQL}) AND l.kind = 'execution' THEN l.target_status ELSE r.e END,
         r.rej + CASE WHEN ({_ACCEPT_SQL}) THEN 0 ELSE 1 END,
         coalesce(r.done, CASE WHEN ({_ACCEPT_SQL}) AND l.kind = 'execution' AND l.target_status = 'COMPLETED'
                                    AND r.e <> 'COMPLETED' THEN l.ts END)
  FROM rec r JOIN lg l ON l.decision_id = r.decision_id AND l.rn = r.rn + 1)
SELECT decision_id, d AS decision_status, e AS execution_status, rn AS n_requests, rej AS n_rejected,
       strftime(done, '%Y-%m-%d %H:%M:%S') AS executed_at
FROM (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY rn DESC) AS k FROM rec) t WHERE k = 1
""".replace("""st AS (
  SELECT r.decision_id, r.rn, r.d, r.e, r.rej, r.done, l.kind, l.target_status, l.ts,
         """ + _ACCEPT_SQL + """ AS ok
  FROM (SELECT 1) z, lg l, (SELECT NULL::BIGINT AS decision_id, 0 AS rn, '' AS d, '' AS e, 0 AS rej,
                                   NULL::TIMESTAMP AS done) r WHERE false),
""", ""))
def dec_lifecycle(spark, sf_dir):
    """Final decision and execution state per decision from its request log."""
    f = lifecycle.fold_lifecycle(fixtures.lifecycle_log(spark, sf_dir))
    return f.select("decision_id", "decision_status", "execution_status", "n_requests", "n_rejected",
                    F.date_format("executed_at", "yyyy-MM-dd HH:mm:ss").alias("executed_at"))


def _requests(spark, sf_dir):
    o = fixtures.outcomes(spark, sf_dir)
    code = F.lit(None).cast("string")
    from ..operators.allocation import CODES
    for s, c in CODES.items():
        code = F.when(F.col("strategy_type") == s, F.lit(c)).otherwise(code)
    return o.select(
        F.col("outcome_id").alias("decision_id"), F.col("outcome_id").alias("event_id"),
        code.alias("recommendation_code"),
        F.when(F.col("order_key") % 53 == 0, F.lit(" "))
         .otherwise(F.concat(F.lit("planner-"), (F.col("order_key") % 7).cast("string"))).alias("decision_maker"),
        F.when(F.col("decision_status") == "CANCELLED", F.lit("REJECTED"))
         .otherwise(F.col("decision_status")).alias("decision_status"),
        F.when(F.col("order_key") % 5 == 0, F.lit(None).cast("string"))
         .when(F.col("order_key") % 5 == 1, F.lit("ok")).otherwise(F.lit("capacity constraint")).alias("decision_reason"),
        F.col("evaluation_date").alias("created_on"))


_REQ_SQL = """
, req AS (
  SELECT outcome_id AS decision_id, outcome_id AS event_id,
         CASE strategy_type WHEN 'AIR_FREIGHT' THEN 'ALT_A' WHEN 'SECONDARY_SUPPLIER' THEN 'ALT_B'
              WHEN 'DELAY_LAUNCH' THEN 'ALT_C' WHEN 'PRIMARY_SUPPLIER' THEN 'ALT_D' END AS recommendation_code,
         CASE WHEN order_key % 53 = 0 THEN ' ' ELSE 'planner-' || CAST(order_key % 7 AS VARCHAR) END AS decision_maker,
         CASE WHEN decision_status = 'CANCELLED' THEN 'REJECTED' ELSE decision_status END AS decision_status,
         CASE WHEN order_key % 5 = 0 THEN NULL WHEN order_key % 5 = 1 THEN 'ok' ELSE 'capacity constraint' END
           AS decision_reason
  FROM outcomes)
"""


def _validated(spark, sf_dir, keep=False):
    from .alloc_q import alloc_inputs
    from ..operators import ranking
    by = (relational.ID_HASH, "event_id")
    inp = alloc_inputs(spark, sf_dir, keep=by[:1])
    recs = ranking.rank_candidates(inp, "MIN_COST", keep=by).select(
        *by, "recommendation_code", "is_recommended", "strategy_type")
    if keep or inp.steps:
        recs = materialize(recs)
        discard(*inp.steps)
    return lifecycle.validate_decisions(relational.with_id_hash(_requests(spark, sf_dir)), recs, strategies=keep)


def _validate_sql():
    from .alloc_q import _FORCED_SQL, _rank_sql
    from ..sources.fixtures_sql import CTES
    return (_FORCED_SQL + _rank_sql("MIN_COST") + f", outcomes AS ({CTES['outcomes'][1]})" + _REQ_SQL + """
, runs AS (SELECT DISTINCT event_id, true AS has_run FROM rk2),
vx AS (
  SELECT q.*, runs.has_run, rk2.is_recommended AS top FROM req q
  LEFT JOIN runs USING (event_id)
  LEFT JOIN rk2 ON rk2.event_id = q.event_id AND rk2.recommendation_code = q.recommendation_code),
vf AS (
  SELECT *, list_filter([
    CASE WHEN has_run IS NULL THEN 'NO_RUN' END,
    CASE WHEN has_run IS NOT NULL AND top IS NULL THEN 'NOT_RECOMMENDED_IN_RUN' END,
    CASE WHEN decision_maker IS NULL OR length(trim(decision_maker)) = 0 THEN 'NO_DECISION_MAKER' END,
    CASE WHEN upper(decision_status) NOT IN ('PENDING', 'APPROVED', 'REJECTED', 'OVERRIDDEN', 'CANCELLED')
         THEN 'BAD_STATUS' END,
    CASE WHEN top IS NOT NULL AND NOT top AND upper(decision_status) <> 'REJECTED' AND upper(decision_status) <> 'OVERRIDDEN'
              AND NOT (decision_reason IS NOT NULL AND length(decision_reason) > 0)
         THEN 'NO_OVERRIDE_REASON' END,
    CASE WHEN top IS NOT NULL AND NOT top AND upper(decision_status) = 'OVERRIDDEN'
              AND (decision_reason IS NULL OR length(trim(decision_reason)) < 5)
         THEN 'SHORT_OVERRIDE_REASON' END], lambda x: x IS NOT NULL) AS failures
  FROM vx)
""")


@register("dec_validate", _validate_sql() + """
SELECT decision_id, len(failures) = 0 AS accepted, CAST(len(failures) AS INTEGER) AS n_failures,
       failures[1] AS first_failure,
       CASE WHEN top IS NOT NULL AND NOT top AND upper(decision_status) = 'APPROVED' THEN 'OVERRIDDEN'
            ELSE upper(decision_status) END AS effective_status
FROM vf
""")
def dec_validate(spark, sf_dir):
    """Decision requests checked against the ranked recommendations of their run."""
    v = _validated(spark, sf_dir)
    return v.select("decision_id", "accepted", F.size("failures").alias("n_failures"),
                    F.try_element_at(F.col("failures"), F.lit(1)).alias("first_failure"), "effective_status")


@register("dec_audit", _validate_sql() + """
SELECT decision_id, coalesce(rk2.strategy_type, 'UNKNOWN') AS strategy,
       row_number() OVER (PARTITION BY vf.event_id ORDER BY vf.decision_id) AS history_position
FROM vf LEFT JOIN rk2 ON rk2.event_id = vf.event_id AND rk2.recommendation_code = vf.recommendation_code
WHERE len(failures) = 0
""")
def dec_audit(spark, sf_dir):
    """Accepted decisions per run, oldest first, with their strategy."""
    v = _validated(spark, sf_dir, keep=True)  # the strategies travel with the checks, by one shuffle
    acc = v.filter("accepted").select(relational.ID_HASH, "decision_id", "event_id", "recommendation_code", "created_on", "chosen")
    h = lifecycle.audit_history(acc, None)
    return h.select("decision_id", "strategy", F.col("history_position").cast("long").alias("history_position"))


@register("dec_newest", with_ctes("outcomes") + _REQ_SQL.replace("outcome_id AS event_id,",
                                                                  "outcome_id AS event_id, evaluation_date AS created_on,") + """
SELECT decision_id, decision_status, created_on FROM req ORDER BY created_on DESC, decision_id DESC LIMIT 100
""")
def dec_newest(spark, sf_dir):
    """Newest-first page of decisions (a top-k, offset 0, limit 100)."""
    r = _requests(spark, sf_dir)
    return relational.newest_page(r, [F.col("created_on").desc(), F.col("decision_id").desc()], 0, 100) \
        .select("decision_id", "decision_status", "created_on")
