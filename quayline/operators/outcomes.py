"""Outcome measurement (V1-V5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rnd, rnd_signed
from ..params import DEFAULT_OUTCOME, OutcomeParams
from .relational import ID_HASH, latest_per_key, with_id_hash


def variances(df: DataFrame) -> DataFrame:
    """V1: cost / delay / service variances, cost % (0 when the estimate is not positive), favourability."""
    cv = F.col("actual_cost") - F.col("estimated_cost")
    dv = F.col("actual_delay_days") - F.col("estimated_delay_days")
    sv = F.col("actual_service_level") - F.col("estimated_service_level")
    pct = F.when(F.col("estimated_cost") > 0, cv / F.col("estimated_cost") * 100.0).otherwise(F.lit(0.0))
    return df.select(
        "*",
        rnd_signed(cv, 2).alias("cost_variance"), rnd_signed(pct, 2).alias("cost_variance_pct"),
        (cv <= 0).alias("is_cost_favorable"),
        rnd_signed(dv.cast("double"), 2).alias("delay_variance"), (dv <= 0).alias("is_delay_favorable"),
        rnd_signed(sv, 4).alias("service_level_variance"), (sv >= 0).alias("is_service_favorable"))


def classify(df: DataFrame, p: OutcomeParams = DEFAULT_OUTCOME, cancelled: Column | None = None) -> DataFrame:
    """V2: CANCELLED / FAILED / SUCCESS / PARTIAL_SUCCESS; the overrun uses the 2-dp cost variance."""
    cancelled = cancelled if cancelled is not None else (F.col("decision_status") == "CANCELLED")
    over = F.when(F.col("estimated_cost") > 0, F.col("cost_variance") / F.col("estimated_cost")).otherwise(F.lit(0.0))
    sla, dv = F.col("actual_service_level"), F.col("delay_variance")
    status = (F.when(cancelled, "CANCELLED")
              .when((sla < p.fail_service) | (dv > p.fail_delay) | (over > p.fail_overrun), "FAILED")
              .when((sla >= p.success_service) & (dv <= p.success_delay) & (over <= p.success_overrun), "SUCCESS")
              .otherwise("PARTIAL_SUCCESS"))
    return df.withColumn("outcome_status", status)


def gate(candidates: DataFrame, existing: DataFrame | None = None, key: str = "outcome_id",
         order: list | None = None) -> DataFrame:
    """V3: record an outcome only for COMPLETED decisions without an outcome yet; within
    the batch the first request per decision wins.  The hash of the key stays, for later joins by it."""
    x = candidates.filter(F.col("execution_status") == "COMPLETED")
    if existing is not None:
        x = x.join(existing.select(key), key, "left_anti")
    return latest_per_key(with_id_hash(x, key), [ID_HASH, key], order or [F.col("evaluation_date")], few=True)


def kpis(decisions: DataFrame, recorded: DataFrame) -> DataFrame:
    """V4: executed decisions, evaluated outcomes, class counts and means (defaults when empty)."""
    executed = decisions.agg(F.count_if(F.col("execution_status") == "COMPLETED").alias("total_executed_decisions"))
    s = recorded.agg(
        F.count(F.lit(1)).alias("total_evaluated_outcomes"),
        F.count_if(F.col("outcome_status") == "SUCCESS").alias("successful_decisions"),
        F.count_if(F.col("outcome_status") == "PARTIAL_SUCCESS").alias("partial_success_decisions"),
        F.count_if(F.col("outcome_status") == "FAILED").alias("failed_decisions"),
        F.avg("cost_variance").alias("_acv"), F.avg("delay_variance").alias("_adv"),
        F.avg("actual_service_level").alias("_asl"))
    return executed.crossJoin(s).select(
        "total_executed_decisions", "total_evaluated_outcomes", "successful_decisions", "partial_success_decisions",
        "failed_decisions", F.coalesce(rnd_signed("_acv", 2), F.lit(0.0)).alias("average_cost_variance"),
        F.coalesce(rnd_signed("_adv", 2), F.lit(0.0)).alias("average_delay_variance"),
        F.coalesce(rnd("_asl", 4), F.lit(1.0)).alias("average_service_level"))


def by_strategy(recorded: DataFrame) -> DataFrame:
    """V5: per strategy count, total and mean cost variance, successes, success rate (1 dp)."""
    g = recorded.groupBy(F.coalesce(F.col("strategy_type"), F.lit("UNKNOWN")).alias("strategy_type")).agg(
        F.count(F.lit(1)).alias("n_outcomes"), F.sum("cost_variance").alias("_tcv"),
        F.count_if(F.col("outcome_status") == "SUCCESS").alias("successes"))
    return g.select("strategy_type", "n_outcomes", rnd_signed("_tcv", 2).alias("total_cost_variance"),
                    rnd_signed(F.col("_tcv") / F.col("n_outcomes"), 2).alias("avg_cost_variance"), "successes",
                    rnd(F.col("successes") / F.col("n_outcomes") * 100.0, 1).alias("success_rate_pct"))
