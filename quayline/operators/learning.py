"""Feedback learning (L1-L10): safeguarded cost ratios and the EWMA multiplier.

The EWMA mu' = a*r + (1-a)*mu is an affine map of mu, and affine maps compose: a run of m ratios
maps mu to (1-a)^m mu + sum_j a (1-a)^(m-j) r_j.  All rows are folded: the log is range-partitioned
on (strategy, date, id), each range gives one such map per strategy, and the maps are composed in
order (one small row per strategy and range).  A strategy with any share of the rows is spread over
as many tasks, and no ordered list is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rnd, rnd_signed
from ..params import DEFAULT_LEARN, LearningParams


def candidate_check(df: DataFrame, lp: LearningParams = DEFAULT_LEARN) -> DataFrame:
    """L1: (is_valid, reject_reason) per outcome."""
    est, act = F.col("estimated_cost"), F.col("actual_cost")
    ratio = F.when(est > 0, act / est)
    reason = (F.when(F.col("outcome_status") == "CANCELLED", F.lit("cancelled outcome"))
              .when(est <= 0, F.lit("estimate not positive"))
              .when(act < 0, F.lit("negative actual cost"))
              .when((ratio < lp.min_ratio) | (ratio > lp.max_ratio),
                    F.concat(F.lit("ratio "), F.format_number(rnd(ratio, 2), 2), F.lit(" outside permitted range"))))
    return df.select("*", reason.isNull().alias("is_valid"), reason.alias("reject_reason"), ratio.alias("cost_ratio"))


def fold_ratios(checked: DataFrame, lp: LearningParams = DEFAULT_LEARN, order: list[Column] | None = None) -> DataFrame:
    """L2/L3: (strategy_type, n, shift): the affine map mu -> (1-a)^n mu + shift of all valid ratios in order."""
    order = order or [F.col("evaluation_date"), F.col("outcome_id")]
    keep = F.lit(1.0 - lp.alpha)
    valid = checked.filter(F.col("is_valid")).select("strategy_type", "cost_ratio", F.struct(*order).alias("_at"))
    piece = valid.repartitionByRange("strategy_type", "_at").withColumn("_piece", F.spark_partition_id())
    w = Window.partitionBy("strategy_type", "_piece").orderBy(F.col("_at").desc())
    maps = (piece.withColumn("_after", F.row_number().over(w) - 1).groupBy("strategy_type", "_piece")
            .agg(F.count(F.lit(1)).alias("_m"), F.max("_at").alias("_end"),
                 F.sum(F.col("cost_ratio") * lp.alpha * F.pow(keep, F.col("_after"))).alias("_shift")))
    later = Window.partitionBy("strategy_type").orderBy("_end").rowsBetween(1, Window.unboundedFollowing)
    maps = maps.withColumn("_rest", F.coalesce(F.sum("_m").over(later), F.lit(0)))
    return maps.groupBy("strategy_type").agg(
        F.sum("_m").alias("n"), F.sum(F.col("_shift") * F.pow(keep, F.col("_rest"))).alias("shift"))


def ewma_by_strategy(checked: DataFrame, lp: LearningParams = DEFAULT_LEARN,
                     order: list[Column] | None = None) -> DataFrame:
    """Per strategy the clamped EWMA of all valid ratios in (evaluation_date, outcome_id) order."""
    x = fold_ratios(checked, lp, order).withColumnRenamed("n", "n_observations")
    mu = F.pow(F.lit(1.0 - lp.alpha), F.col("n_observations")) * lp.initial + F.col("shift")
    clamped = F.least(F.greatest(mu, F.lit(lp.lower)), F.lit(lp.upper))
    enough = F.col("n_observations") >= lp.min_observations
    m = F.when(enough, rnd(clamped, 4)).otherwise(F.lit(1.0))
    return x.select(
        "strategy_type", "n_observations",
        m.alias("multiplier"),
        (enough & ((mu < lp.lower) | (mu > lp.upper))).alias("was_clamped"),
        rnd(m, 2).alias("multiplier_applied"),
        F.when(enough, rnd_signed(m - 1.0, 4)).otherwise(F.lit(0.0)).alias("weight_adjustment"))


def feedback_rows(outcomes: DataFrame, mult: DataFrame, existing: DataFrame | None = None,
                  lp: LearningParams = DEFAULT_LEARN) -> DataFrame:
    """One feedback row per outcome (rejected rows kept with a marker); outcomes that
    already have feedback are skipped."""
    x = outcomes
    if existing is not None:
        x = x.join(existing.select("outcome_id"), "outcome_id", "left_anti")
    x = x.join(mult.select("strategy_type", "n_observations", "multiplier", "was_clamped",
                           "weight_adjustment"), "strategy_type", "left")
    n = F.coalesce(F.col("n_observations"), F.lit(0))
    enough = n >= lp.min_observations
    return x.select(
        "outcome_id", "strategy_type", "evaluation_date",
        rnd_signed(F.col("actual_cost") - F.col("estimated_cost"), 2).alias("cost_error"),
        rnd_signed((F.col("actual_delay_days") - F.col("estimated_delay_days")).cast("double"), 2).alias("delay_error"),
        rnd_signed(F.col("actual_risk") - F.col("estimated_risk"), 4).alias("risk_error"),
        F.when(F.col("is_valid") & enough, F.col("weight_adjustment")).otherwise(F.lit(0.0)).alias("weight_adjustment"),
        F.when(~F.col("is_valid"), "REJECTED").when(enough, "LEARNED").otherwise("BASELINE").alias("signal"),
        "reject_reason",
        F.when(F.col("is_valid"), F.when(enough, rnd(F.col("multiplier"), 2)).otherwise(F.lit(1.0))).alias("multiplier_applied"),
        n.alias("n_observations"), (enough & F.coalesce("was_clamped", F.lit(False))).alias("was_clamped"))


def active_multipliers(feedback: DataFrame) -> DataFrame:
    """Multiplier of the newest signal per strategy that was not rejected."""
    ok = feedback.filter(F.col("signal") != "REJECTED")
    return ok.groupBy("strategy_type").agg(
        F.max_by("multiplier_applied", F.struct("evaluation_date", "outcome_id")).alias("multiplier_applied"))


def strategy_metrics(feedback: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per strategy n, mean cost error, mean delay error, latest cost ratio (3 dp)."""
    x = feedback.join(outcomes.select("outcome_id", "actual_cost", "estimated_cost"), "outcome_id")
    ratio = F.when(F.col("estimated_cost") > 0, F.col("actual_cost") / F.col("estimated_cost"))
    return x.groupBy("strategy_type").agg(
        F.count(F.lit(1)).alias("n_feedback"),
        rnd_signed(F.avg("cost_error"), 2).alias("mean_cost_error"),
        rnd_signed(F.avg("delay_error"), 2).alias("mean_delay_error"),
        rnd(F.max_by(ratio, F.struct("evaluation_date", "outcome_id")), 3).alias("latest_cost_ratio"))


def ewma_from_state(state: DataFrame, lp: LearningParams = DEFAULT_LEARN) -> DataFrame:
    """Multiplier table (as ``ewma_by_strategy``) from streaming state rows (strategy_type, mu_raw, n)."""
    mu = F.col("mu_raw")
    enough = F.col("n") >= lp.min_observations
    m = F.when(enough, rnd(F.least(F.greatest(mu, F.lit(lp.lower)), F.lit(lp.upper)), 4)).otherwise(F.lit(1.0))
    return state.select(
        "strategy_type", F.col("n").alias("n_observations"), m.alias("multiplier"),
        (enough & ((mu < lp.lower) | (mu > lp.upper))).alias("was_clamped"), rnd(m, 2).alias("multiplier_applied"),
        F.when(enough, rnd_signed(m - 1.0, 4)).otherwise(F.lit(0.0)).alias("weight_adjustment"))
