"""Risk scoring and alerting (R1-R22) as native column expressions.

The scores are piecewise-linear ``when`` chains; the composite renormalises
over the dimensions that are present; reasons are built with ``array_compact``
in a fixed rule order.  One narrow projection after the F15 window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip01, rnd
from ..params import DEFAULT_RISK, RiskParams
from .allocation import end_stage
from .relational import id_keys

LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")

def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# ---- R1, R2, M11 ------------------------------------------------------------
def delay_risk_score(p) -> Column:
    return rnd(clip01(_c(p)), 4)


def predicted_delayed(p, rp: RiskParams = DEFAULT_RISK) -> Column:
    return _c(p) >= rp.classification_threshold


def probability_band(p, rp: RiskParams = DEFAULT_RISK) -> Column:
    p = _c(p)
    return (F.when(p < rp.prob_medium, "LOW").when(p < rp.prob_high, "MEDIUM")
            .when(p < rp.prob_critical, "HIGH").otherwise("CRITICAL"))


def probability_valid(p) -> Column:
    """Numeric, finite and within [0, 1]."""
    p = _c(p)
    return p.isNotNull() & ~F.isnan(p) & (p >= 0) & (p <= 1)


# ---- R3 ---------------------------------------------------------------------
def supplier_risk(reliability, past_rate) -> Column:
    rel, rate = _c(reliability), _c(past_rate)
    base = F.lit(1.0) - rel
    mixed = F.when(rate.isNull() | F.isnan(rate), base).otherwise(base * 0.70 + rate * 0.30)
    return rnd(clip01(mixed), 4)


def supplier_inputs_valid(reliability, past_rate) -> Column:
    rel, rate = _c(reliability), _c(past_rate)
    return (rel.isNotNull() & (rel >= 0) & (rel <= 1)
            & (rate.isNull() | ((rate >= 0) & (rate <= 1))))


# ---- R4 ---------------------------------------------------------------------
def coverage_from_units(inventory, demand) -> Column:
    d = _c(demand)
    return F.when(d == 0, F.lit(999.0)).otherwise(_c(inventory) / d)


def inventory_risk(coverage, rp: RiskParams = DEFAULT_RISK) -> Column:
    c = _c(coverage)
    crit, low = rp.critical_coverage, rp.low_coverage
    risk = (F.when(c <= 0, F.lit(1.0))
            .when(c < crit, F.lit(0.80) + F.lit(0.20) * (F.lit(1.0) - c / crit))
            .when(c < low, F.lit(0.40) + F.lit(0.40) * (F.lit(1.0) - (c - crit) / (low - crit)))
            .otherwise(F.lit(0.40) * (F.lit(1.0) - F.least(F.lit(1.0), (c - low) / 1.0))))
    return rnd(clip01(risk), 4)


# ---- R5 ---------------------------------------------------------------------
def _utilization(demand, capacity) -> Column:
    cap = _c(capacity).cast("double")
    return _c(demand).cast("double") / F.when(cap == 0, F.lit(None)).otherwise(cap)


def capacity_risk(demand, capacity, rp: RiskParams = DEFAULT_RISK, utilization=None) -> Column:
    """``utilization`` names the column that holds demand / capacity already, which keeps the generated code short."""
    d, cap = _c(demand).cast("double"), _c(capacity).cast("double")
    u = _utilization(demand, capacity) if utilization is None else _c(utilization)
    mod, high, crit = rp.moderate_utilization, rp.high_utilization, rp.critical_utilization
    banded = (F.when(u >= crit, F.lit(0.85) + F.lit(0.15) * F.least(F.lit(1.0), (u - crit) / 0.50))
              .when(u >= high, F.lit(0.60) + F.lit(0.25) * ((u - high) / (crit - high)))
              .when(u >= mod, F.lit(0.30) + F.lit(0.30) * ((u - mod) / (high - mod)))
              .otherwise(F.lit(0.30) * (u / mod)))
    return (F.when(cap == 0, F.when(d > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise(rnd(clip01(banded), 4)))


# ---- R6 ---------------------------------------------------------------------
def _tier(criticality) -> Column:
    return F.upper(F.trim(_c(criticality)))


def _service_weight(tier: Column, rp: RiskParams) -> Column:
    weight = F.lit(None).cast("double")
    for name, w in reversed(rp.criticality_weights):
        weight = F.when(tier == name, F.lit(w)).otherwise(weight)
    return weight


def service_risk(criticality, coverage, shortage_flag, rp: RiskParams = DEFAULT_RISK, weight=None) -> Column:
    """``weight`` names the column that holds the weight of the criticality already."""
    weight = _service_weight(_tier(criticality), rp) if weight is None else _c(weight)
    c, s = _c(coverage), _c(shortage_flag)
    exposure = (F.when(c.isNotNull(),
                       F.when((c < 0.50) | ((s == 1) & (c < 1.0)), F.lit(1.0))
                       .when(c < 1.0, F.lit(0.80)).otherwise(F.lit(0.40)))
                .when(s.isNotNull(), F.when(s == 1, F.lit(1.0)).otherwise(F.lit(0.40)))
                .otherwise(F.lit(0.70)))
    # unknown tier -> no service score (``greatest`` in the clip would turn null into 0)
    return F.when(weight.isNotNull(), rnd(clip01(weight * exposure), 4))


# ---- R7, R8 -----------------------------------------------------------------
def composite_score(delay, supplier, inventory, capacity, service, rp: RiskParams = DEFAULT_RISK) -> Column:
    """Weighted mean over available dimensions (renormalised); null if none are present."""
    dims = [(_c(delay), rp.delay_weight), (_c(supplier), rp.supplier_weight),
            (_c(inventory), rp.inventory_weight), (_c(capacity), rp.capacity_weight),
            (_c(service), rp.service_weight)]
    num = None
    den = None
    for s, w in dims:
        term = F.when(s.isNotNull(), s * w).otherwise(F.lit(0.0))
        wt = F.when(s.isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
        num = term if num is None else num + term
        den = wt if den is None else den + wt
    return rnd(clip01(num / F.when(den > 0, den)), 4)


def unavailable_dimensions(delay, supplier, inventory, capacity, service) -> Column:
    names = ("delay", "supplier", "inventory", "capacity", "service")
    cols = (delay, supplier, inventory, capacity, service)
    return F.array_compact(F.array(*[F.when(_c(c).isNull(), F.lit(n)) for n, c in zip(names, cols)]))


def risk_level(score, rp: RiskParams = DEFAULT_RISK) -> Column:
    s = clip01(_c(score))
    return (F.when(s >= rp.level_critical, "CRITICAL").when(s >= rp.level_high, "HIGH")
            .when(s >= rp.level_medium, "MEDIUM").otherwise("LOW"))


# ---- R9, R10 ----------------------------------------------------------------
def reason_fields(p, reliability, past_rate, coverage, shortage_flag, utilization, criticality,
                  rp: RiskParams = DEFAULT_RISK) -> Column:
    """Array of (code, measure, observed, threshold) structs; the order of the rules is fixed."""
    p, rel, rate, cov, s, u = map(_c, (p, reliability, past_rate, coverage, shortage_flag, utilization))
    exposed = (cov < rp.low_coverage) | (s == 1)
    rules = [
        ("CRITICAL_DELAY_PROBABILITY", "delay_probability", p, rp.prob_critical, p >= rp.prob_critical),
        ("HIGH_DELAY_PROBABILITY", "delay_probability", p, rp.prob_high, (p < rp.prob_critical) & (p >= rp.prob_high)),
        ("CRITICAL_SUPPLIER_RELIABILITY", "supplier_reliability", rel, rp.critical_reliability, rel < rp.critical_reliability),
        ("LOW_SUPPLIER_RELIABILITY", "supplier_reliability", rel, rp.low_reliability,
         (rel >= rp.critical_reliability) & (rel < rp.low_reliability)),
        ("HIGH_HISTORICAL_SUPPLIER_DELAYS", "past_delay_rate", rate, rp.high_past_delay_rate, rate >= rp.high_past_delay_rate),
        ("CRITICAL_INVENTORY_SHORTAGE", "inventory_coverage", cov, rp.critical_coverage, cov < rp.critical_coverage),
        ("LOW_INVENTORY_COVERAGE", "inventory_coverage", cov, rp.low_coverage,
         (cov >= rp.critical_coverage) & (cov < rp.low_coverage)),
        ("INVENTORY_SHORTAGE", "shortage_flag", s, 1.0, (s == 1) & ~F.coalesce(cov < rp.critical_coverage, F.lit(False))),
        ("CRITICAL_CAPACITY_UTILIZATION", "capacity_utilization", u, rp.critical_utilization, u >= rp.critical_utilization),
        ("HIGH_CAPACITY_UTILIZATION", "capacity_utilization", u, rp.high_utilization,
         (u >= rp.high_utilization) & (u < rp.critical_utilization)),
        ("CRITICAL_PRODUCT_EXPOSURE", "inventory_coverage", cov, rp.low_coverage,
         F.upper(_c(criticality)).isin("CRITICAL", "HIGH") & F.coalesce(exposed, F.lit(False))),
    ]
    return F.array_compact(F.array(*[
        F.when(met, F.struct(F.lit(code).alias("code"), F.lit(measure).alias("measure"),
                             value.cast("double").alias("observed"), F.lit(float(limit)).alias("threshold")))
        for code, measure, value, limit, met in rules]))


def describe(reason: Column) -> Column:
    """One pattern for every reason: ``measure=observed (threshold)``; a missing value is ``n/a``."""
    value = F.coalesce(F.format_number(reason["observed"], 4), F.lit("n/a"))
    return F.concat(reason["measure"], F.lit("="), value, F.lit(" ("), F.format_number(reason["threshold"], 2), F.lit(")"))


# ---- R11: full assessment ---------------------------------------------------
def assess(df: DataFrame, rp: RiskParams = DEFAULT_RISK, keep_inputs: bool = False) -> DataFrame:
    """Score every row.  Expects ``delay_probability``, ``supplier_reliability``,
    ``historical_delay_rate`` and whatever of coverage / units / capacity /
    criticality / shortage flag is present (missing ones are derived or null)."""
    produced = {"delay_risk_score", "predicted_delay", "supplier_risk_score", "inventory_risk_score",
                "capacity_risk_score", "service_risk_score", "composite_risk_score", "unavailable_dimensions",
                "is_valid", "risk_level", "risk_reasons", "risk_reason_fields", "risk_reason_descriptions"}
    df = df.drop(*[c for c in df.columns if c in produced])
    cols = set(df.columns)

    def opt(name, default=None):
        return F.col(name) if name in cols else F.lit(default)

    cov = (F.coalesce(opt("inventory_coverage_ratio").cast("double"),
                      coverage_from_units(opt("inventory_units"), opt("demand_units")))
           if "inventory_coverage_ratio" in cols else coverage_from_units(opt("inventory_units"), opt("demand_units")))
    demand, given = opt("demand_units").cast("double"), opt("capacity_utilization").cast("double")
    # what is absent is derived from what is there, else stays absent
    units = F.coalesce(opt("supplier_capacity_units").cast("double"), F.when((demand != 0) & (given != 0), demand / given))
    cap_units = F.coalesce(units, F.lit(0.0))
    util = F.coalesce(given, F.when((demand != 0) & (cap_units != 0), F.when(cap_units > 0, demand / cap_units).otherwise(1.0)))
    shortage = opt("shortage_flag").cast("int")
    # what several rules read becomes a column first: generated methods over 8 KB are interpreted, row by row
    staged = df.select(
        "*",
        cov.alias("_cov"), shortage.alias("_short"), util.alias("_util"), cap_units.alias("_cap"),
        F.coalesce(demand, F.lit(0.0)).alias("_demand"), _tier(opt("criticality_level")).alias("_tier"),
    ).select(
        "*", _utilization("_demand", "_cap").alias("_u"), _service_weight(F.col("_tier"), rp).alias("_weight"),
    ).select(
        "*",
        delay_risk_score("delay_probability").alias("delay_risk_score"),
        predicted_delayed("delay_probability", rp).alias("predicted_delay"),
        supplier_risk("supplier_reliability", "historical_delay_rate").alias("supplier_risk_score"),
        inventory_risk("_cov", rp).alias("inventory_risk_score"),
        capacity_risk("_demand", "_cap", rp, utilization="_u").alias("capacity_risk_score"),
        service_risk(opt("criticality_level"), "_cov", "_short", rp, weight="_weight").alias("service_risk_score"),
    )
    scored = staged.select(
        "*",
        composite_score("delay_risk_score", "supplier_risk_score", "inventory_risk_score",
                        "capacity_risk_score", "service_risk_score", rp).alias("composite_risk_score"),
        unavailable_dimensions("delay_risk_score", "supplier_risk_score", "inventory_risk_score",
                               "capacity_risk_score", "service_risk_score").alias("unavailable_dimensions"),
        reason_fields("delay_probability", "supplier_reliability", "historical_delay_rate", "_cov", "_short",
                      "_util", opt("criticality_level"), rp).alias("risk_reason_fields"),
        (probability_valid("delay_probability")
         & supplier_inputs_valid("supplier_reliability", "historical_delay_rate")
         & (F.col("_cov").isNull() | (F.col("_cov") >= 0))).alias("is_valid"),
    )
    if rp.missing_dimension_policy == "require_all":
        scored = scored.withColumn("is_valid", F.col("is_valid") & (F.size("unavailable_dimensions") == 0))
    out = scored.select(
        "*",
        risk_level("composite_risk_score", rp).alias("risk_level"),
        F.transform("risk_reason_fields", lambda r: r["code"]).alias("risk_reasons"),
        F.transform("risk_reason_fields", describe).alias("risk_reason_descriptions"),
    ).drop("_cov", "_short", "_util", "_cap", "_demand", "_tier", "_weight", "_u")
    return out


def service_path(events: DataFrame, stock: DataFrame, past_rate: float | None = None,
                 no_reason: str = "no reason met", rp: RiskParams = DEFAULT_RISK) -> DataFrame:
    """Assessment of the service path.  ``stock`` (event_id, latest_available_units) replaces the
    event's own inventory; no shortage flag is passed, so exposure follows coverage alone.  ``past_rate``
    replaces ``historical_delay_rate`` by one constant (the service's own is 0.15).  ``stored_reasons`` joins
    the reason descriptions, or holds ``no_reason`` where none is met."""
    x = events.drop("inventory_coverage_ratio", "shortage_flag", "inventory_units").join(stock, id_keys(events, stock), "left")
    x = x.withColumn("inventory_units", F.greatest(F.coalesce("latest_available_units", F.lit(0)), F.lit(0)))
    if past_rate is not None:
        x = x.withColumn("historical_delay_rate", F.lit(float(past_rate)))
    out = assess(x, rp)
    return out.withColumn("stored_reasons", F.when(F.size("risk_reason_descriptions") > 0,
                                                   F.array_join("risk_reason_descriptions", "; "))
                          .otherwise(F.lit(no_reason)))


def split_valid(assessed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scored rows and rejected rows (counted, not fatal)."""
    return assessed.filter(F.col("is_valid")), assessed.filter(~F.col("is_valid"))


# ---- R12-R14: alerts ---------------------------------------------------------
def alerts(assessed: DataFrame, rp: RiskParams = DEFAULT_RISK, include_monitoring: bool = False,
           keep: tuple[str, ...] = ()) -> DataFrame:
    """Alerts as fields (severity, type, score, limit, reason codes) with the ``keep`` columns passed through;
    ``alert_message`` lists the same fields in one pattern for every severity."""
    # a filter on the severity stays above this point: moved below the scoring, it would repeat all of it in every use
    held = assessed.select("event_id", "composite_risk_score", "risk_reasons", *keep,
                           F.struct("risk_level", "composite_risk_score").alias("_judged"))
    held = end_stage(held, "_judged")
    level, score = F.col("_judged.risk_level"), F.col("_judged.composite_risk_score")
    severity = (F.when((level == "CRITICAL") | (score >= rp.alert_critical), "CRITICAL")
                .when((level == "HIGH") | (score >= rp.alert_high), "HIGH")
                .when(level == "MEDIUM", "MEDIUM"))
    kind = (F.when(severity == "CRITICAL", "PRIORITY_DISRUPTION_ALERT").when(severity == "HIGH", "WARNING_DISRUPTION_ALERT")
            .when(severity == "MEDIUM", "MONITORING_NOTICE"))
    limit = (F.when(severity == "CRITICAL", rp.alert_critical).when(severity == "HIGH", rp.alert_high)
             .otherwise(rp.level_medium))
    message = F.concat_ws(" | ", F.col("event_id"), severity, F.concat(F.lit("score="), F.format_number(score, 4)),
                          F.concat(F.lit("limit="), F.format_number(limit, 2)), F.array_join("risk_reasons", ","))
    out = held.select("event_id", "composite_risk_score", "risk_reasons", severity.alias("severity"), kind.alias("alert_type"),
                          limit.alias("alert_limit"), message.alias("alert_message"), *keep)
    wanted = F.col("severity").isNotNull() if include_monitoring else F.col("severity").isin("CRITICAL", "HIGH")
    return out.filter(wanted)


def dedup_alerts(new_alerts: DataFrame, history: DataFrame | None = None, order_col: str | None = None) -> DataFrame:
    """Keep the first alert per (event_id, alert_type) and drop keys already in history."""
    keys = ["event_id", "alert_type"]
    if history is not None:
        new_alerts = new_alerts.join(history.select(*keys), keys, "left_anti")
    order = F.col(order_col) if order_col else F.col("alert_message")
    w = Window.partitionBy(*keys).orderBy(order)
    return new_alerts.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def alert_counts(alerts_df: DataFrame) -> DataFrame:
    """Counts per severity, zero-filled to all four levels (fixed 4-row table)."""
    spark = alerts_df.sparkSession
    levels = spark.createDataFrame([(lv,) for lv in LEVELS], "severity string")
    counts = alerts_df.groupBy("severity").agg(F.count(F.lit(1)).alias("n_alerts"))
    return (F.broadcast(levels).join(counts, "severity", "left")
            .select("severity", F.coalesce("n_alerts", F.lit(0)).cast("long").alias("n_alerts")))
