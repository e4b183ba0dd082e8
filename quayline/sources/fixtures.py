"""Adapter: reference-shaped tables derived from the driver's parquet tables.

All derivations are integer arithmetic or plain double division so that the
oracle SQL in :mod:`quayline.sources.fixtures_sql` computes bit-identical values.

Joins: ``lineitem`` to ``part`` and ``supplier`` are left to Catalyst/AQE (their
sizes grow with the data); ``nation`` is a fixed 25-row table and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

STRATEGIES = ("AIR_FREIGHT", "SECONDARY_SUPPLIER", "DELAY_LAUNCH", "PRIMARY_SUPPLIER")


def _d(x: float) -> F.Column:
    return F.lit(float(x))


def _base_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"])
    return li


def supply_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES 3.1: one supply event per line item."""
    li = _base_lines(spark, sf_dir)
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_type", "p_size", "p_retailprice"])
    sup = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    nation = F.broadcast(read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"]))
    j = (li.join(part, li.l_partkey == part.p_partkey)
         .join(sup, li.l_suppkey == sup.s_suppkey)
         .join(nation, F.col("s_nationkey") == nation.n_nationkey))
    qty = F.col("l_quantity").cast("long")
    rel_pct = F.lit(60) + (F.col("l_suppkey") * 37) % 40
    demand = qty * 20
    inventory = (F.col("l_partkey") * 131 + F.col("l_orderkey") * 17) % 2001
    capacity = F.lit(300) + (F.col("l_suppkey") * 97 + F.col("l_partkey") * 31) % 1201
    planned = F.lit(2) + F.col("l_suppkey") % 15
    draw = (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_linenumber") * 31) % 100
    delayed = F.when(draw < F.lit(2) + (F.lit(100) - rel_pct) / 2 + demand * 10 / capacity, 1).otherwise(0)
    base = j.select(
        F.concat_ws("_", F.lit("EVT"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                    qty.cast("string")).alias("event_id"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("s_name").alias("supplier_name"),
        F.col("n_name").alias("supplier_country"),
        (rel_pct / 100).alias("supplier_reliability"),
        F.col("p_brand").alias("product_id"),
        F.col("p_type").alias("category"),
        F.col("l_partkey").alias("part_key"),
        demand.alias("demand_units"),
        inventory.alias("inventory_units"),
        capacity.alias("supplier_capacity_units"),
        planned.alias("planned_lead_time_days"),
        delayed.alias("delay_occurred"),
        (delayed * (F.lit(1) + F.col("l_orderkey") % 15)).alias("delay_days"),
        (F.col("p_retailprice") / 10).alias("unit_cost_usd"),
        (F.lit(500) + F.col("l_extendedprice") / 20).alias("transport_cost_usd"),
        (_d(5) / 100 + F.col("l_discount")).alias("secondary_supplier_premium_pct"),
        F.when(F.col("p_size") % 5 == 1, "LOW").when(F.col("p_size") % 5 == 2, "MEDIUM")
         .when(F.col("p_size") % 5 == 3, "HIGH").when(F.col("p_size") % 5 == 4, "CRITICAL")
         .alias("criticality_level"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
    )
    ev = base.select(
        "*",
        (F.col("planned_lead_time_days") + F.col("delay_days")).alias("actual_lead_time_days"),
        (F.col("inventory_units") / F.col("demand_units")).alias("inventory_demand_ratio"),
        (F.col("demand_units") * F.col("unit_cost_usd") + F.col("transport_cost_usd")).alias("estimated_primary_cost_usd"),
        (F.col("demand_units") * F.col("unit_cost_usd") * (F.lit(1) + F.col("secondary_supplier_premium_pct"))
         + F.col("transport_cost_usd") * (F.lit(1) + F.col("secondary_supplier_premium_pct") / 2)
         ).alias("estimated_secondary_cost_usd"),
        F.when(F.col("order_key") % 4 == 0, _d(0))
         .otherwise(F.col("transport_cost_usd") * 3 + F.col("demand_units") * 3 / 2).alias("air_freight_cost_usd"),
    )
    ratio = F.col("inventory_demand_ratio")
    return ev.withColumn(
        "service_risk",
        F.when((F.col("delay_occurred") == 1) | (ratio < _d(70) / 100), "High")
         .when((ratio < _d(1)) | (F.col("supplier_reliability") < _d(93) / 100), "Medium")
         .otherwise("Low"))


def _line_sample(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    raw = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"]
    return _base_lines(spark, sf_dir).select(*raw).orderBy(F.xxhash64(*raw), *raw).limit(n)


def event_key_sample(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Supplier, date and id of ``n`` line items, chosen by a hash of their keys before any text is built.  The joins of
    ``supply_events`` are left out, so lines of unknown parts stay in: it only shows where the rows lie."""
    return _line_sample(spark, sf_dir, n).select(
        F.concat_ws("_", F.lit("EVT"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                    F.col("l_quantity").cast("long").cast("string")).alias("event_id"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_suppkey").alias("supplier_id"))


def part_date_sample(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Part and date of the line items of ``event_key_sample``."""
    return _line_sample(spark, sf_dir, n).select(F.col("l_partkey").alias("part_key"), F.to_date("l_shipdate").alias("date"))


def delay_probability_expr() -> F.Column:
    """FIXTURES 3.2 fixture score from pre-event columns only."""
    util = F.col("demand_units") / F.col("supplier_capacity_units")
    return F.least(_d(99) / 100,
                   _d(2) / 100 + (F.lit(1) - F.col("supplier_reliability")) * 5 / 4 + F.least(util, _d(2)) / 5)


def predictions(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """FIXTURES 3.2: the current prediction per event plus an older one for a third of the orders."""
    ev = events if events is not None else supply_events(spark, sf_dir)
    # both versions come from one pass over the events
    version = F.array(F.lit(2), F.lit(1))
    one = ev.select("event_id", "order_key", "planned_lead_time_days", F.col("date").alias("_on"), delay_probability_expr().alias("_p"),
                    F.explode(F.when(F.col("order_key") % 3 == 0, version).otherwise(F.array(F.lit(2)))).alias("version"))
    old = F.col("version") == 1
    both = one.select("event_id", "planned_lead_time_days", "version",
                      F.when(old, F.date_sub("_on", 7)).otherwise(F.col("_on")).alias("created_on"),
                      F.when(old, F.col("_p") / 2).otherwise(F.col("_p")).alias("delay_probability"))
    return both.select(
        F.concat_ws("_", F.lit("PRD"), F.col("event_id"), F.col("version").cast("string")).alias("prediction_id"),
        "event_id", "version", "created_on", "delay_probability",
        F.when(F.col("delay_probability") >= _d(65) / 100, F.col("planned_lead_time_days"))
         .otherwise(F.lit(0).cast("long")).alias("predicted_delay_days"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES 3.3: one inventory snapshot per line item."""
    li = _base_lines(spark, sf_dir)
    qty = F.col("l_quantity").cast("long")
    inv = (F.col("l_partkey") * 131 + F.col("l_orderkey") * 17) % 2001
    return li.select(
        F.concat_ws("_", F.lit("EVT"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                    qty.cast("string")).alias("inventory_id"),
        F.col("l_partkey").alias("product_id"),
        F.concat(F.lit("WH-"), F.col("l_linenumber").cast("string")).alias("warehouse_code"),
        F.to_date("l_shipdate").alias("inventory_date"),
        inv.alias("inventory_units"),
        (qty * 10).alias("reserved_units"),
        (inv - qty * 10).alias("available_units"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES 3.4: decision, recommendation and outcome attributes per line item."""
    li = _base_lines(spark, sf_dir)
    qty = F.col("l_quantity").cast("long")
    strat = (F.when(F.col("l_linenumber") % 4 == 0, STRATEGIES[0])
             .when(F.col("l_linenumber") % 4 == 1, STRATEGIES[1])
             .when(F.col("l_linenumber") % 4 == 2, STRATEGIES[2])
             .otherwise(STRATEGIES[3]))
    planned = F.lit(2) + F.col("l_suppkey") % 15
    est_delay = (F.when(F.col("l_linenumber") % 4 == 0, F.lit(2).cast("long"))
                 .when(F.col("l_linenumber") % 4 == 1, F.lit(7).cast("long"))
                 .otherwise(planned))
    est_risk = (F.when(F.col("l_linenumber") % 4 == 0, _d(8) / 100)
                .when(F.col("l_linenumber") % 4 == 1, _d(15) / 100)
                .when(F.col("l_linenumber") % 4 == 2, _d(35) / 100)
                .otherwise(_d(25) / 100))
    surge = F.when(F.col("l_orderkey") % 50 == 0, F.lit(4)).otherwise(F.lit(1))
    actual_cost = (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount")) * (F.lit(1) + F.col("l_tax"))
                   * surge * (F.lit(9) + F.col("l_partkey") % 5) / 10)
    status = (F.when(F.col("l_returnflag") == "R", "OVERRIDDEN")
              .when((F.col("l_returnflag") == "N") & (F.col("l_orderkey") % 10 == 0), "CANCELLED")
              .otherwise("APPROVED"))
    return li.select(
        F.concat_ws("_", F.lit("EVT"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                    qty.cast("string")).alias("outcome_id"),
        strat.alias("strategy_type"),
        F.col("l_extendedprice").alias("estimated_cost"),
        actual_cost.alias("actual_cost"),
        est_delay.alias("estimated_delay_days"),
        F.greatest(F.lit(0).cast("long"), est_delay + F.col("l_orderkey") % 9 - 2).alias("actual_delay_days"),
        (_d(95) / 100).alias("estimated_service_level"),
        ((F.lit(75) + F.col("l_partkey") % 26) / 100).alias("actual_service_level"),
        est_risk.alias("estimated_risk"),
        (est_risk + (F.col("l_orderkey") % 7 - 3) / 100).alias("actual_risk"),
        status.alias("decision_status"),
        F.when(F.col("l_linestatus") == "F", "COMPLETED").otherwise("IN_PROGRESS").alias("execution_status"),
        F.to_date("l_shipdate").alias("evaluation_date"),
        F.col("l_orderkey").alias("order_key"),
    )


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES 3.5: nulls in inventory and category plus exact copies; ``ordinal`` orders survivors."""
    ev = supply_events(spark, sf_dir)
    ev = ev.select(
        *[c for c in ev.columns if c not in ("inventory_units", "category")],
        F.when(F.col("order_key") % 97 == 0, F.lit(None).cast("long")).otherwise(F.col("inventory_units")).alias("inventory_units"),
        F.when(F.col("part_key") % 89 == 0, F.lit(None).cast("string")).otherwise(F.col("category")).alias("category"),
    )
    copies = ev.filter(F.col("order_key") % 101 == 0).withColumn("copy_no", F.lit(1))
    return ev.withColumn("copy_no", F.lit(0)).unionByName(copies)


LIFECYCLE_MAP = (("click", "APPROVED", "decision"), ("signup", "REJECTED", "decision"),
                 ("view", "IN_PROGRESS", "execution"), ("purchase", "COMPLETED", "execution"),
                 ("error", "FAILED", "execution"))


def lifecycle_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES 3.6: decision lifecycle requests from ``events``."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"])
    target = F.lit(None).cast("string")
    kind = F.lit(None).cast("string")
    for et, st, k in LIFECYCLE_MAP:
        target = F.when(F.col("event_type") == et, F.lit(st)).otherwise(target)
        kind = F.when(F.col("event_type") == et, F.lit(k)).otherwise(kind)
    return ev.select(
        F.col("user_id").alias("decision_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("request_id"),
        kind.alias("kind"),
        target.alias("target_status"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier dimension with capacity and reliability derived like the events."""
    sup = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    nation = F.broadcast(read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"]))
    return sup.join(nation, sup.s_nationkey == nation.n_nationkey).select(
        F.col("s_suppkey").alias("supplier_id"),
        F.col("s_name").alias("supplier_name"),
        F.col("n_name").alias("country"),
        ((F.lit(60) + (F.col("s_suppkey") * 37) % 40) / 100).alias("reliability_score"),
        (F.lit(300) + (F.col("s_suppkey") * 97) % 1201).alias("supplier_capacity_units"),
        (F.lit(2) + F.col("s_suppkey") % 15).alias("average_lead_time_days"))
