"""Descriptive analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rnd, rnd_signed
from ..operators import analytics as A
from ..operators import features
from ..sources import fixtures
from ..sources.fixtures_sql import with_ctes
from . import sqlbase as S
from .registry import register

R, RS = S.R, S.RS
SE = with_ctes("supply_events")


def ev(spark, sf_dir):
    return fixtures.supply_events(spark, sf_dir)


@register("ana_describe", SE + " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, count({c}) AS n,
  CAST((2 * sum(CAST(round(CAST({c} AS DOUBLE) * 1e6) AS HUGEINT)) + count({c})) // (2 * count({c})) AS DOUBLE) / 1e6 AS mean,
  {R(f'stddev_samp(CAST({c} AS DOUBLE))', 6)} AS std, CAST(min({c}) AS DOUBLE) AS min_value,
  {RS(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)', 6)} AS q1, {RS(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)', 6)} AS median,
  {RS(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)', 6)} AS q3, CAST(max({c}) AS DOUBLE) AS max_value,
  {RS(f'quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25)', 6)} AS iqr
FROM supply_events""" for c in A.DESCRIBE_COLUMNS))
def ana_describe(spark, sf_dir):
    """A1: describe 12 columns."""
    return A.describe(ev(spark, sf_dir))


@register("ana_cardinality", SE + """
SELECT count(DISTINCT supplier_id) AS n_suppliers, count(DISTINCT product_id) AS n_products,
       count(DISTINCT category) AS n_categories, count(DISTINCT supplier_country) AS n_countries,
       array_to_string(list_sort(list(DISTINCT category)), ',') AS categories
FROM supply_events
""")
def ana_cardinality(spark, sf_dir):
    """A2: entity cardinalities and the sorted category list (bounded by the category count)."""
    e = ev(spark, sf_dir)
    cats = e.select("category").distinct().agg(F.array_join(F.sort_array(F.collect_list("category")), ",").alias("categories"))
    c = e.agg(F.count_distinct("supplier_id").alias("n_suppliers"), F.count_distinct("product_id").alias("n_products"),
              F.count_distinct("category").alias("n_categories"), F.count_distinct("supplier_country").alias("n_countries"))
    return c.crossJoin(cats)


def _hist_sql(expr, bins, name, where="true"):
    return f"""SELECT '{name}' AS histogram,
  CAST(CASE WHEN b.hi = b.lo THEN 0 ELSE least(floor(({expr} - b.lo) / (b.hi - b.lo) * {bins}), {bins - 1}) END AS INTEGER) AS bin,
  count(*) AS n
FROM (SELECT * FROM supply_events WHERE {where}) s,
     (SELECT min({expr}) AS lo, max({expr}) AS hi FROM supply_events WHERE {where}) b
GROUP BY 1, 2"""


_COV = f"{R('inventory_units / demand_units', 4)}"


@register("ana_histograms", SE + " UNION ALL ".join([
    _hist_sql("demand_units", 25, "demand"), _hist_sql(_COV, 20, "coverage"),
    _hist_sql("delay_days", 15, "delay_severity", "delay_days > 0")]))
def ana_histograms(spark, sf_dir):
    """A3: equal-width histograms of demand (25), coverage (20) and delay severity (15)."""
    e = features.inventory_features(ev(spark, sf_dir))
    return (A.equal_width_hist(e, "demand_units", 25, "demand")
            .unionByName(A.equal_width_hist(e, "inventory_coverage_ratio", 20, "coverage"))
            .unionByName(A.equal_width_hist(e.filter(F.col("delay_days") > 0), "delay_days", 15, "delay_severity")))


@register("ana_demand_by_product", SE + f"""
SELECT product_id, {R('avg(demand_units)', 4)} AS mean_demand, {R('stddev_samp(demand_units)', 4)} AS std_demand,
       count(*) AS n FROM supply_events GROUP BY product_id
""")
def ana_demand_by_product(spark, sf_dir):
    """A4: demand mean and std by product."""
    return ev(spark, sf_dir).groupBy("product_id").agg(
        rnd(F.avg("demand_units"), 4).alias("mean_demand"), rnd(F.stddev_samp("demand_units"), 4).alias("std_demand"),
        F.count(F.lit(1)).alias("n"))


@register("ana_daily_demand", SE + f"""
SELECT date, total, {R('avg(total) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 4)} AS trailing_mean
FROM (SELECT date, CAST(sum(demand_units) AS BIGINT) AS total FROM supply_events GROUP BY date) d
""")
def ana_daily_demand(spark, sf_dir):
    """A5: total demand per date and its trailing 7-row mean."""
    return A.trailing_daily(ev(spark, sf_dir), "date", "demand_units", 7)


def _five_sql(expr, by, name):
    qs = ((0.0, "min"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "max"))
    cols = ", ".join(f"{RS(f'quantile_cont({expr}, {p!r})', 6)} AS {n}" for p, n in qs)
    return f"SELECT '{name}' AS summary, CAST({by} AS VARCHAR) AS group_value, {cols} FROM supply_events GROUP BY {by}"


@register("ana_group_summaries", SE + " UNION ALL ".join([
    _five_sql(R('demand_units / supplier_capacity_units', 4), "product_id", "pressure_by_product"),
    _five_sql("CAST(actual_lead_time_days - planned_lead_time_days AS DOUBLE)", "product_id", "variance_by_product"),
    _five_sql("CAST(demand_units - inventory_units AS DOUBLE)", "service_risk", "gap_by_service_tier")]))
def ana_group_summaries(spark, sf_dir):
    """Five-number summaries by group."""
    e = features.lead_time_features(features.capacity_supplier_features(features.inventory_features(ev(spark, sf_dir))))
    parts = [("demand_pressure", "product_id", "pressure_by_product"),
             ("lead_time_variance_days", "product_id", "variance_by_product"),
             ("inventory_gap_units", "service_risk", "gap_by_service_tier")]
    out = None
    for col, by, name in parts:
        f = A.five_number(e, col, by).select(F.lit(name).alias("summary"), "*")
        out = f if out is None else out.unionByName(f)
    return out


@register("ana_shares", SE + f"""
SELECT {R('avg(CAST(demand_units / supplier_capacity_units > 0.85 AS INTEGER))', 6)} AS high_pressure_share,
       {R('avg(CAST(actual_lead_time_days > planned_lead_time_days AS INTEGER))', 6)} AS slipped_share,
       {R('avg(CAST(inventory_units / demand_units < 1 AS INTEGER))', 6)} AS low_coverage_share,
       {R('avg(CAST(inventory_units < demand_units AS INTEGER))', 6)} AS shortage_rate
FROM supply_events
""")
def ana_shares(spark, sf_dir):
    """Conditional shares."""
    e = ev(spark, sf_dir)
    c = F.col
    return e.agg(
        rnd(F.avg((c("demand_units") / c("supplier_capacity_units") > 0.85).cast("int")), 6).alias("high_pressure_share"),
        rnd(F.avg((c("actual_lead_time_days") > c("planned_lead_time_days")).cast("int")), 6).alias("slipped_share"),
        rnd(F.avg((c("inventory_units") / c("demand_units") < 1).cast("int")), 6).alias("low_coverage_share"),
        rnd(F.avg((c("inventory_units") < c("demand_units")).cast("int")), 6).alias("shortage_rate"))


_SCORE_SQL = f"""
SELECT supplier_id, supplier_name, supplier_country, count(*) AS n_orders, {R('avg(delay_occurred)', 6)} AS delay_rate,
  {R('avg(delay_days)', 4)} AS mean_delay_days, max(delay_days) AS max_delay_days,
  {R('avg(supplier_reliability)', 4)} AS mean_reliability, {R('avg(supplier_capacity_units)', 4)} AS mean_capacity,
  {R('avg(planned_lead_time_days)', 4)} AS mean_planned_lead_time, {R('avg(actual_lead_time_days)', 4)} AS mean_actual_lead_time,
  {R('avg(inventory_units / demand_units)', 4)} AS mean_coverage,
  {R('avg(unit_cost_usd)', 4)} AS mean_unit_cost
FROM supply_events GROUP BY supplier_id, supplier_name, supplier_country
"""


def _scorecard(e):
    c = F.col
    return e.groupBy("supplier_id", "supplier_name", "supplier_country").agg(
        F.count(F.lit(1)).alias("n_orders"), rnd(F.avg("delay_occurred"), 6).alias("delay_rate"),
        rnd(F.avg("delay_days"), 4).alias("mean_delay_days"), F.max("delay_days").alias("max_delay_days"),
        rnd(F.avg("supplier_reliability"), 4).alias("mean_reliability"),
        rnd(F.avg("supplier_capacity_units"), 4).alias("mean_capacity"),
        rnd(F.avg("planned_lead_time_days"), 4).alias("mean_planned_lead_time"),
        rnd(F.avg("actual_lead_time_days"), 4).alias("mean_actual_lead_time"),
        rnd(F.avg(c("inventory_units") / c("demand_units")), 4).alias("mean_coverage"),
        rnd(F.avg("unit_cost_usd"), 4).alias("mean_unit_cost"))


@register("ana_supplier_scorecard", SE + _SCORE_SQL)
def ana_supplier_scorecard(spark, sf_dir):
    """Supplier scorecard / consolidated matrix."""
    return _scorecard(ev(spark, sf_dir))


@register("ana_country", SE + f"""
SELECT supplier_country, count(*) AS n_orders, {R('avg(delay_occurred)', 6)} AS delay_rate,
       {RS('avg(actual_lead_time_days - planned_lead_time_days)', 4)} AS mean_slippage
FROM supply_events GROUP BY supplier_country
""")
def ana_country(spark, sf_dir):
    """A10: country performance."""
    return ev(spark, sf_dir).groupBy("supplier_country").agg(
        F.count(F.lit(1)).alias("n_orders"), rnd(F.avg("delay_occurred"), 6).alias("delay_rate"),
        rnd_signed(F.avg(F.col("actual_lead_time_days") - F.col("planned_lead_time_days")), 4).alias("mean_slippage"))


@register("ana_lead_time", SE + f"""
SELECT {R('avg(planned_lead_time_days)', 4)} AS mean_planned, {R('stddev_samp(planned_lead_time_days)', 4)} AS std_planned,
       {R('avg(actual_lead_time_days)', 4)} AS mean_actual, {R('stddev_samp(actual_lead_time_days)', 4)} AS std_actual,
       {RS('avg(actual_lead_time_days - planned_lead_time_days)', 4)} AS mean_slippage,
       max(actual_lead_time_days - planned_lead_time_days) AS max_slippage
FROM supply_events
""")
def ana_lead_time(spark, sf_dir):
    """Lead-time statistics."""
    c = F.col
    return ev(spark, sf_dir).agg(
        rnd(F.avg("planned_lead_time_days"), 4).alias("mean_planned"),
        rnd(F.stddev_samp("planned_lead_time_days"), 4).alias("std_planned"),
        rnd(F.avg("actual_lead_time_days"), 4).alias("mean_actual"),
        rnd(F.stddev_samp("actual_lead_time_days"), 4).alias("std_actual"),
        rnd_signed(F.avg(c("actual_lead_time_days") - c("planned_lead_time_days")), 4).alias("mean_slippage"),
        F.max(c("actual_lead_time_days") - c("planned_lead_time_days")).alias("max_slippage"))


@register("ana_shortage_tiers", SE + f"""
SELECT 'product' AS dimension, product_id AS value, count(*) AS n,
       {R('avg(CAST(inventory_units < demand_units AS INTEGER))', 6)} AS rate FROM supply_events GROUP BY product_id
UNION ALL
SELECT 'service_tier', service_risk, count(*), {R('count(*) / (SELECT count(*) FROM supply_events)', 6)}
FROM supply_events GROUP BY service_risk
""")
def ana_shortage_tiers(spark, sf_dir):
    """Shortage rate by product; service-tier shares (total as a 1-row broadcast)."""
    e = ev(spark, sf_dir)
    a = e.groupBy(F.col("product_id").alias("value")).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg((F.col("inventory_units") < F.col("demand_units")).cast("int")), 6).alias("rate"))
    tot = e.agg(F.count(F.lit(1)).alias("_t"))
    b = e.groupBy(F.col("service_risk").alias("value")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(tot)) \
        .select("value", "n", rnd(F.col("n") / F.col("_t"), 6).alias("rate"))
    return a.select(F.lit("product").alias("dimension"), "*").unionByName(
        b.select(F.lit("service_tier").alias("dimension"), "*"))


@register("ana_correlations", SE + " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, {RS(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))', 6)} AS pearson "
    f"FROM supply_events"
    for i, a in enumerate(A.DESCRIBE_COLUMNS) for b in A.DESCRIBE_COLUMNS[i + 1:]))
def ana_correlations(spark, sf_dir):
    """12x12 Pearson matrix (upper triangle)."""
    return A.correlations(ev(spark, sf_dir))


@register("ana_delay_severity", SE + f"""
SELECT delay_days, count(*) AS n, {R('count(*) / (SELECT count(*) FROM supply_events WHERE delay_days > 0)', 6)} AS share
FROM supply_events WHERE delay_days > 0 GROUP BY delay_days
""")
def ana_delay_severity(spark, sf_dir):
    """Distribution of delay severity among delayed events."""
    d = ev(spark, sf_dir).filter(F.col("delay_days") > 0)
    tot = d.agg(F.count(F.lit(1)).alias("_t"))
    return d.groupBy("delay_days").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(tot)) \
        .select("delay_days", "n", rnd(F.col("n") / F.col("_t"), 6).alias("share"))


@register("ana_cost_compare", SE + f"""
, m AS (SELECT avg(estimated_primary_cost_usd) AS p, avg(estimated_secondary_cost_usd) AS s,
               avg(air_freight_cost_usd) AS a FROM supply_events)
SELECT 'primary' AS option, {R('p', 4)} AS mean_cost, 0.0 AS pct_over_primary FROM m
UNION ALL SELECT 'secondary', {R('s', 4)}, {RS('(s - p) / p * 100', 4)} FROM m
UNION ALL SELECT 'air_freight', {R('a', 4)}, {RS('(a - p) / p * 100', 4)} FROM m
""")
def ana_cost_compare(spark, sf_dir):
    """Mean primary / secondary / air cost and % over primary (long form)."""
    m = ev(spark, sf_dir).agg(F.avg("estimated_primary_cost_usd").alias("p"), F.avg("estimated_secondary_cost_usd").alias("s"),
                              F.avg("air_freight_cost_usd").alias("a"))
    arr = F.array(
        F.struct(F.lit("primary").alias("option"), rnd("p", 4).alias("mean_cost"), F.lit(0.0).alias("pct_over_primary")),
        F.struct(F.lit("secondary").alias("option"), rnd("s", 4).alias("mean_cost"),
                 rnd_signed((F.col("s") - F.col("p")) / F.col("p") * 100, 4).alias("pct_over_primary")),
        F.struct(F.lit("air_freight").alias("option"), rnd("a", 4).alias("mean_cost"),
                 rnd_signed((F.col("a") - F.col("p")) / F.col("p") * 100, 4).alias("pct_over_primary")))
    return m.select(F.explode(arr).alias("r")).select("r.*")


@register("ana_risk_quartiles", SE + f"""
, x AS (SELECT {R('1.0 - supplier_reliability', 4)} AS v, delay_occurred FROM supply_events),
e AS (SELECT quantile_cont(v, 0.25) AS e1, quantile_cont(v, 0.5) AS e2, quantile_cont(v, 0.75) AS e3 FROM x)
SELECT CASE WHEN v <= e1 THEN 1 WHEN v <= e2 THEN 2 WHEN v <= e3 THEN 3 ELSE 4 END AS quartile, count(*) AS n,
       {R('avg(delay_occurred)', 6)} AS rate
FROM x, e GROUP BY 1
""")
def ana_risk_quartiles(spark, sf_dir):
    """Delay rate by supplier-risk value quartile (ties kept together)."""
    e = features.capacity_supplier_features(ev(spark, sf_dir))
    return A.value_quartile_rates(e, "supplier_risk_score", "delay_occurred")


@register("ana_dataset_summary", SE + f"""
SELECT count(*) AS n_records, count(DISTINCT supplier_id) AS n_suppliers, count(DISTINCT product_id) AS n_products,
       {R('avg(delay_occurred) * 100', 4)} AS delay_pct,
       {R('avg(delay_days) FILTER (WHERE delay_days > 0)', 4)} AS mean_delay_when_delayed,
       {R('avg(demand_units)', 4)} AS mean_demand, {R('avg(inventory_units)', 4)} AS mean_inventory,
       count(*) FILTER (WHERE service_risk = 'High') AS n_high_tier,
       count(*) FILTER (WHERE service_risk = 'Medium') AS n_medium_tier,
       count(*) FILTER (WHERE service_risk = 'Low') AS n_low_tier
FROM supply_events
""")
def ana_dataset_summary(spark, sf_dir):
    """Dataset summary."""
    c = F.col
    return ev(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_records"), F.count_distinct("supplier_id").alias("n_suppliers"),
        F.count_distinct("product_id").alias("n_products"), rnd(F.avg("delay_occurred") * 100, 4).alias("delay_pct"),
        rnd(F.avg(F.when(c("delay_days") > 0, c("delay_days"))), 4).alias("mean_delay_when_delayed"),
        rnd(F.avg("demand_units"), 4).alias("mean_demand"), rnd(F.avg("inventory_units"), 4).alias("mean_inventory"),
        *[F.count_if(c("service_risk") == t).alias(f"n_{t.lower()}_tier") for t in ("High", "Medium", "Low")])
