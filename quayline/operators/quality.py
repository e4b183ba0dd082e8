"""Data quality (C1-C24): imputation, deduplication, rule and constraint reports.

Every report is one aggregate pass (conditional counts) or a keyed join; bound
values such as medians and percentiles are exact and distributed
(:mod:`quayline.operators.scan`) and enter row plans as 1-row broadcasts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rnd, rnd_signed
from .scan import exact_quantiles, long_values

# fixed values: columns checked for IQR outliers
IQR_COLUMNS = ("demand_units", "inventory_units", "supplier_capacity_units", "planned_lead_time_days",
               "actual_lead_time_days", "delay_days", "unit_cost_usd", "transport_cost_usd", "air_freight_cost_usd")

# fixed values: accepted spellings of the binary target
TARGET_MAP = (("true", 1), ("false", 0), ("1", 1), ("0", 0), ("yes", 1), ("no", 0),
              ("delayed", 1), ("on_time", 0), ("1.0", 1), ("0.0", 0))


def null_counts(df: DataFrame, cols=None) -> DataFrame:
    """(column_name, n_missing) for every column, one aggregate pass."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing"))
                                           for c in cols])).alias("kv")).select("kv.*")


def mode_row(df: DataFrame, col: str, alias: str) -> DataFrame:
    """Most frequent non-null value, ties -> smallest (1-row frame)."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.min_by(F.col(col), F.struct(-F.col("_n"), F.col(col))).alias(alias))


def impute(df: DataFrame, numeric_cols: list[str], categorical_cols: list[str]) -> DataFrame:
    """Numeric nulls -> exact column median; categorical nulls -> mode."""
    out = df
    if numeric_cols:
        q = exact_quantiles(df, numeric_cols, [0.5])
        med = q.groupBy().agg(*[F.max(F.when(F.col("column_name") == c, F.col("quantile"))).alias(f"_med_{c}")
                                for c in numeric_cols])
        out = out.crossJoin(F.broadcast(med))
    for c in categorical_cols:
        out = out.crossJoin(F.broadcast(mode_row(df, c, f"_mode_{c}")))
    sel = []
    for c in df.columns:
        if c in numeric_cols:
            sel.append(F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}")).alias(c))
        elif c in categorical_cols:
            sel.append(F.coalesce(F.col(c), F.col(f"_mode_{c}")).alias(c))
        else:
            sel.append(F.col(c))
    return out.select(*sel)


def _repeats(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(``df`` with a 128-bit fingerprint ``_h1``, ``_h2`` of ``keys``, the fingerprints that several rows have)."""
    hashed = df.withColumn("_h1", F.xxhash64(*keys)).withColumn("_h2", F.xxhash64(F.lit("second"), *keys))
    return hashed, hashed.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1").drop("_copies")


def drop_exact_duplicates(df: DataFrame, ignore: list[str], order: list[Column]) -> DataFrame:
    """C4: keep the first copy of rows equal on all columns except ``ignore``.

    Fingerprints are counted first; whole rows meet and are compared only where fingerprints do, the
    others pass without a shuffle of their columns."""
    keys = [c for c in df.columns if c not in ignore]
    hashed, shared = _repeats(df, keys)
    single = hashed.join(shared, ["_h1", "_h2"], "left_anti").select(*df.columns)
    w = Window.partitionBy("_h1", "_h2", *keys).orderBy(*order)
    first = (hashed.join(shared, ["_h1", "_h2"], "left_semi").withColumn("_rn", F.row_number().over(w))
             .where("_rn = 1").select(*df.columns))
    return single.unionByName(first)


def dedup_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row per business key by an explicit ordinal (not an arbitrary survivor)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def standardize_types(df: DataFrame, int_cols, float_cols, str_cols, date_col="date") -> DataFrame:
    """Date parse, integers by round-half-even then cast, doubles and strings."""
    sel = []
    for c in df.columns:
        if c == date_col:
            sel.append(F.to_date(F.col(c)).alias(c))
        elif c in int_cols:
            sel.append(F.bround(F.col(c).cast("double"), 0).cast("long").alias(c))
        elif c in float_cols:
            sel.append(F.col(c).cast("double").alias(c))
        elif c in str_cols:
            sel.append(F.col(c).cast("string").alias(c))
        else:
            sel.append(F.col(c))
    return df.select(*sel)


def operational_rule_counts(df: DataFrame) -> DataFrame:
    """Five domain-rule violation counts in one aggregate."""
    c = F.col
    return df.agg(
        F.count_if((c("supplier_reliability") < 0) | (c("supplier_reliability") > 1)).alias("invalid_reliability"),
        F.count_if((c("demand_units") <= 0) | (c("inventory_units") < 0) | (c("supplier_capacity_units") <= 0))
        .alias("invalid_demand_inv"),
        F.count_if((c("planned_lead_time_days") <= 0) | (c("actual_lead_time_days") < c("planned_lead_time_days"))
                   | (c("actual_lead_time_days") != c("planned_lead_time_days") + c("delay_days")))
        .alias("invalid_lead_times"),
        F.count_if(((c("delay_occurred") == 0) & (c("delay_days") != 0)) | ((c("delay_occurred") == 1) & (c("delay_days") <= 0)))
        .alias("invalid_delays"),
        F.count_if((c("unit_cost_usd") <= 0) | (c("transport_cost_usd") <= 0) | (c("air_freight_cost_usd") <= 0)
                   | (c("secondary_supplier_premium_pct") < 0.05) | (c("secondary_supplier_premium_pct") > 0.20))
        .alias("invalid_costs"))


# fixed values: columns the gate requires, allowed categories and risk tiers
GATE_COLUMNS = ("date", "supplier_id", "product_id", "category", "demand_units", "inventory_units", "supplier_capacity_units",
                "supplier_reliability", "planned_lead_time_days", "actual_lead_time_days", "delay_occurred", "delay_days",
                "unit_cost_usd", "transport_cost_usd", "secondary_supplier_premium_pct", "estimated_primary_cost_usd",
                "estimated_secondary_cost_usd", "air_freight_cost_usd", "service_risk")
GATE_CATEGORIES = ("Electronics", "Energy", "Components")
GATE_TIERS = ("Low", "Medium", "High")


def dataset_gate(df: DataFrame, min_rows: int = 500, tiers=GATE_TIERS, categories=GATE_CATEGORIES) -> DataFrame:
    """The whole gate in one row: rows, nulls in required columns, repeated rows, seven rule counts, ``passed``.

    The rules are one aggregate over the rows; repeats are counted by fingerprint, and whole rows are
    grouped only where fingerprints meet.  A null breaks no range rule (it is counted as a null), but is neither a
    category nor a tier."""
    missing = [x for x in GATE_COLUMNS if x not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    c = F.col

    def broken(rule):
        return F.count_if(rule)

    nulls = sum((c(x).isNull().cast("long") for x in GATE_COLUMNS), F.lit(0))
    costs = [c(x) <= 0 for x in ("unit_cost_usd", "transport_cost_usd", "air_freight_cost_usd", "estimated_primary_cost_usd",
                                 "estimated_secondary_cost_usd")]
    any_cost = costs[0]
    for x in costs[1:]:
        any_cost = any_cost | x
    premium, late, days = c("secondary_supplier_premium_pct"), c("delay_occurred"), c("delay_days")
    rules = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(nulls), F.lit(0)).alias("n_nulls"),
        broken((c("supplier_reliability") < 0) | (c("supplier_reliability") > 1)).alias("bad_reliability"),
        broken(any_cost | (premium < 0) | (premium > 1)).alias("bad_costs"),
        broken((c("planned_lead_time_days") <= 0) | (c("actual_lead_time_days") < c("planned_lead_time_days"))
               | (c("actual_lead_time_days") != c("planned_lead_time_days") + days)).alias("bad_lead_times"),
        broken(((late == 0) & (days != 0)) | ((late == 1) & (days <= 0)) | ~late.isin(0, 1)).alias("bad_delays"),
        broken((c("demand_units") <= 0) | (c("inventory_units") < 0) | (c("supplier_capacity_units") <= 0)).alias("bad_units"),
        broken(F.coalesce(~c("category").isin(*categories), F.lit(True))).alias("bad_category"),
        broken(F.coalesce(~c("service_risk").isin(*tiers), F.lit(True))).alias("bad_tier"))
    hashed, shared = _repeats(df, df.columns)
    same = hashed.join(shared, ["_h1", "_h2"], "left_semi").groupBy("_h1", "_h2", *df.columns).agg(F.count(F.lit(1)).alias("_n"))
    repeats = same.agg(F.coalesce(F.sum(c("_n") - 1), F.lit(0)).alias("n_repeated_rows"))
    agg = rules.crossJoin(repeats).select("n_rows", "n_nulls", "n_repeated_rows", *rules.columns[2:])  # one row each
    faults = sum((c(x) for x in agg.columns[1:]), F.lit(0))
    return agg.withColumn("passed", (faults == 0) & (c("n_rows") >= min_rows))


def iqr_outliers(df: DataFrame, cols=IQR_COLUMNS, multiplier: float = 1.5) -> DataFrame:
    """(column_name, q1, q3, lower, upper, n_outliers) with strict fences."""
    q = exact_quantiles(df, list(cols), [0.25, 0.75])
    b = q.groupBy("column_name").agg(F.max(F.when(F.col("prob") == 0.25, F.col("quantile"))).alias("q1"),
                                      F.max(F.when(F.col("prob") == 0.75, F.col("quantile"))).alias("q3"))
    b = b.select("column_name", "q1", "q3",
                 (F.col("q1") - (F.col("q3") - F.col("q1")) * multiplier).alias("lower"),
                 (F.col("q3") + (F.col("q3") - F.col("q1")) * multiplier).alias("upper"))
    # one row of bounds beside every row: all columns are counted in one aggregate
    fences = b.groupBy().agg(*[F.max(F.when(F.col("column_name") == c, F.col(w))).alias(f"_{w}{j}")
                               for j, c in enumerate(cols) for w in ("lower", "upper")])
    wide = df.select(*cols).crossJoin(F.broadcast(fences)).agg(*[
        F.count_if((F.col(c) < F.col(f"_lower{j}")) | (F.col(c) > F.col(f"_upper{j}"))).alias(f"_n{j}")
        for j, c in enumerate(cols)])
    counts = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_n{j}").alias("n_outliers"))
                                             for j, c in enumerate(cols)])).alias("r")).select("r.*")
    return b.join(counts, "column_name", "left").select(
        "column_name", rnd_signed("q1", 8).alias("q1"), rnd_signed("q3", 8).alias("q3"),
        rnd_signed("lower", 8).alias("lower"), rnd_signed("upper", 8).alias("upper"),
        F.coalesce("n_outliers", F.lit(0)).alias("n_outliers"))


def percentile_flags(df: DataFrame) -> DataFrame:
    """C11: demand/inventory outside [p1, p99]; unit or transport cost > p98; actual lead time > p98."""
    q = exact_quantiles(df, ["demand_units", "inventory_units", "unit_cost_usd", "transport_cost_usd",
                             "actual_lead_time_days"], [0.01, 0.98, 0.99])

    def pick(col, p):
        return F.max(F.when((F.col("column_name") == col) & (F.col("prob") == p), F.col("quantile")))

    b = q.groupBy().agg(pick("demand_units", 0.01).alias("_d1"), pick("demand_units", 0.99).alias("_d99"),
                        pick("inventory_units", 0.01).alias("_i1"), pick("inventory_units", 0.99).alias("_i99"),
                        pick("unit_cost_usd", 0.98).alias("_u98"), pick("transport_cost_usd", 0.98).alias("_t98"),
                        pick("actual_lead_time_days", 0.98).alias("_l98"))
    x = df.crossJoin(F.broadcast(b))
    c = F.col
    return x.select(
        *df.columns,
        ((c("demand_units") < c("_d1")) | (c("demand_units") > c("_d99"))).cast("int").alias("demand_outlier_flag"),
        ((c("inventory_units") < c("_i1")) | (c("inventory_units") > c("_i99"))).cast("int").alias("inventory_outlier_flag"),
        ((c("unit_cost_usd") > c("_u98")) | (c("transport_cost_usd") > c("_t98"))).cast("int").alias("cost_outlier_flag"),
        (c("actual_lead_time_days") > c("_l98")).cast("int").alias("lead_time_outlier_flag"))


def profile(df: DataFrame, numeric_cols: list[str]) -> DataFrame:
    """Per numeric column: nulls, null %, exact distinct, min, max, mean, median."""
    total = df.agg(F.count(F.lit(1)).alias("_rows"))
    nulls = null_counts(df, numeric_cols)
    lv = long_values(df, numeric_cols)
    stats = lv.groupBy("column_name").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"),
                                          F.avg("value").alias("_mean"))
    distinct = lv.select("column_name", "value").distinct().groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_distinct"))
    med = exact_quantiles(df, numeric_cols, [0.5]).select("column_name", F.col("quantile").alias("_median"))
    return (nulls.crossJoin(F.broadcast(total)).join(stats, "column_name", "left").join(distinct, "column_name", "left")
            .join(med, "column_name", "left")
            .select("column_name", "n_missing", rnd(F.col("n_missing") / F.col("_rows") * 100, 4).alias("missing_pct"),
                    F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "min_value", "max_value",
                    rnd_signed("_mean", 6).alias("mean_value"), rnd_signed("_median", 6).alias("median_value")))


def constraint_report(checks: list[tuple[str, str, DataFrame, Column]]) -> DataFrame:
    """(table_name, rule_name, n_violations) for a rule table; null-tolerant rules
    (a null operand is not a violation, as in SQL CHECK).  One aggregate per table for all its rules."""
    tables: dict[str, tuple[DataFrame, list]] = {}
    for table, rule, df, ok in checks:
        tables.setdefault(table, (df, []))[1].append((rule, ok))
    parts = []
    for table, (df, rules) in tables.items():
        row = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(True))).alias(rule) for rule, ok in rules])
        long = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule_name"), F.col(rule).alias("n_violations")) for rule, _ in rules]))
        parts.append(row.select(long.alias("r")).select(F.lit(table).alias("table_name"), "r.rule_name", "r.n_violations"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def search(df: DataFrame, text: str, cols: list[str]) -> DataFrame:
    """Case-insensitive substring filter over several columns."""
    pat = "%" + text.replace("%", "\\%").replace("_", "\\_") + "%"
    cond = None
    for c in cols:
        e = F.col(c).ilike(pat)
        cond = e if cond is None else (cond | e)
    return df.filter(cond)
