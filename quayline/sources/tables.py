"""Scans and sinks.

Scans declare their schema or take the parquet footer; column lists are passed
down so Catalyst prunes the read (``ReadSchema``) and pushes filters.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    """Parquet scan of one base table, pruned to ``columns``."""
    df = spark.read.parquet(table_path(sf_dir, name))
    if columns:
        df = df.select(*columns)
    return df


# --- S1 / S2: delimited event files with a declared schema and column gate ---
RAW_EVENT_SCHEMA = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("supplier_id", T.StringType()),
    T.StructField("supplier_name", T.StringType()),
    T.StructField("supplier_country", T.StringType()),
    T.StructField("supplier_reliability", T.DoubleType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("demand_units", T.DoubleType()),
    T.StructField("inventory_units", T.DoubleType()),
    T.StructField("supplier_capacity_units", T.DoubleType()),
    T.StructField("planned_lead_time_days", T.DoubleType()),
    T.StructField("actual_lead_time_days", T.DoubleType()),
    T.StructField("delay_occurred", T.DoubleType()),
    T.StructField("delay_days", T.DoubleType()),
    T.StructField("unit_cost_usd", T.DoubleType()),
    T.StructField("transport_cost_usd", T.DoubleType()),
    T.StructField("secondary_supplier_premium_pct", T.DoubleType()),
    T.StructField("inventory_demand_ratio", T.DoubleType()),
    T.StructField("estimated_primary_cost_usd", T.DoubleType()),
    T.StructField("estimated_secondary_cost_usd", T.DoubleType()),
    T.StructField("air_freight_cost_usd", T.DoubleType()),
    T.StructField("service_risk", T.StringType()),
])

REQUIRED_EVENT_COLUMNS = tuple(f.name for f in RAW_EVENT_SCHEMA.fields)


class MissingColumnsError(ValueError):
    pass


def require_columns(df: DataFrame, required=REQUIRED_EVENT_COLUMNS) -> DataFrame:
    """Fail at plan-build time when the contract columns are absent."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"missing required columns: {missing}")
    return df


def read_event_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_EVENT_SCHEMA) -> DataFrame:
    """Delimited event file with header and declared schema (never inferred)."""
    if not path.startswith(("s3", "hdfs", "gs", "abfs", "dbfs")) and not os.path.exists(path):
        raise FileNotFoundError(path)
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return require_columns(df, [f.name for f in schema.fields])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None, mode: str = "overwrite") -> None:
    """S3: write a table, optionally partitioned (e.g. by event month)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    """One-row metrics frame written as JSON (one file)."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def with_month(df: DataFrame, date_col: str = "date") -> DataFrame:
    return df.withColumn("event_month", F.date_format(F.col(date_col), "yyyy-MM"))
