"""Relational access patterns (Q1-Q7) and key checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import grouped_last


#: Name of the column with a hash of an id text; see ``with_id_hash``.
ID_HASH = "_id_hash"


def with_id_hash(df: DataFrame, key: str = "event_id") -> DataFrame:
    """``df`` with ``ID_HASH``, a hash of ``key``.  Joins and windows by (``ID_HASH``, ``key``) give the rows of those by
    ``key``, but sort by numbers: texts that begin alike are compared in full, at two random reads a comparison."""
    return df.withColumn(ID_HASH, F.hash(key))


def id_keys(left: DataFrame, right: DataFrame, key: str = "event_id") -> list[str]:
    """What to join by: the hash too, where both sides have it."""
    return [ID_HASH, key] if ID_HASH in left.columns and ID_HASH in right.columns else [key]


def latest_per_key(df: DataFrame, keys, order: list[Column], few: bool = False) -> DataFrame:
    """Q1: newest row per key (``row_number() = 1`` over the given order).

    Spark plans this as a hash-partitioned window; with ``row_number() = 1``
    the optimizer inserts a per-partition group limit before the shuffle.  That limit sorts all rows once
    more, which does not pay for keys of a ``few`` rows: these are counted instead.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    if few:
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn("_rn", F.count(F.lit(1)).over(upto)).filter(F.col("_rn") == 1).drop("_rn")
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def asof_last(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_date: str, right_date: str,
              right_id: str, value: str, left_id: str, out: str,
              like: Callable[[int], DataFrame] | None = None) -> DataFrame:
    """As-of join: for each left row, ``value`` of the newest right row of the same key
    dated on or before the left row (same date: lowest ``right_id``).

    Both sides are unioned and scanned in (key, date, side) order with a
    carry-forward of the last snapshot value (``scan.grouped_last``); no left x right
    pairs are formed, so a key with many snapshots costs a sort, not a product.  Of the snapshots of
    one day the lowest id comes last in that order, so they need no grouping (and no shuffle) of their own.
    ``like(n)`` gives at most n rows (key, date) of about the same keys as the left, where that costs less than the left itself:
    the sample that cuts heavy keys is then taken from these and from the right side.
    """
    le = left.select(F.col(left_id).alias("_lid"), F.col(left_key).alias("_key"), F.col(left_date).alias("_d"),
                     F.lit(1).alias("_side"), F.lit(None).cast(right.schema[right_id].dataType).alias("_rid"),
                     F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    ri = right.where(F.col(value).isNotNull() & F.col(right_id).isNotNull()).select(
        F.lit(None).cast(left.schema[left_id].dataType).alias("_lid"), F.col(right_key).alias("_key"),
        F.col(right_date).alias("_d"), F.lit(0).alias("_side"), F.col(right_id).alias("_rid"), F.col(value).alias("_v"))
    seen = None
    if like is not None:
        def seen(n):
            marks = like(n).select(F.col(left_key).alias("_key"), F.col(left_date).alias("_d"))
            return marks.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_side"))
    u = grouped_last(le.unionByName(ri), ["_key"], ["_d", "_side"], "_v", "_last", lowest="_rid", like=seen)
    return u.filter(F.col("_side") == 1).select(F.col("_lid").alias(left_id), F.col("_last").alias(out))


def newest_page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 100) -> DataFrame:
    """Newest-first listing with paging (a top-k, not a full sort)."""
    return df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Q3: lookup by business key (pushed down to the scan)."""
    return df.filter(F.col(key) == F.lit(value))


def upsert(current: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Q6: partial update, only supplied (non-null) fields replace the old value."""
    value_cols = [c for c in current.columns if c not in keys]
    u = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in value_cols if c in updates.columns])
    j = current.join(u, keys, "full_outer")
    return j.select(*keys, *[
        (F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in updates.columns else F.col(c)).alias(c)
        for c in value_cols])


def unique_violations(df: DataFrame, keys: list[str], table: str) -> DataFrame:
    """C17: key values that occur more than once."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
            .filter(F.col("n_rows") > 1)
            .select(F.lit(table).alias("table_name"),
                    F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key_value"),
                    F.col("n_rows")))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, table: str) -> DataFrame:
    """Child rows whose foreign key has no parent (left anti join)."""
    p = parent.select(F.col(parent_key).alias("_pk")).distinct()
    return (child.join(p, child[child_key] == p["_pk"], "left_anti")
            .select(F.lit(table).alias("table_name"), F.col(child_key).cast("string").alias("key_value")))
