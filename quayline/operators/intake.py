"""Intake: event keys, appends that keep only known events, chronological sinks and dataset checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import TARGET_MAP
from .relational import id_keys


def with_event_id(df: DataFrame, id_col: str = "event_id") -> DataFrame:
    """A missing event id becomes ``EVT_{date}_{supplier}_{product}``; where one of these is missing
    too, ``EVT_`` and a hash of the whole row (a running number would depend on the row order)."""
    parts = [F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string") for c in ("date", "supplier_id", "product_id")]
    key = F.concat(F.lit("EVT_"), parts[0], F.lit("_"), parts[1], F.lit("_"), parts[2])
    row = F.concat(F.lit("EVT_"), F.lpad(F.hex(F.xxhash64(*[F.col(c) for c in df.columns])), 16, "0"))
    given = F.col(id_col) if id_col in df.columns else F.lit(None).cast("string")
    return df.withColumn(id_col, F.coalesce(given, key, row))


def known_predictions(predictions: DataFrame, events: DataFrame) -> DataFrame:
    """The predictions whose event is known (what an append writes)."""
    return predictions.join(events.select("event_id"), "event_id", "left_semi")


def known_assessments(assessed: DataFrame, events: DataFrame, latest: DataFrame) -> DataFrame:
    """Assessments of known events with the id of the event's latest prediction (null if it has none)."""
    by = id_keys(assessed, events)
    kept = assessed.join(events.select(*by), by, "left_semi")
    by = id_keys(kept, latest)
    return kept.join(latest.select(*by, "prediction_id"), by, "left")


def append(df: DataFrame, path: str) -> None:
    """Append rows to a parquet table (one committed write)."""
    df.write.mode("append").parquet(path)


def chronological(df: DataFrame, order: tuple[str, ...] = ("date", "supplier_id", "product_id")) -> DataFrame:
    """Rows range-partitioned and sorted by ``order``, so files written from it are in order; no single-task sort."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def _target(col: str) -> Column:
    spelled = F.create_map(*[x for k, v in TARGET_MAP for x in (F.lit(k), F.lit(v))])
    return spelled[F.lower(F.trim(F.col(col).cast("string")))]


def target_report(df: DataFrame, col: str) -> DataFrame:
    """One row (n_rows, n_null, n_unmapped, n_positive, accepted); a missing column is refused at once."""
    if col not in df.columns:
        raise ValueError(f"target column {col!r} is not among {df.columns}")
    value, raw = _target(col), F.col(col)
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(raw.isNull()).alias("n_null"),
                    F.count_if(raw.isNotNull() & value.isNull()).alias("n_unmapped"), F.count_if(value == 1).alias("n_positive"))
    return counts.withColumn("accepted", (F.col("n_rows") > F.col("n_null")) & (F.col("n_unmapped") == 0))


def require_target(df: DataFrame, col: str, out: str = "target") -> DataFrame:
    """C15 with rejection: ``out`` as 0/1, or ValueError if the column is empty, all null or holds other values."""
    r = target_report(df, col).first()
    if not r.accepted:
        raise ValueError(f"target column {col!r}: {r.n_rows} rows, {r.n_null} null, {r.n_unmapped} not 0/1")
    return df.withColumn(out, _target(col).cast("int"))


def split_report(df: DataFrame, target: str, date: str, leakage: tuple[str, ...], identifiers: tuple[str, ...]) -> DataFrame:
    """Dataset check before a split, one aggregate: counts, date validity, leakage and id columns present."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} is not among {df.columns}")
    t = F.col(target).cast("double")
    bad_date = F.to_date(F.col(date).cast("string")).isNull() if date in df.columns else F.lit(True)
    row = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(target).isNull()).alias("n_null_target"),
                 F.count_if(F.col(target).isNotNull() & (t.isNull() | ~t.isin(0.0, 1.0))).alias("n_non_binary"),
                 F.count_if(t == 1).alias("n_positive"), F.count_if(bad_date).alias("n_bad_dates"))
    return row.select("*", F.lit(",".join(c for c in leakage if c in df.columns and c != target)).alias("leakage_columns"),
                      F.lit(",".join(c for c in identifiers if c in df.columns)).alias("identifier_columns"),
                      ((F.col("n_rows") > 0) & (F.col("n_null_target") == 0) & (F.col("n_non_binary") == 0)).alias("is_valid"))
