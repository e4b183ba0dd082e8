"""Intake queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intake, relational
from ..sources import fixtures
from ..sources.fixtures_sql import with_ctes
from . import sqlbase as S
from .common import assessed, latest_predictions
from .registry import register

_KNOWN = "DATE '1995-01-01'"  # events before this day are taken as unknown to the store


def _known(ev):
    return ev.where(F.col("date") >= F.lit("1995-01-01").cast("date"))


@register("src_append_predictions", with_ctes("supply_events", "predictions") + f"""
SELECT prediction_id, event_id, version, delay_probability FROM predictions p
WHERE EXISTS (SELECT 1 FROM supply_events e WHERE e.event_id = p.event_id AND e.date >= {_KNOWN})
""")
def src_append_predictions(spark, sf_dir):
    """Predictions whose event is in the store."""
    ev = fixtures.supply_events(spark, sf_dir)
    rows = intake.known_predictions(fixtures.predictions(spark, sf_dir, ev), _known(ev))
    return rows.select("prediction_id", "event_id", "version", "delay_probability")


@register("src_append_assessments", S.risk_with() + f"""
, lp AS (SELECT event_id, arg_max(prediction_id, (created_on, prediction_id)) AS prediction_id FROM predictions GROUP BY event_id)
SELECT l.event_id, l.composite_risk_score, l.risk_level, lp.prediction_id
FROM leveled l LEFT JOIN lp USING (event_id) WHERE l.date >= {_KNOWN}
""")
def src_append_assessments(spark, sf_dir):
    """Assessments of known events with their latest prediction."""
    ev = fixtures.supply_events(spark, sf_dir)
    rows = intake.known_assessments(assessed(spark, sf_dir).drop("prediction_id"), relational.with_id_hash(_known(ev)),
                                    latest_predictions(spark, sf_dir, ev, id_hash=True))
    return rows.select("event_id", "composite_risk_score", "risk_level", "prediction_id")


@register("feat_event_ids", with_ctes("supply_events") + """
SELECT order_key, line_number,
       CASE WHEN order_key % 3 = 0 THEN 'EVT_' || CAST(date AS VARCHAR) || '_' || CAST(supplier_id AS VARCHAR) || '_' || product_id
            ELSE event_id END AS event_id
FROM supply_events
""")
def feat_event_ids(spark, sf_dir):
    """Every third order comes without event ids."""
    ev = fixtures.supply_events(spark, sf_dir)
    bare = ev.withColumn("event_id", F.when(F.col("order_key") % 3 != 0, F.col("event_id")))
    return intake.with_event_id(bare).select("order_key", "line_number", "event_id")


@register("dq_chronological", with_ctes("supply_events") + """
SELECT event_id, date, supplier_id, product_id FROM supply_events
""")
def dq_chronological(spark, sf_dir):
    """Events in (date, supplier, product) order across and within partitions."""
    ev = fixtures.supply_events(spark, sf_dir).select("event_id", "date", "supplier_id", "product_id")
    return intake.chronological(ev)


_SPELLED = {0: " Yes", 1: "no", 2: "DELAYED", 3: "on_time ", 4: "True", 5: "0", 6: "1", 7: None, 8: "maybe"}


@register("dq_target_report", with_ctes("supply_events") + """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE order_key % 9 = 7) AS n_null, count(*) FILTER (WHERE order_key % 9 = 8) AS n_unmapped,
       count(*) FILTER (WHERE order_key % 9 IN (0, 2, 4, 6)) AS n_positive,
       count(*) > count(*) FILTER (WHERE order_key % 9 = 7) AND count(*) FILTER (WHERE order_key % 9 = 8) = 0 AS accepted
FROM supply_events
""")
def dq_target_report(spark, sf_dir):
    """Target spellings, nulls and values that cannot be mapped."""
    ev = fixtures.supply_events(spark, sf_dir)
    text = F.create_map(*[F.lit(x) for k, v in _SPELLED.items() if v is not None for x in (k, v)])
    return intake.target_report(ev.withColumn("late", text[(F.col("order_key") % 9).cast("int")]), "late")


@register("dq_split_report", with_ctes("dirty_events") + """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE delay_occurred IS NULL) AS n_null_target,
       count(*) FILTER (WHERE delay_occurred NOT IN (0, 1)) AS n_non_binary, count(*) FILTER (WHERE delay_occurred = 1) AS n_positive,
       count(*) FILTER (WHERE date IS NULL) AS n_bad_dates, 'delay_days,actual_lead_time_days' AS leakage_columns,
       'event_id,supplier_id,product_id' AS identifier_columns,
       count(*) > 0 AND count(*) FILTER (WHERE delay_occurred IS NULL OR delay_occurred NOT IN (0, 1)) = 0 AS is_valid
FROM dirty_events
""")
def dq_split_report(spark, sf_dir):
    """Dataset-and-split validation of the dirty input."""
    return intake.split_report(fixtures.dirty_events(spark, sf_dir), "delay_occurred", "date",
                               ("delay_days", "actual_lead_time_days"), ("event_id", "supplier_id", "product_id"))
