"""Exact scores at band edges (R3-R7), reasons, alerts and the past-only rate."""

import pytest
from pyspark.sql import functions as F

from quayline.operators import features, risk


def _one(spark, schema, rows, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_supplier_risk(spark):
    got = _one(spark, "rel double, rate double", [(1.0, None), (0.70, None), (0.0, None), (0.80, 0.40)],
               risk.supplier_risk("rel", "rate"))
    assert got == [0.0, 0.30, 1.0, 0.26]


def test_inventory_risk_bands(spark):
    covs = [0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.5]
    got = _one(spark, "c double", [(c,) for c in covs], risk.inventory_risk("c"))
    assert got == [1.0, 0.9, 0.8, 0.6, 0.4, 0.2, 0.0]


def test_inventory_zero_demand(spark):
    got = _one(spark, "i double, d double", [(500.0, 0.0)], risk.inventory_risk(risk.coverage_from_units("i", "d")))
    assert got == [0.0]


def test_capacity_zero(spark):
    got = _one(spark, "d double, c double", [(500.0, 0.0), (0.0, 0.0)], risk.capacity_risk("d", "c"))
    assert got == [1.0, 0.0]


def test_service_risk(spark):
    got = _one(spark, "t string, c double, s int",
               [("CRITICAL", 0.30, None), ("CRITICAL", 1.50, None), ("LOW", 0.30, None), (None, 0.30, None)],
               risk.service_risk("t", "c", "s"))
    assert got == [1.0, 0.4, 0.25, None]


def test_composite_renormalises(spark):
    got = _one(spark, "a double, b double, c double, d double, e double", [(1.0, 0.0, 0.0, 0.0, None)],
               risk.composite_score("a", "b", "c", "d", "e"))
    assert got == [pytest.approx(0.4 / 0.9, abs=1e-4)]


def test_past_rate_is_past_only(spark):
    df = spark.createDataFrame([(1, "2024-01-01", "e1", 1), (1, "2024-01-02", "e2", 0), (1, "2024-01-03", "e3", 1),
                                (1, "2024-01-04", "e4", 0)],
                               "supplier_id int, date string, event_id string, delay_occurred int")
    out = features.supplier_past_delay_rate(df).orderBy("date").select("historical_delay_rate").collect()
    assert [r[0] for r in out] == [0.0, 1.0, 0.5, 0.6667]


def test_alert_dedup_second_run_adds_nothing(spark):
    rows = [("E1", 0.85, "CRITICAL", ["X"]), ("E2", 0.65, "HIGH", [])]
    a = spark.createDataFrame(rows, "event_id string, composite_risk_score double, risk_level string, "
                                    "risk_reasons array<string>")
    first = risk.dedup_alerts(risk.alerts(a))
    assert first.count() == 2
    second = risk.dedup_alerts(risk.alerts(a), history=first)
    assert second.count() == 0


def test_service_path_constant_rate_and_default_reason(spark):
    ev = spark.createDataFrame(
        [("a", .1, 1.0, .9, 100, 1000, "LOW"), ("b", .1, 1.0, .9, 100, 1000, "CRITICAL"), ("c", .1, 1.0, .9, 100, 1000, None)],
        "event_id string, delay_probability double, supplier_reliability double, historical_delay_rate double, "
        "demand_units long, supplier_capacity_units long, criticality_level string")
    stock = spark.createDataFrame([("a", 500), ("b", 60)], "event_id string, latest_available_units long")
    rows = {r.event_id: r for r in risk.service_path(ev, stock, past_rate=.15).collect()}
    assert rows["a"].supplier_risk_score == .045 and rows["a"].stored_reasons == "no reason met"
    assert rows["b"].service_risk_score == .8 and "inventory_coverage=0.6000" in rows["b"].stored_reasons
    assert rows["c"].inventory_units == 0 and rows["c"].service_risk_score is None
    kept = {r.event_id: r for r in risk.service_path(ev, stock).collect()}
    assert kept["a"].supplier_risk_score == .27
