"""Outcomes, learning, evaluation and lifecycle against hand values and sequential folds."""

import random

import pytest
from pyspark.sql import functions as F

from quayline.params import LearningParams
from quayline.operators import evaluation, learning, lifecycle, outcomes


def test_outcome_success(spark):
    df = spark.createDataFrame([(18000.0, 15000.0, 2, 2, 1.0, 0.95, "APPROVED")],
                               "actual_cost double, estimated_cost double, actual_delay_days long, "
                               "estimated_delay_days long, actual_service_level double, estimated_service_level double, "
                               "decision_status string")
    r = outcomes.classify(outcomes.variances(df)).first()
    assert r["cost_variance"] == 3000.0 and r["cost_variance_pct"] == 20.0 and r["outcome_status"] == "SUCCESS"


def _checked(spark, ratios, strategy="AIR_FREIGHT"):
    rows = [(f"o{i}", strategy, f"2024-01-0{i + 1}", 15000.0 * r, 15000.0, "SUCCESS") for i, r in enumerate(ratios)]
    df = spark.createDataFrame(rows, "outcome_id string, strategy_type string, evaluation_date string, "
                                     "actual_cost double, estimated_cost double, outcome_status string")
    return learning.candidate_check(df)


def test_ewma_three_ratios(spark):
    m = learning.ewma_by_strategy(_checked(spark, [1.2, 1.2, 1.2])).first()
    assert m["multiplier"] == 1.0976 and m["multiplier_applied"] == 1.10


def test_evidence_gate_and_outlier(spark):
    assert learning.ewma_by_strategy(_checked(spark, [1.2, 1.2])).first()["multiplier"] == 1.0
    c = _checked(spark, [80000.0 / 15000.0]).first()
    assert not c["is_valid"]


def test_clamp(spark):
    m = learning.ewma_by_strategy(_checked(spark, [3.0] * 12)).first()
    assert m["multiplier"] == 1.30 and m["was_clamped"]


def _ratios(spark, ratios):
    rows = [(f"o{i:05d}", "AIR_FREIGHT", "2024-01-01", 15000.0 * r, 15000.0, "SUCCESS") for i, r in enumerate(ratios)]
    return learning.candidate_check(spark.createDataFrame(
        rows, "outcome_id string, strategy_type string, evaluation_date string, actual_cost double, "
              "estimated_cost double, outcome_status string")).repartition(7)


@pytest.mark.parametrize("alpha", [0.2, 0.001, 1.0])
def test_folded_ewma_equals_recursion(spark, alpha):
    rnd = random.Random(3)
    ratios = [rnd.uniform(0.8, 1.25) for _ in range(10_000)]
    mu = 1.0
    for r in ratios:
        mu = alpha * r + (1 - alpha) * mu
    lp = LearningParams(alpha=alpha)
    fold = learning.fold_ratios(_ratios(spark, ratios), lp).first()
    assert fold["n"] == 10_000
    assert (1 - alpha) ** 10_000 + fold["shift"] == pytest.approx(mu, rel=1e-12)
    got = learning.ewma_by_strategy(_ratios(spark, ratios), lp).first()
    assert got["multiplier"] == pytest.approx(min(1.3, max(0.7, mu)), abs=1e-4)


def test_cost_metric(spark):
    y = [1, 1, 0, 0, 0, 1]
    p = [0.0, 0.0, 1.0, 1.0, 1.0, 1.0]
    df = spark.createDataFrame(list(zip(p, y)), "delay_probability double, delay_occurred int")
    r = evaluation.classification_metrics(evaluation.prepare(df), 0.5).first()
    assert (r["fn"], r["fp"], r["total_error_cost"]) == (2, 3, 13000.0)


def test_threshold_monotone(spark):
    rnd = random.Random(1)
    rows = [(rnd.random(), rnd.randint(0, 1)) for _ in range(500)]
    df = evaluation.prepare(spark.createDataFrame(rows, "delay_probability double, delay_occurred int"))
    g = evaluation.threshold_grid(df).orderBy("threshold").collect()
    rec = [r["recall"] for r in g]
    spec = [r["specificity"] for r in g]
    assert rec == sorted(rec, reverse=True) and spec == sorted(spec)


def _sequential(events):
    d, e, rej, done = "PENDING", "NOT_STARTED", 0, None
    for ts, rid, kind, target in sorted(events):
        d2, e2, ok = lifecycle.apply_request(d, e, kind, target)
        if ok and kind == "execution" and target == "COMPLETED" and e != "COMPLETED" and done is None:
            done = ts
        rej += 0 if ok else 1
        d, e = d2, e2
    return d, e, rej


def test_lifecycle_fold_equals_sequential(spark):
    import datetime as dt
    rnd = random.Random(5)
    kinds = [("decision", s) for s in lifecycle.DECISION_STATUSES] + \
            [("execution", s) for s in lifecycle.EXECUTION_STATUSES]
    logs = {}
    rows = []
    for dec in range(30):
        evs = []
        for j in range(rnd.randint(1, 25)):
            ts = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randint(0, 60 * 72))
            k, t = rnd.choice(kinds)
            evs.append((ts, dec * 1000 + j, k, t))
            rows.append((dec, ts, dec * 1000 + j, k, t))
        logs[dec] = evs
    df = spark.createDataFrame(rows, "decision_id long, ts timestamp, request_id long, kind string, target_status string")
    got = {r["decision_id"]: (r["decision_status"], r["execution_status"], r["n_rejected"])
           for r in lifecycle.fold_lifecycle(df).collect()}
    for dec, evs in logs.items():
        assert got[dec] == _sequential(evs)


def test_hot_decision_is_folded_in_slices_and_keeps_its_reason(spark):
    import datetime as dt
    rnd = random.Random(6)
    kinds = [("decision", s) for s in lifecycle.DECISION_STATUSES] + [("execution", s) for s in lifecycle.EXECUTION_STATUSES] + [("x", "y")]
    rows, start = [], dt.datetime(2024, 1, 1)
    for j in range(3000):  # decision 0 has two thirds of the rows, all in one day
        k, t = rnd.choice(kinds)
        rows.append((0 if j % 3 else 1 + j % 11, start + dt.timedelta(seconds=rnd.randint(0, 9000)), j, k, t,
                     f"r{j}" if rnd.random() < 0.4 else None))
    df = spark.createDataFrame(rows, "decision_id long, ts timestamp, request_id long, kind string, target_status string, decision_reason string")
    want = {}
    for d, ts, j, k, t, why in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        dec, exe, rejected, reason, n = want.get(d, ("PENDING", "NOT_STARTED", 0, None, 0))
        ok = False
        if k != "x":
            dec, exe, ok = lifecycle.apply_request(dec, exe, k, t)
        want[d] = (dec, exe, rejected + (not ok), why if ok and why is not None else reason, n + 1)
    for fan in (4, 256):
        got = {r.decision_id: (r.decision_status, r.execution_status, r.n_rejected, r.decision_reason, r.n_requests)
               for r in lifecycle.fold_lifecycle(df.repartition(5), slices=8, fan=fan).collect()}
        assert got == want


def test_chronological_cuts_equal_a_global_rank(spark):
    import datetime as dt

    from quayline.operators import evaluation
    rnd = random.Random(3)
    for n, days in ((0, 1), (2, 1), (500, 4)):
        rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(days)) if i % 50 else None, f"e{i:04d}") for i in range(n)]
        df = spark.createDataFrame(rows, "date date, event_id string")
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or dt.date.min, r[1]))
        n_test = max(1, int(n * .2))
        n_val = max(1, int((n - n_test) * .2))
        want = {r[1]: "test" if i >= n - n_test else "validation" if i >= n - n_test - n_val else "train" for i, r in enumerate(order)}
        got = {r.event_id: r.split for r in evaluation.chronological_split(df).collect()}
        assert got == want, (n, days)


def test_one_class_has_no_curve(spark):
    from quayline.operators import evaluation
    one = spark.createDataFrame([(.2, 1), (.4, 1)], "p double, y int")
    row = evaluation.calibration_status(one).first()
    assert (row.is_calibrated, row.note) == (False, "one class only: no curve") and row.brier == .5
    ties = spark.createDataFrame([(.1, 0)] * 90 + [(.5, 1)] * 10, "p double, y int")
    assert {(r.bin, r.n) for r in evaluation.quantile_calibration(ties).collect()} == {(0, 90), (4, 10)}


def test_exact_duplicates_by_fingerprint(spark):
    from pyspark.sql import functions as F

    from quayline.operators import quality
    rows = [(i % 40, None if i % 7 == 0 else f"t{i % 40}", i) for i in range(200)] + [(99, "only", 1)]
    df = spark.createDataFrame(rows, "a int, b string, copy int").repartition(4)
    got = sorted((r.a, r.b or "", r.copy) for r in quality.drop_exact_duplicates(df, ["copy"], [F.col("copy")]).collect())
    first = {}
    for a, b, c in sorted(rows, key=lambda r: r[2]):
        first.setdefault((a, b), c)
    assert got == sorted((a, b or "", c) for (a, b), c in first.items())
