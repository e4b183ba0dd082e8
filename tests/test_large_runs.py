"""What keeps the large runs within memory, disk and time, on rows of their own."""

import datetime

import pytest

import __spark_entry__ as E


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """240 lines of 6 parts and 4 suppliers, partly from 1998; one line comes twice, two name an unknown part, one an unknown
    supplier, and of some the keys, the price or the date are null."""
    at = tmp_path_factory.mktemp("tables")
    day = datetime.datetime(1997, 9, 1)
    lines = [[i, 99 if i in (7, 8) else i % 6, 77 if i == 9 else i % 4, i % 3 + 1, float(i % 50 + 1), 1000.0 + i, 0.05, 0.02, "NRA"[i % 3], "OF"[i % 2],
              day + datetime.timedelta(days=i * 7 % 240)] for i in range(240)]
    for i, c in ((11, 0), (12, 1), (13, 2), (14, 5), (15, 10)):
        lines[i][c] = None
    frames = {
        "lineitem": (lines + lines[:1], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                     "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "part": ([(i, f"name {i}", f"Brand#{i}", "LARGE", i, 900.0 + i) for i in range(6)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "supplier": ([(i, f"Supplier#{i}", i % 2, 1.0) for i in range(4)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "nation": ([(i, f"NATION_{i}", 0) for i in range(2)], "n_nationkey int, n_name string, n_regionkey int")}
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(str(at / f"{name}.parquet"))
    return str(at)


def test_alerts_are_filtered_without_repeating_the_scoring(spark, tables):
    """A filter moved below the scoring repeated it in every use of the score: plans of megabytes, which the driver keeps as text."""
    plan = E.queries()["risk_alerts"](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 150_000
    alerts = E.queries()["risk_alerts"](spark, tables).select("event_id", "alert_type", "severity")
    again = E.queries()["risk_alerts_incremental"](spark, tables)
    leaves = again._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert not any("l_orderkey" in leaves.apply(i).output().mkString() for i in range(leaves.size()))  # scored once, for both uses
    from quayline.plans.common import assessed
    dates = {r["event_id"]: r["date"] for r in assessed(spark, tables).select("event_id", "date").collect()}
    old = datetime.date(1998, 1, 1)
    want = {tuple(r) for r in alerts.collect() if dates[r["event_id"]] is None or dates[r["event_id"]] >= old}
    assert want and {tuple(r) for r in again.collect()} == want


def _scans_lines(df):
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum("l_orderkey" in leaves.apply(i).output().mkString() for i in range(leaves.size()))


def test_candidates_share_one_frame_and_one_preprocessing(spark, tables, monkeypatch):
    from pyspark.ml.classification import LogisticRegression
    from quayline.operators import evaluation, model
    fits, scans = [], []
    stages, split = model.preprocessing, evaluation.chronological_split
    monkeypatch.setattr(model, "preprocessing", lambda *a: fits.append(1) or stages(*a))
    monkeypatch.setattr(evaluation, "chronological_split", lambda df, *a: scans.append(_scans_lines(df)) or split(df, *a))
    monkeypatch.setattr(model, "candidates", lambda: {n: LogisticRegression(weightCol="weight", maxIter=3) for n in "abc"})
    rows = E.queries()["model_candidates"](spark, tables).collect()
    assert sorted(r["model"] for r in rows) == ["a", "b", "c"] and len({r["brier"] for r in rows}) == 1
    assert len(fits) == 1  # one a candidate before
    assert scans == [0]  # the split reads its frame three times: it was computed each time before


def test_split_vectors_give_the_model_of_the_whole_pipeline(spark):
    from quayline.operators import model
    rows = [(float(i % 7), float(i % 5) if i % 6 else None, "abc"[i % 3] if i % 8 else None, i % 2) for i in range(200)]
    df = model.prepare(spark.createDataFrame(rows, "n double, m double, category string, y int").coalesce(1), "y", ("category",))
    train = model.class_weights(df)
    whole = model.fit(train, numeric=("n", "m"), categorical=("category",))
    pre = model.fit_preprocessing(train, ("n", "m"), ("category",))
    alone = model.fit_classifier(pre.transform(train).select("label", "weight", "features"))
    assert list(whole.stages[-1].coefficients) == pytest.approx(list(alone.coefficients), abs=1e-9)


@pytest.fixture
def as_on_large_tables(spark):
    from quayline.plans.common import STEPS_CONF
    spark.conf.set(STEPS_CONF, "0")
    yield
    spark.conf.unset(STEPS_CONF)


@pytest.mark.parametrize("name", ["trace_decision", "loop_batch", "risk_service_path"])
def test_steps_give_the_rows_of_one_plan(spark, tables, name):
    from quayline.plans.common import STEPS_CONF
    one = E.queries()[name](spark, tables)
    spark.conf.set(STEPS_CONF, "0")
    try:
        steps = E.queries()[name](spark, tables)
    finally:
        spark.conf.unset(STEPS_CONF)
    assert _scans_lines(steps) < _scans_lines(one)
    assert sorted(map(str, steps.collect())) == sorted(map(str, one.collect()))


def test_shuffle_files_go_with_their_step(spark, tables, as_on_large_tables):
    """What a step shuffled is gone when it ends, and so are steps that nothing reads again."""
    import os
    from quayline.session import SHUFFLE_CLEANUP, discard, materialize
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.endswith(".data")}

    before = shuffled()
    kept = materialize(spark.range(5000).repartition(3).groupBy("id").count())
    assert not shuffled() - before and spark.conf.get(SHUFFLE_CLEANUP) == "false"
    assert kept.count() == 5000
    discard(kept)
    assert not os.path.exists(kept._kept_at)
    assert _scans_lines(E.queries()["opt_inputs"](spark, tables)) == 0  # the joins and windows of the events are steps


def test_audit_reads_strategies_beside_the_checks(spark, tables):
    """Ranked candidates were moved once more to find a decision's strategy, and the decisions twice."""
    out = E.queries()["dec_audit"](spark, tables)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(") == 2


def test_audit_history_by_join_and_beside_are_the_same(spark):
    from quayline.operators import lifecycle
    recs = spark.createDataFrame([("e1", "ALT_A", True, "AIR"), ("e1", "ALT_B", False, "SEC"), ("e2", "ALT_A", True, "AIR"), ("e2", "ALT_A", True, "AIR")],
                                 "event_id string, recommendation_code string, is_recommended boolean, strategy_type string")
    asked = [("d1", "e1", "ALT_B"), ("d2", "e1", "ALT_A"), ("d3", "e2", "ALT_A"), ("d4", "e3", "ALT_A"), ("d5", None, None), ("d6", "e1", None)]
    req = spark.createDataFrame([(*a, "me", "REJECTED", "because of it", f"2024-01-0{9 - i}") for i, a in enumerate(asked)],
                                "decision_id string, event_id string, recommendation_code string, decision_maker string, decision_status string, "
                                "decision_reason string, created_on string")
    keep = ["decision_id", "event_id", "recommendation_code", "created_on"]
    a = lifecycle.audit_history(lifecycle.validate_decisions(req, recs).select(*keep), recs)
    b = lifecycle.audit_history(lifecycle.validate_decisions(req, recs, strategies=True).select(*keep, "chosen"), None)
    assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() == 7
