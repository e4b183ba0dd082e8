"""Registered queries run on sf0.001, the entry point works, and hot plans stay JVM-side."""

import __spark_entry__ as E

from small_tables import SF


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["supplier_id", "risk_level", "n_events", "mean_composite"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_no_python_udf_in_hot_plans(spark):
    qs = E.queries()
    for name in ("risk_scores", "opt_allocation_balanced", "dec_lifecycle", "learn_ewma"):
        plan = qs[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_pushdown_and_pruning(spark):
    from quayline.sources.tables import read_table
    from pyspark.sql import functions as F
    df = read_table(spark, SF, "lineitem", ["l_orderkey", "l_quantity"]).filter(F.col("l_quantity") > 10)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_stream_equals_batch(spark):
    qs = E.queries()
    s = {tuple(r) for r in qs["stream_lifecycle"](spark, SF).collect()}
    b = {tuple(r) for r in qs["dec_lifecycle"](spark, SF).collect()}
    assert s == b
    sm = {r["strategy_type"]: r["multiplier"] for r in qs["stream_multiplier"](spark, SF).collect()}
    bm = {r["strategy_type"]: r["multiplier"] for r in qs["learn_ewma"](spark, SF).collect()}
    assert sm == bm
    sa = {tuple(r) for r in qs["stream_alert_dedup"](spark, SF).collect()}
    ba = {tuple(r) for r in qs["risk_alerts"](spark, SF).select("event_id", "alert_type", "severity").collect()}
    assert sa == ba
    from pyspark.sql import functions as F
    st = {tuple(r) for r in qs["stream_risk_windows"](spark, SF).select(
        F.to_date("window_start").alias("d"), "risk_level", "n_events").collect()}
    from quayline.plans.common import assessed
    bt = {tuple(r) for r in assessed(spark, SF).groupBy("date", "risk_level").count().collect()}
    assert st == bt


def test_streams_resume_from_their_folder(spark, tmp_path):
    from quayline.sources import fixtures
    from quayline.streaming import jobs
    from quayline.operators import lifecycle
    log = fixtures.lifecycle_log(spark, SF).cache()
    cut = log.selectExpr("percentile(unix_timestamp(ts), 0.5) as t").first().t
    jobs.lifecycle_stream(spark, log.where(f"unix_timestamp(ts) <= {cut}"), root=str(tmp_path / "a"))
    again = jobs.lifecycle_stream(spark, log.where(f"unix_timestamp(ts) > {cut}"), root=str(tmp_path / "a"))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in lifecycle.fold_lifecycle(log).collect()}
    log.unpersist()


def test_streams_compute_their_inputs_once(spark, tmp_path):
    import datetime
    from pyspark.sql import functions as F
    from quayline.plans.stream_q import RISK_COLUMNS
    from quayline.operators import risk
    from quayline.streaming import jobs
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(f"e{i}", i % 100 / 100, 0.5 + i % 50 / 100, i % 90 / 100, i % 30 / 10, i % 40, 10, 50, 0.2, "HIGH", i % 2) for i in range(90)]
    inputs = spark.createDataFrame(rows, list(RISK_COLUMNS))
    start = datetime.datetime(1997, 1, 1)
    arrivals = spark.createDataFrame([(f"e{i}", start + datetime.timedelta(hours=i)) for i in range(90)], "event_id string, arrival_ts timestamp")
    out = jobs.risk_stream(spark, arrivals, inputs.mapInArrow(counted, inputs.schema), root=str(tmp_path / "r"), chunks=3)
    got = {tuple(r) for r in out.collect()}
    assert seen.value == 90  # once, not once per batch
    batch = risk.assess(inputs.join(arrivals, "event_id")).groupBy(F.date_trunc("day", "arrival_ts").alias("d"), "risk_level").count()
    assert got == {tuple(r) for r in batch.collect()}
    assert len(list((tmp_path / "r" / "ck" / "commits").glob("[0-9]*"))) == 3
    seen.value = 0
    alerts = arrivals.select("event_id", F.lit("A").alias("alert_type"), F.lit("HIGH").alias("severity"), F.col("arrival_ts").alias("alert_ts"))
    both = alerts.unionByName(alerts).coalesce(1)
    assert jobs.dedup_alerts_stream(spark, both.mapInArrow(counted, both.schema)).count() == 90 and seen.value == 180
    files = jobs.stage_in_time_order(arrivals, str(tmp_path / "s"), ["arrival_ts"], rows_per_chunk=10, chunks=3)
    assert files == 3 and len(list((tmp_path / "s_staged" / "load=000000").glob("part-*"))) == 9


def test_generated_methods_are_short_enough_for_the_jit(spark):
    """HotSpot interprets methods above 8,000 bytes, which took most of the time of these queries."""
    qs = E.queries()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")  # joins as on large tables
    try:
        for name in ("opt_allocation_min_delay", "opt_allocation_balanced", "opt_forced", "rec_rank_balanced", "rec_rank_min_risk",
                     "rec_comparison", "rec_explanations", "trace_decision", "loop_batch", "risk_service_path"):
            stages = qs[name](spark, SF)._jdf.queryExecution().debug().codegenToSeq()
            sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
            assert sizes and 0 < min(sizes) and max(sizes) <= 8000, (name, max(sizes))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shared_inputs_are_computed_once(spark):
    from quayline.plans.common import latest_predictions
    qs = E.queries()

    def relations(df):
        plan = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum("l_orderkey" in plan.apply(i).output().mkString() for i in range(plan.size()))

    assert relations(latest_predictions(spark, SF)) == 1  # a scan a version before
    assert relations(qs["dec_audit"](spark, SF)) == 1  # only the requests: the ranked candidates are kept


def test_error_type_quantiles_compute_their_rows_once(spark):
    from pyspark.sql import functions as F
    from quayline.operators.evaluation import five_number_by_error
    rows = spark.range(0, 400, 1, 4).select((F.col("id") / 400).alias("p"), (F.col("id") % 2).cast("int").alias("y"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    out = five_number_by_error(rows.mapInArrow(count, "p double, y int")).collect()
    assert {(r["error_type"], r["prob"]): r["value"] for r in out}[("TP", 1.0)] == 0.9975
    assert len(out) == 20 and seen.value == 400
