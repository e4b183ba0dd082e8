"""The steps that the allocation and ranking queries share, on rows of their own: what is sampled, sorted and copied."""

import datetime

import pytest

import __spark_entry__ as E


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """60 lines of 5 parts and 4 suppliers; the first line comes twice, two others name an unknown part."""
    at = tmp_path_factory.mktemp("tables")
    day = datetime.datetime(1996, 1, 1)
    lines = [(i, 99 if i in (7, 8) else i % 5, i % 4, i % 3 + 1, float(i % 50 + 1), 1000.0 + i, 0.05, 0.02, "NRA"[i % 3], "OF"[i % 2],
              day + datetime.timedelta(days=i * 7 % 40)) for i in range(60)]
    frames = {
        "lineitem": (lines + lines[:1], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                     "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "part": ([(i, f"name {i}", f"Brand#{i}", "LARGE", i, 900.0 + i) for i in range(5)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "supplier": ([(i, f"Supplier#{i}", i % 2, 1.0) for i in range(4)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "nation": ([(i, f"NATION_{i}", 0) for i in range(2)], "n_nationkey int, n_name string, n_regionkey int")}
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(str(at / f"{name}.parquet"))
    return str(at), lines


def _plan(spark, df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


@pytest.fixture
def as_on_large_tables(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["opt_allocation_learned", "trace_decision", "opt_allocation_min_delay", "rec_rank_min_delay",
                                  "opt_allocation_min_cost"])
def test_ids_are_sorted_by_a_hash_and_samples_read_keys(spark, tables, as_on_large_tables, name):
    plan = _plan(spark, E.queries()[name](spark, tables[0]))
    sorts = [line for line in plan if " Sort [" in line]
    assert any("Sort [_id_hash" in line for line in sorts)
    assert not any("Sort [event_id" in line or "Sort [outcome_id" in line for line in sorts)
    samples = [(line, below) for line, below in zip(plan, plan[1:]) if "TakeOrderedAndProject" in line]
    assert sum("xxhash64(l_orderkey" in line for line, _ in samples) == 2
    # the as-of join cuts by the sampled keys, not by a sample of the joined union of both sides
    assert all("xxhash64(l_orderkey" in line or "explode([0,1])" in below for line, below in samples)
    assert not any("WindowGroupLimit" in line for line in plan)  # sorts all rows once more, for keys of one row


@pytest.mark.parametrize("name", ["dec_validate", "src_append_assessments", "loop_batch", "risk_service_path", "trace_decision"])
def test_joins_by_event_keep_one_partitioning(spark, tables, as_on_large_tables, name):
    """What is joined by (hash, id) is not moved again for a join by the id alone."""
    plan = _plan(spark, E.queries()[name](spark, tables[0]))
    moved = [line for line in plan if "Exchange hashpartitioning(" in line]
    assert any("hashpartitioning(_id_hash" in line for line in moved)
    assert not any("hashpartitioning(event_id" in line or "hashpartitioning(outcome_id" in line for line in moved)


def test_stock_and_prediction_of_every_event(spark, tables):
    sf, lines = tables
    known = [x for x in lines if x[1] != 99]
    ident = lambda x: f"EVT_{x[0]}_{x[3]}_{x[1]}_{x[2]}_{int(x[4])}"
    got = {r["event_id"]: r for r in E.queries()["opt_inputs"](spark, sf).collect()}
    assert set(got) == {ident(x) for x in known}
    for x in known:
        held = [(-s[10].toordinal(), ident(s), (s[1] * 131 + s[0] * 17) % 2001 - int(s[4]) * 10)
                for s in lines if s[1] == x[1] and s[10] <= x[10]]
        assert got[ident(x)]["available_inventory"] == min(held)[2]
    traced = {r["event_id"]: r for r in E.queries()["trace_decision"](spark, sf).collect()}
    assert set(traced) == {ident(x) for x in lines}
    for x in lines:
        assert (traced[ident(x)]["delay_probability"] is None) == (x[1] == 99)
        assert traced[ident(x)]["product_id"] == (None if x[1] == 99 else f"Brand#{x[1]}")


def test_solve_copies_rows_once_between_its_stages(spark):
    from pyspark.sql import functions as F
    from quayline.operators import allocation
    rows = [(i, f"e{i}", 100 * i % 700, i * 37 % 300, 10.0 + i, 500.0, 300, 200, 1000, 0.1, None if i % 3 else 900.0, float(i % 9), 0.3, 1.0, 1.0)
            for i in range(40)]
    inp = spark.createDataFrame(rows, "n int, event_id string, demand_units long, available_inventory long, unit_cost double, "
                                "base_transport_cost double, primary_capacity long, secondary_capacity long, air_capacity long, premium_rate "
                                "double, air_base_cost double, predicted_delay_days double, composite_risk double, air_multiplier double, "
                                "secondary_multiplier double").repartition(6, "n")
    passed = allocation.pass_rows(inp.withColumn("at", F.spark_partition_id())).withColumn("now", F.spark_partition_id())
    pairs = {(r["at"], r["now"]) for r in passed.collect()}  # partitions stay whole, whatever their order
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) > 1 and passed.count() == 40
    out = allocation.solve(inp, "MIN_COST")
    assert sum("Generate" in line for line in _plan(spark, out)) == 1
    assert out.count() == 40


def test_gate_keeps_the_first_request(spark):
    from quayline.operators import outcomes
    rows = [("a", "2024-01-02", "COMPLETED", 1), ("a", "2024-01-01", "COMPLETED", 2), ("a", None, "IN_PROGRESS", 3),
            ("b", "2024-01-05", "COMPLETED", 4), ("c", "2024-01-05", "IN_PROGRESS", 5), (None, "2024-01-05", "COMPLETED", 6)]
    df = spark.createDataFrame(rows, "outcome_id string, evaluation_date string, execution_status string, n int")
    out = outcomes.gate(df)
    assert {r["n"] for r in out.collect()} == {2, 4, 6}
    assert not any("WindowGroupLimit" in line for line in _plan(spark, out))
