"""Distributed prefix sums and exact quantiles against brute force."""

import random

import numpy as np

from quayline.operators.scan import exact_quantiles, grouped_cumsum


def _rows(seed=7):
    rnd = random.Random(seed)
    rows = []
    # group "a" holds about a third of all rows (hot group), "b" and "c" the rest
    for i in range(3000):
        g = "a" if i % 3 == 0 else rnd.choice("bc")
        rows.append((g, i, rnd.randint(0, 9), round(rnd.lognormvariate(0, 2), 3)))
    return rows


def test_grouped_cumsum_matches_sequential(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "g string, k long, v long, x double").repartition(13)
    got = {(r["g"], r["k"]): r["cum_v"] for r in grouped_cumsum(df, ["g"], ["k"], ["v"], slices=16).collect()}
    want, run = {}, {}
    for g, k, v, _ in sorted(rows, key=lambda t: (t[0], t[1])):
        run[g] = run.get(g, 0) + v
        want[(g, k)] = run[g]
    assert got == want


def test_exact_quantiles_match_numpy(spark):
    rows = _rows(11)
    df = spark.createDataFrame(rows, "g string, k long, v long, x double").repartition(9)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {(r["g"], r["prob"]): r["quantile"] for r in exact_quantiles(df, ["x"], probs, by=["g"]).collect()}
    for g in "abc":
        xs = np.array([x for gg, _, _, x in rows if gg == g])
        for p in probs:
            assert abs(got[(g, p)] - float(np.quantile(xs, p))) < 1e-9, (g, p)


def test_grouped_last_matches_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from quayline.operators.scan import grouped_last
    rnd = random.Random(5)
    rows = []
    for i in range(4000):
        g = "hot" if i % 3 == 0 else f"k{rnd.randint(0, 40)}"
        v = rnd.randint(0, 99) if rnd.random() < 0.3 else None
        rows.append((g, rnd.randint(0, 500), i, v))
    df = spark.createDataFrame(rows, "g string, d int, i int, v int").repartition(7)
    order = ["d", "j"]
    df = df.withColumn("j", -F.col("i"))
    got = {r["i"]: r["lv"] for r in grouped_last(df, ["g"], order, "v", "lv", slices=16).collect()}
    w = Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    want = {r["i"]: r["lv"] for r in df.select("i", F.last("v", ignorenulls=True).over(w).alias("lv")).collect()}
    assert got == want


def test_quantiles_through_every_round(spark):
    """Tiny sketches and gather limits force missed brackets, narrowing rounds and ties."""
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), float(i % 7), rnd.gauss(0, 1), None if i % 5 else float(i), -1.5) for i in range(6000)]
    rows += [("n", None, None, None, None)]
    df = spark.createDataFrame(rows, "g string, few double, many double, holes double, one double").repartition(5)
    cols, probs = ["few", "many", "holes", "one"], [0.0, 0.01, 0.25, 0.5, 0.98, 1.0]
    for kw in ({"sketch_k": 8, "margin": 0.0001, "gather": 40}, {}):
        got = {(r.column_name, r.prob): r.quantile for r in exact_quantiles(df, cols, probs, **kw).collect()}
        for j, c in enumerate(cols, 1):
            xs = np.array([r[j] for r in rows if r[j] is not None])
            for p in probs:
                assert abs(got[c, p] - float(np.quantile(xs, p))) < 1e-9, (kw, c, p)
    by = {(r.column_name, r.g, r.prob): r.quantile
          for r in exact_quantiles(df, ["many", "few"], probs, by=["g"], sketch_k=8).collect()}
    for g in "ab":
        xs = np.array([r[2] for r in rows if r[0] == g])
        assert all(abs(by["many", g, p] - float(np.quantile(xs, p))) < 1e-9 for p in probs)
    assert not any(k[1] == "n" for k in by)


def test_hot_pair_history_equals_plain_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from quayline.operators import features
    from quayline.operators.slices import SLICE, cut
    rnd = random.Random(9)
    rows = [("s" if i % 2 else f"s{rnd.randint(0, 9)}", "p" if i % 2 else rnd.choice("pq"), rnd.randint(0, 3) if i % 2 else rnd.randint(0, 40),
             f"e{i:05d}", rnd.randint(0, 9), rnd.randint(0, 1), rnd.randint(1, 99), rnd.randint(0, 99)) for i in range(4000)]
    rows += [(None, "p", i % 2, f"n{i:04d}", 1, 1, 5, 5) for i in range(900)]
    df = spark.createDataFrame(rows, "supplier_id string, product_id string, date int, event_id string, delay_days int, "
                                     "delay_occurred int, demand_units int, inventory_units int").repartition(6)
    w = Window.partitionBy("supplier_id", "product_id").orderBy("date", "event_id")
    want = {r.event_id: (r.a or 0, r.b, r.c) for r in df.select(
        "event_id", F.lag("delay_days").over(w).alias("a"), F.avg("demand_units").over(w.rowsBetween(-4, -1)).alias("b"),
        F.count("event_id").over(w.rowsBetween(-4, -1)).alias("c")).collect()}
    got = features.history_features(df, slices=12).collect()
    assert len(got) == len(rows)
    for r in got:
        a, b, c = want[r.event_id]
        assert r.previous_delay_days == a, r
        assert abs(r.rolling_average_demand - (b if c else r.demand_units)) <= 0.051, (r, b)
    sizes = [r["count"] for r in cut(df, ["supplier_id", "product_id"], ["date", "event_id"], 12).rows
             .groupBy("supplier_id", "product_id", SLICE).count().collect()]
    assert max(sizes) <= 3 * len(rows) / 12
    rate = {r.event_id: r.historical_delay_rate for r in features.supplier_past_delay_rate(df, slices=12).collect()}
    ws = Window.partitionBy("supplier_id").orderBy("date", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    for r in df.select("event_id", F.avg("delay_occurred").over(ws).alias("m")).collect():
        assert abs(rate[r.event_id] - (r.m or 0)) <= 0.00005001


def test_asof_last_needs_no_grouping_and_one_sample(spark):
    """The newest snapshot up to a date, of one day the lowest id; a hot key is cut, and its bounds are sampled once."""
    from quayline.operators import relational
    rnd = random.Random(11)
    keys = [None, *("hot" if i % 2 else f"k{i % 7}" for i in range(900))]
    left = [(f"e{i:04d}", k, rnd.choice([None, *range(60)])) for i, k in enumerate(keys)]
    right = [(f"s{i:04d}" if i % 31 else None, k, rnd.choice([None, *range(60)]), rnd.choice([None, *range(99)]))
             for i, k in enumerate(keys + keys)]
    le = spark.createDataFrame(left, "id string, k string, d int").repartition(5)
    ri = spark.createDataFrame(right, "sid string, sk string, sd int, v int").repartition(7)
    out = relational.asof_last(le, ri, "k", "sk", "d", "sd", "sid", "v", "id", "last")
    day = lambda d: -1 if d is None else d
    want = {}
    for i, k, d in left:
        held = [(-day(sd), sid, v) for sid, sk, sd, v in right
                if sk == k and sid is not None and v is not None and day(sd) <= day(d)]
        want[i] = min(held)[2] if held else None
    assert {r["id"]: r["last"] for r in out.collect()} == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = relational.asof_last(le, ri, "k", "sk", "d", "sd", "sid", "v", "id", "last")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("TakeOrderedAndProject") == 1
    # snapshots are grouped only where they lie in slices of heavy keys, behind the broadcast bounds
    assert all("_slice" in line for line in plan.splitlines() if "SortAggregate" in line), plan


def test_event_key_sample_takes_keys_before_texts(spark, tmp_path):
    from quayline.sources import fixtures
    rows = [(i, i % 9, i % 4, i % 3, float(i % 50), 1.0, 0.0, 0.0, "N", "O", f"1996-01-{i % 28 + 1:02d} 00:00:00") for i in range(300)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice "
                          "double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string") \
        .selectExpr("* except (l_shipdate)", "cast(l_shipdate as timestamp) as l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    sample = fixtures.event_key_sample(spark, str(tmp_path), 40)
    got = {tuple(r) for r in sample.collect()}
    every = {(f"EVT_{r[0]}_{r[3]}_{r[1]}_{r[2]}_{int(r[4])}", r[10][:10], r[2]) for r in rows}
    assert len(got) == 40 and {(i, str(d), s) for i, d, s in got} <= every
