"""Model evaluation aggregates (E1-E18) and the chronological split (M1).

Curve tables have one row per distinct score; their cumulative sums are distributed prefix sums
over that aggregate, never a window over row-level data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip01, rnd
from ..params import DEFAULT_EVAL, EvalParams
from ..session import materialize
from .scan import exact_quantiles, grouped_cumsum

ERROR_TYPES = ("TP", "TN", "FP", "FN")


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prepare(df: DataFrame, prob: str = "delay_probability", label: str = "delay_occurred") -> DataFrame:
    """Clip scores to [0, 1]; label as int.  Thresholds see the score itself, never a rounded one."""
    return df.withColumn("p", clip01(F.col(prob))).withColumn("y", F.col(label).cast("int"))


def confusion(df: DataFrame, threshold: float) -> list[Column]:
    pred = F.col("p") >= threshold
    y = F.col("y") == 1
    return [F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"),
            F.count_if(~pred & ~y).alias("tn"), F.count_if(~pred & y).alias("fn")]


def metrics_from_counts(x: DataFrame, ep: EvalParams = DEFAULT_EVAL) -> DataFrame:
    """E2/E7 arithmetic on (tp, fp, tn, fn); zero division -> 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    prec = _div(tp, tp + fp)
    rec = _div(tp, tp + fn)
    f1 = _div(prec * rec * 2, prec + rec)
    cost = (fn * ep.fn_cost + fp * ep.fp_cost).cast("double")
    return x.select(
        "*", rnd(_div(tp + tn, n), 6).alias("accuracy"), rnd(prec, 6).alias("precision"), rnd(rec, 6).alias("recall"),
        rnd(f1, 6).alias("f1"), rnd(_div(tn, tn + fp), 6).alias("specificity"), rnd(_div(tp + fn, n), 6).alias("prevalence"),
        cost.alias("total_error_cost"), rnd(_div(cost + tp * ep.tp_cost + tn * ep.tn_cost, n), 4).alias("cost_per_row"))


def classification_metrics(ev: DataFrame, threshold: float = 0.5, ep: EvalParams = DEFAULT_EVAL) -> DataFrame:
    """E1, E2, E5, E7 in one aggregate."""
    x = ev.agg(*confusion(ev, threshold), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("_brier"))
    return metrics_from_counts(x, ep).withColumn("brier", rnd("_brier", 6)).drop("_brier")


def class_report(ev: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per-class precision/recall/F1/support plus macro and weighted averages."""
    c = ev.agg(*confusion(ev, threshold))
    tp, fp, tn, fn = (F.col(k) for k in ("tp", "fp", "tn", "fn"))

    def prf(t, f_p, f_n):
        pr, rc = _div(t, t + f_p), _div(t, t + f_n)
        return pr, rc, _div(pr * rc * 2, pr + rc)

    p1, r1, f1 = prf(tp, fp, fn)
    p0, r0, f0 = prf(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    n = s1 + s0
    rows = [("0", p0, r0, f0, s0), ("1", p1, r1, f1, s1),
            ("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
            ("weighted avg", _div(p0 * s0 + p1 * s1, n), _div(r0 * s0 + r1 * s1, n), _div(f0 * s0 + f1 * s1, n), n)]
    arr = F.array(*[F.struct(F.lit(k).alias("label"), rnd(a, 6).alias("precision"), rnd(b, 6).alias("recall"),
                             rnd(c_, 6).alias("f1"), d.alias("support")) for k, a, b, c_, d in rows])
    return c.select(F.explode(arr).alias("r")).select("r.*")


def score_curve(ev: DataFrame) -> DataFrame:
    """Per distinct score (descending): cumulative TP/FP, TPR, FPR, precision, recall."""
    g = ev.groupBy("p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))
    tot = g.agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    # descending score order == ascending on -p; distributed prefix sum over the distinct scores
    c = grouped_cumsum(g.withColumn("_g", F.lit(0)).withColumn("_np", -F.col("p")), ["_g"], ["_np"], ["pos", "neg"])
    c = c.crossJoin(F.broadcast(tot))
    return c.select("p", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                    _div(F.col("cum_pos"), F.col("_P")).alias("tpr"), _div(F.col("cum_neg"), F.col("_N")).alias("fpr"),
                    _div(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("prec"), "_P", "_N")


def auc_ap(ev: DataFrame) -> DataFrame:
    """Tie-aware ROC-AUC (null with one class), AP = sum (R_n - R_{n-1}) P_n, Brier."""
    c = score_curve(ev)
    P, N = F.col("_P"), F.col("_N")
    x = c.select("*", ((F.col("fpr") - _div(F.col("fp") - F.col("neg"), N))
                       * (F.col("tpr") + _div(F.col("tp") - F.col("pos"), P)) / 2).alias("_auc_t"),
                 (_div(F.col("pos"), P) * F.col("prec")).alias("_ap_t"))
    a = x.agg(F.sum("_auc_t").alias("_auc"), F.sum("_ap_t").alias("_ap"), F.max("_P").alias("_P"), F.max("_N").alias("_N"))
    b = ev.agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("_brier"))
    one_class = (F.col("_P") == 0) | (F.col("_N") == 0)
    return a.crossJoin(b).select(
        F.when(one_class, F.lit(None).cast("double")).otherwise(rnd("_auc", 6)).alias("roc_auc"),
        F.when(one_class, F.lit(0.0)).otherwise(rnd("_ap", 6)).alias("average_precision"),
        rnd("_brier", 6).alias("brier"))


def calibration(ev: DataFrame, n_bins: int = 5) -> DataFrame:
    """Reliability curve on uniform bins with right-closed inner edges (non-empty bins only)."""
    edges = [i / n_bins for i in range(1, n_bins)]
    b = sum((F.col("p") > e).cast("int") for e in edges)
    return ev.groupBy(b.alias("bin")).agg(rnd(F.avg("p"), 6).alias("mean_predicted"),
                                          rnd(F.avg("y"), 6).alias("fraction_positive"),
                                          F.count(F.lit(1)).alias("n"))


def quantile_calibration(ev: DataFrame, n_bins: int = 5) -> DataFrame:
    """E8 on equal-frequency bins: right-closed edges at the exact quantiles of the scores, so equal scores share a
    bin and heavy ties leave bins empty (only non-empty ones are returned).

    Scores are first reduced to (score, rows, positives); the bins are sums over that curve."""
    curve = ev.groupBy("p").agg(F.count(F.lit(1)).alias("_n"), F.sum("y").alias("_y"))
    inner = [i / n_bins for i in range(1, n_bins)]
    edges = exact_quantiles(ev, ["p"], inner).agg(F.array_sort(F.collect_list("quantile")).alias("_e"))  # n_bins - 1 numbers
    bin_ = F.size(F.filter("_e", lambda e: e < F.col("p"))).cast("int")
    x = curve.crossJoin(F.broadcast(edges)).groupBy(bin_.alias("bin")).agg(
        F.sum("_n").alias("n"), F.sum("_y").alias("_pos"), F.sum(F.col("p") * F.col("_n")).alias("_sum"))
    return x.select("bin", rnd(F.col("_sum") / F.col("n"), 6).alias("mean_predicted"),
                    rnd(F.col("_pos") / F.col("n"), 6).alias("fraction_positive"), "n")


def calibration_status(ev: DataFrame) -> DataFrame:
    """(is_calibrated, brier, note): a curve needs both classes."""
    x = ev.agg(F.count_if(F.col("y") == 1).alias("_p"), F.count_if(F.col("y") != 1).alias("_q"),
               F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("_b"))
    both = (F.col("_p") > 0) & (F.col("_q") > 0)
    return x.select(both.alias("is_calibrated"), rnd("_b", 6).alias("brier"),
                    F.when(~both, F.lit("one class only: no curve")).alias("note"))


def bin_counts(ev: DataFrame, n_bins: int = 5) -> DataFrame:
    """Counts per left-closed bin, empty bins filled with 0 (join to a fixed bin list)."""
    spark = ev.sparkSession
    bins = spark.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    c = ev.groupBy(F.least(F.floor(F.col("p") * n_bins), F.lit(n_bins - 1)).cast("int").alias("bin")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(bins).join(c, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def threshold_grid(ev: DataFrame, ep: EvalParams = DEFAULT_EVAL) -> DataFrame:
    """All thresholds in one aggregate pass, then unpivoted (no row explosion)."""
    y = F.col("y") == 1
    aggs = []
    for i, t in enumerate(ep.thresholds):
        pred = F.col("p") >= t
        aggs += [F.count_if(pred & y).alias(f"tp{i}"), F.count_if(pred & ~y).alias(f"fp{i}"),
                 F.count_if(~pred & ~y).alias(f"tn{i}"), F.count_if(~pred & y).alias(f"fn{i}")]
    wide = ev.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"),
                             F.col(f"tn{i}").alias("tn"), F.col(f"fn{i}").alias("fn"))
                    for i, t in enumerate(ep.thresholds)])
    long = wide.select(F.explode(arr).alias("r")).select("r.*")
    return metrics_from_counts(long, ep)


def choose_threshold(grid: DataFrame, by: str = "cost") -> DataFrame:
    """Cost asc, F1 desc, recall desc (or F1 desc, cost asc); ties -> lowest threshold."""
    if by == "cost":
        order = [F.col("total_error_cost"), F.col("f1").desc(), F.col("recall").desc(), F.col("threshold")]
    else:
        order = [F.col("f1").desc(), F.col("total_error_cost"), F.col("threshold")]
    return grid.orderBy(*order).limit(1)


def error_type(threshold: float = 0.5) -> Column:
    pred = F.col("p") >= threshold
    y = F.col("y") == 1
    return (F.when(pred & y, "TP").when(~pred & ~y, "TN").when(pred & ~y, "FP").otherwise("FN"))


def subgroups(ev: DataFrame, cols: list[str], threshold: float = 0.5, min_n: int = 5) -> DataFrame:
    """Per-group metrics for several columns in one GROUPING SETS aggregate."""
    x = ev.select(*[F.col(c).cast("string").alias(c) for c in cols], "p", "y")
    g = x.groupingSets([[c] for c in cols], *cols).agg(
        *confusion(x, threshold), F.count(F.lit(1)).alias("n"),
        *[F.grouping(c).alias(f"_g_{c}") for c in cols])
    col_name = F.lit(None).cast("string")
    val = F.lit(None).cast("string")
    for c in cols:
        col_name = F.when(F.col(f"_g_{c}") == 0, F.lit(c)).otherwise(col_name)
        val = F.when(F.col(f"_g_{c}") == 0, F.col(c)).otherwise(val)
    m = metrics_from_counts(g.select(col_name.alias("group_column"), val.alias("group_value"), "n",
                                     "tp", "fp", "tn", "fn"))
    return m.select("group_column", "group_value", "n", "prevalence", "precision", "recall", "f1", "accuracy",
                    (F.col("n") >= min_n).alias("adequate_sample"))


def prob_histogram(ev: DataFrame, n_bins: int = 20) -> DataFrame:
    """Probability histogram by actual class."""
    return ev.groupBy(F.least(F.floor(F.col("p") * n_bins), F.lit(n_bins - 1)).cast("int").alias("bin"), "y") \
        .agg(F.count(F.lit(1)).alias("n"))


def reliability_tier(col: str = "supplier_reliability") -> Column:
    """Tiers by cut (0, .85, .95, 1.01], right-closed, lowest included."""
    r = F.col(col)
    return F.when(r <= 0.85, "low").when(r <= 0.95, "medium").when(r <= 1.01, "high")


def crosstab(ev: DataFrame, dim: str, threshold: float = 0.5) -> DataFrame:
    """Row-normalised error-type counts per value of ``dim`` (pivot with a fixed value list)."""
    x = ev.select(F.col(dim).cast("string").alias("dim_value"), error_type(threshold).alias("error_type"))
    pv = x.groupBy("dim_value").pivot("error_type", list(ERROR_TYPES)).agg(F.count(F.lit(1)))
    tot = sum(F.coalesce(F.col(t), F.lit(0)) for t in ERROR_TYPES)
    return pv.select(F.lit(dim).alias("dimension"), "dim_value",
                     *[F.coalesce(F.col(t), F.lit(0)).alias(f"n_{t.lower()}") for t in ERROR_TYPES],
                     *[rnd(F.coalesce(F.col(t), F.lit(0)) / tot, 6).alias(f"share_{t.lower()}") for t in ERROR_TYPES])


def five_number_by_error(ev: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Min, quartiles, max of the score per error type (exact, distributed)."""
    # the quantiles read their rows in several passes: score and type are computed once and kept
    x = materialize(ev.select("p", error_type(threshold).alias("et")))
    wide = x.select(*[F.when(F.col("et") == t, F.col("p")).alias(t) for t in ERROR_TYPES])
    q = exact_quantiles(wide, list(ERROR_TYPES), [0.0, 0.25, 0.5, 0.75, 1.0])
    return q.select(F.col("column_name").alias("error_type"), "prob", rnd("quantile", 6).alias("value"))


def chronological_split(df: DataFrame, date_col: str = "date", id_col: str = "event_id",
                        test_share: float = 0.2, val_share: float = 0.2) -> DataFrame:
    """M1: last int(.2 n) rows by (date, id) are test, the int(.2 (n - test)) before them validation.

    Counts per date find the two dates in which the parts change; only the ids of these dates are ranked,
    by a sliced prefix count, which gives two cut keys.  Every other row is compared with the cuts where it is."""
    days = df.groupBy(F.col(date_col).alias("_d")).agg(F.count(F.lit(1)).alias("_k"))
    total = days.agg(F.coalesce(F.sum("_k"), F.lit(0)).alias("_n"))
    n_test = F.greatest(F.lit(1), F.floor(F.col("_n") * test_share))
    n_val = F.greatest(F.lit(1), F.floor((F.col("_n") - n_test) * val_share))
    upto = Window.orderBy(F.asc_nulls_first("_d")).rowsBetween(Window.unboundedPreceding, 0)
    # the calendar bounds this table; its window is one small task
    places = days.withColumn("_cum", F.sum("_k").over(upto)).crossJoin(F.broadcast(total)).select(
        "_d", F.explode(F.array(*[F.struct(F.lit(part).alias("part"), (at - (F.col("_cum") - F.col("_k"))).alias("nth"))
                                  for part, at in (("a", F.col("_n") - n_test - n_val), ("b", F.col("_n") - n_test))])).alias("_p"),
        "_k").select("_d", "_p.part", "_p.nth", "_k").where((F.col("nth") >= 1) & (F.col("nth") <= F.col("_k")))
    places = F.broadcast(places)  # two rows
    inside = df.select(F.col(date_col).alias("_g"), F.col(id_col).alias("_i"))
    inside = inside.join(places.select("_d").distinct(), F.col("_g").eqNullSafe(F.col("_d")), "left_semi")
    ranked = grouped_cumsum(inside.withColumn("_one", F.lit(1)), ["_g"], ["_i"], ["_one"])
    cuts = ranked.join(places, F.col("_g").eqNullSafe(F.col("_d")) & (F.col("cum__one") == F.col("nth"))).agg(*[
        F.max(F.when(F.col("part") == part, F.struct(F.col("_g").alias("d"), F.col("_i").alias("i")))).alias(f"_cut_{part}")
        for part in "ab"])
    key = F.struct(F.col(date_col).alias("d"), F.col(id_col).alias("i"))

    def after(cut):  # no cut: the part before it is empty
        return F.col(cut).isNull() | (key > F.col(cut))

    split = F.when(after("_cut_b"), "test").when(after("_cut_a"), "validation").otherwise("train")
    return df.crossJoin(F.broadcast(cuts)).withColumn("split", split).drop("_cut_a", "_cut_b")
