"""Model evaluation queries (E1-E18, M1) on the fixture score vs the observed delay."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as EV
from ..params import DEFAULT_EVAL
from ..sources.fixtures_sql import with_ctes
from . import sqlbase as S
from .common import events, latest_predictions
from .registry import register

R, RS = S.R, S.RS


def eval_base(spark, sf_dir):
    ev = events(spark, sf_dir)
    pred = latest_predictions(spark, sf_dir, ev).select("event_id", "delay_probability")
    x = ev.join(pred, "event_id").withColumn("shortage", (F.col("inventory_units") < F.col("demand_units")).cast("int"))
    return EV.prepare(x)


_BASE = with_ctes("supply_events", "predictions", extra=[("latest_pred", S.LATEST_PRED), ("ev", f"""
SELECT e.*, CAST(e.inventory_units < e.demand_units AS INTEGER) AS shortage,
       {S.clip('p.delay_probability')} AS p, CAST(e.delay_occurred AS INTEGER) AS y
FROM supply_events e JOIN latest_pred p USING (event_id)""")])


def _div(a, b):
    return f"(CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0.0 END)"


def _metrics_sql(src: str, extra_cols: str = "") -> str:
    prec = _div("tp", "tp + fp")
    rec = _div("tp", "tp + fn")
    f1 = _div(f"{prec} * {rec} * 2", f"{prec} + {rec}")
    return f"""SELECT {extra_cols} tp, fp, tn, fn,
      {R(_div('tp + tn', 'tp + fp + tn + fn'), 6)} AS accuracy, {R(prec, 6)} AS precision, {R(rec, 6)} AS recall,
      {R(f1, 6)} AS f1, {R(_div('tn', 'tn + fp'), 6)} AS specificity, {R(_div('tp + fn', 'tp + fp + tn + fn'), 6)} AS prevalence,
      CAST(fn * {DEFAULT_EVAL.fn_cost!r} + fp * {DEFAULT_EVAL.fp_cost!r} AS DOUBLE) AS total_error_cost,
      {R(_div(f'fn * {DEFAULT_EVAL.fn_cost!r} + fp * {DEFAULT_EVAL.fp_cost!r} + tp * 0.0 + tn * 0.0', 'tp + fp + tn + fn'), 4)}
        AS cost_per_row
    FROM {src}"""


def _conf(t: float) -> str:
    return (f"count(*) FILTER (WHERE p >= {t!r} AND y = 1) AS tp, count(*) FILTER (WHERE p >= {t!r} AND y <> 1) AS fp, "
            f"count(*) FILTER (WHERE p < {t!r} AND y <> 1) AS tn, count(*) FILTER (WHERE p < {t!r} AND y = 1) AS fn")


@register("eval_metrics", _BASE + f", c AS (SELECT {_conf(0.5)}, avg(pow(p - y, 2)) AS b FROM ev) "
          + _metrics_sql("c").replace("SELECT  tp,", f"SELECT tp,").replace(" AS cost_per_row", f" AS cost_per_row, {R('b', 6)} AS brier"))
def eval_metrics(spark, sf_dir):
    """E1, E2, E5, E7 at threshold 0.50."""
    return EV.classification_metrics(eval_base(spark, sf_dir), 0.5)


@register("eval_class_report", _BASE + f"""
, c AS (SELECT {_conf(0.5)} FROM ev),
m AS (SELECT {_div('tp', 'tp + fp')} AS p1, {_div('tp', 'tp + fn')} AS r1, {_div('tn', 'tn + fn')} AS p0,
             {_div('tn', 'tn + fp')} AS r0, tp + fn AS s1, tn + fp AS s0 FROM c),
f AS (SELECT *, {_div('p1 * r1 * 2', 'p1 + r1')} AS f1, {_div('p0 * r0 * 2', 'p0 + r0')} AS f0, s0 + s1 AS n FROM m)
SELECT '0' AS label, {R('p0', 6)} AS precision, {R('r0', 6)} AS recall, {R('f0', 6)} AS f1, s0 AS support FROM f
UNION ALL SELECT '1', {R('p1', 6)}, {R('r1', 6)}, {R('f1', 6)}, s1 FROM f
UNION ALL SELECT 'macro avg', {R('(p0 + p1) / 2', 6)}, {R('(r0 + r1) / 2', 6)}, {R('(f0 + f1) / 2', 6)}, n FROM f
UNION ALL SELECT 'weighted avg', {R(_div('p0 * s0 + p1 * s1', 'n'), 6)}, {R(_div('r0 * s0 + r1 * s1', 'n'), 6)},
                 {R(_div('f0 * s0 + f1 * s1', 'n'), 6)}, n FROM f
""")
def eval_class_report(spark, sf_dir):
    """Per-class report with macro and weighted averages."""
    return EV.class_report(eval_base(spark, sf_dir), 0.5)


_CURVE = """
, g AS (SELECT p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM ev GROUP BY p),
cu AS (SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp,
              sum(pos) OVER () AS P_, sum(neg) OVER () AS N_ FROM g)
"""


@register("eval_auc_ap_brier", _BASE + _CURVE + f"""
, t AS (SELECT sum((fp / N_ - (fp - neg) / N_) * (tp / P_ + (tp - pos) / P_) / 2) AS auc,
               sum((pos / P_) * (tp / (tp + fp))) AS ap, max(P_) AS P_, max(N_) AS N_ FROM cu)
SELECT CASE WHEN P_ = 0 OR N_ = 0 THEN NULL ELSE {R('auc', 6)} END AS roc_auc,
       CASE WHEN P_ = 0 OR N_ = 0 THEN 0.0 ELSE {R('ap', 6)} END AS average_precision,
       (SELECT {R('avg(pow(p - y, 2))', 6)} FROM ev) AS brier
FROM t
""")
def eval_auc_ap_brier(spark, sf_dir):
    """ROC-AUC, average precision and Brier score."""
    return EV.auc_ap(eval_base(spark, sf_dir))


@register("eval_curves", _BASE + _CURVE + f"""
SELECT p AS score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, {R('tp / P_', 6)} AS tpr, {R('fp / N_', 6)} AS fpr, {R('tp / (tp + fp)', 6)} AS precision,
       {R('tp / P_', 6)} AS recall FROM cu
""")
def eval_curves(spark, sf_dir):
    """ROC and PR curve points per distinct score."""
    c = EV.score_curve(eval_base(spark, sf_dir))
    return c.select(F.col("p").alias("score"), "tp", "fp", rnd6("tpr"), rnd6("fpr"), rnd6("prec", "precision"),
                    rnd6("tpr", "recall"))


def rnd6(c, alias=None):
    from ..functions.numeric import rnd
    return rnd(c, 6).alias(alias or c)


@register("eval_calibration", _BASE + f"""
SELECT CAST((p > 0.2)::INT + (p > 0.4)::INT + (p > 0.6)::INT + (p > 0.8)::INT AS INTEGER) AS bin,
       {R('avg(p)', 6)} AS mean_predicted, {R('avg(y)', 6)} AS fraction_positive, count(*) AS n
FROM ev GROUP BY 1
""")
def eval_calibration(spark, sf_dir):
    """Reliability curve (5 uniform bins, right-closed inner edges)."""
    return EV.calibration(eval_base(spark, sf_dir), 5)


@register("eval_calibration_quantile", _BASE + f"""
, tied AS (SELECT floor(p * 20 + 0.5) / 20 AS p, y FROM ev),
e AS (SELECT unnest(quantile_cont(p, [0.2, 0.4, 0.6, 0.8])) AS e FROM tied),
b AS (SELECT p, y, (SELECT count(*) FROM e WHERE e.e < tied.p) AS bin FROM tied)
SELECT CAST(bin AS INTEGER) AS bin, {R('sum(p) / count(*)', 6)} AS mean_predicted, {R('avg(y)', 6)} AS fraction_positive,
       count(*) AS n FROM b GROUP BY bin
""")
def eval_calibration_quantile(spark, sf_dir):
    """Reliability curve on five equal-frequency bins of scores with heavy ties (steps of 0.05)."""
    tied = eval_base(spark, sf_dir).withColumn("p", F.floor(F.col("p") * 20 + 0.5) / 20)
    return EV.quantile_calibration(tied, 5)


@register("eval_calibration_status", _BASE + f"""
SELECT count(DISTINCT y) = 2 AS is_calibrated, {R('avg((p - y) * (p - y))', 6)} AS brier, CAST(NULL AS VARCHAR) AS note FROM ev
""")
def eval_calibration_status(spark, sf_dir):
    """Whether a calibration curve exists, the Brier score and the one-class note."""
    return EV.calibration_status(eval_base(spark, sf_dir))


@register("eval_bin_counts", _BASE + """
, b AS (SELECT CAST(range AS INTEGER) AS bin FROM range(5)),
c AS (SELECT CAST(least(floor(p * 5), 4) AS INTEGER) AS bin, count(*) AS n FROM ev GROUP BY 1)
SELECT b.bin, coalesce(c.n, 0) AS n FROM b LEFT JOIN c USING (bin)
""")
def eval_bin_counts(spark, sf_dir):
    """Counts per left-closed bin, empty bins as 0."""
    return EV.bin_counts(eval_base(spark, sf_dir), 5)


_GRID_SQL = ", grid AS (" + " UNION ALL ".join(
    f"SELECT CAST({t!r} AS DOUBLE) AS threshold, {_conf(t)} FROM {{src}}" for t in DEFAULT_EVAL.thresholds) + ")"


@register("eval_threshold_grid", _BASE + _GRID_SQL.format(src="ev") + ", gm AS (" + _metrics_sql("grid", "threshold,")
          + ") SELECT * FROM gm")
def eval_threshold_grid(spark, sf_dir):
    """17-threshold grid in one aggregate pass."""
    return EV.threshold_grid(eval_base(spark, sf_dir))


_SPLIT_SQL = """
, sp AS (SELECT *, row_number() OVER (ORDER BY date, event_id) AS rk, count(*) OVER () AS n FROM ev),
sp2 AS (SELECT *, greatest(1, floor(n * 0.2)) AS n_test FROM sp),
sp3 AS (SELECT *, greatest(1, floor((n - n_test) * 0.2)) AS n_val FROM sp2),
spl AS (SELECT *, CASE WHEN rk > n - n_test THEN 'test' WHEN rk > n - n_test - n_val THEN 'validation'
                       ELSE 'train' END AS split FROM sp3),
val AS (SELECT * FROM spl WHERE split = 'validation')
"""


@register("split_chronological", _BASE + _SPLIT_SQL + "SELECT event_id, split FROM spl")
def split_chronological(spark, sf_dir):
    """M1: chronological train / validation / test split (range-partitioned global rank)."""
    return EV.chronological_split(eval_base(spark, sf_dir)).select("event_id", "split")


@register("eval_threshold_choice", _BASE + _SPLIT_SQL + _GRID_SQL.format(src="val") + ", gm AS ("
          + _metrics_sql("grid", "threshold,") + """)
SELECT * FROM gm ORDER BY total_error_cost, f1 DESC, recall DESC, threshold LIMIT 1""")
def eval_threshold_choice(spark, sf_dir):
    """Threshold chosen on the validation split only (cost, then F1, then recall)."""
    s = EV.chronological_split(eval_base(spark, sf_dir)).filter(F.col("split") == "validation")
    return EV.choose_threshold(EV.threshold_grid(s), "cost")


@register("eval_error_audit", _BASE + """
SELECT event_id, y AS actual, p AS probability,
       CASE WHEN p >= 0.5 AND y = 1 THEN 'TP' WHEN p < 0.5 AND y <> 1 THEN 'TN'
            WHEN p >= 0.5 AND y <> 1 THEN 'FP' ELSE 'FN' END AS error_type,
       (p >= 0.5) = (y = 1) AS is_correct, supplier_id, category
FROM ev
""")
def eval_error_audit(spark, sf_dir):
    """Record-level audit."""
    e = eval_base(spark, sf_dir)
    return e.select("event_id", F.col("y").alias("actual"), F.col("p").alias("probability"),
                    EV.error_type(0.5).alias("error_type"), ((F.col("p") >= 0.5) == (F.col("y") == 1)).alias("is_correct"),
                    "supplier_id", "category")


_SUB_COLS = ("category", "supplier_country", "criticality_level", "service_risk")


@register("eval_subgroups", _BASE + ", sg AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS group_column, CAST({c} AS VARCHAR) AS group_value, count(*) AS n, {_conf(0.5)} FROM ev GROUP BY {c}"
    for c in _SUB_COLS) + "), sm AS (" + _metrics_sql("sg", "group_column, group_value, n,") + """)
SELECT group_column, group_value, n, prevalence, precision, recall, f1, accuracy, n >= 5 AS adequate_sample FROM sm
""")
def eval_subgroups(spark, sf_dir):
    """Subgroup metrics for four columns via GROUPING SETS."""
    return EV.subgroups(eval_base(spark, sf_dir), list(_SUB_COLS), 0.5, DEFAULT_EVAL.min_subgroup)


@register("eval_prob_hist", _BASE + """
SELECT CAST(least(floor(p * 20), 19) AS INTEGER) AS bin, y, count(*) AS n FROM ev GROUP BY 1, 2
""")
def eval_prob_hist(spark, sf_dir):
    """20-bin probability histogram by actual class."""
    return EV.prob_histogram(eval_base(spark, sf_dir), 20)


def _ct_sql(dim_expr: str, dim: str) -> str:
    et = ("CASE WHEN p >= 0.5 AND y = 1 THEN 'TP' WHEN p < 0.5 AND y <> 1 THEN 'TN' "
          "WHEN p >= 0.5 AND y <> 1 THEN 'FP' ELSE 'FN' END")
    cnt = ", ".join(f"count(*) FILTER (WHERE {et} = '{t}') AS n_{t.lower()}" for t in EV.ERROR_TYPES)
    shares = ", ".join(f"{R(f'n_{t.lower()} / (n_tp + n_tn + n_fp + n_fn)', 6)} AS share_{t.lower()}"
                       for t in EV.ERROR_TYPES)
    return (f"SELECT '{dim}' AS dimension, dim_value, n_tp, n_tn, n_fp, n_fn, {shares} FROM "
            f"(SELECT CAST({dim_expr} AS VARCHAR) AS dim_value, {cnt} FROM ev GROUP BY 1) t")


_TIER = "CASE WHEN supplier_reliability <= 0.85 THEN 'low' WHEN supplier_reliability <= 0.95 THEN 'medium' " \
        "WHEN supplier_reliability <= 1.01 THEN 'high' END"


@register("eval_crosstab", _BASE + " " + " UNION ALL ".join([
    _ct_sql("category", "category"), _ct_sql(_TIER, "reliability_tier"), _ct_sql("shortage", "shortage")]))
def eval_crosstab(spark, sf_dir):
    """Row-normalised error types by category, reliability tier and shortage status."""
    e = eval_base(spark, sf_dir).withColumn("reliability_tier", EV.reliability_tier())
    return (EV.crosstab(e, "category").unionByName(EV.crosstab(e, "reliability_tier"))
            .unionByName(EV.crosstab(e, "shortage")))


@register("eval_prob_summary", _BASE + ", et AS (SELECT p, CASE WHEN p >= 0.5 AND y = 1 THEN 'TP' "
          "WHEN p < 0.5 AND y <> 1 THEN 'TN' WHEN p >= 0.5 AND y <> 1 THEN 'FP' ELSE 'FN' END AS error_type FROM ev) "
          + " UNION ALL ".join(f"SELECT error_type, CAST({q!r} AS DOUBLE) AS prob, {R(f'quantile_cont(p, {q!r})', 6)} AS value "
                               f"FROM et GROUP BY error_type" for q in (0.0, 0.25, 0.5, 0.75, 1.0)))
def eval_prob_summary(spark, sf_dir):
    """Five-number summary of the score per error type."""
    return EV.five_number_by_error(eval_base(spark, sf_dir), 0.5)
