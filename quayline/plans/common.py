"""Shared Spark-side building blocks of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, relational, risk
from ..session import materialize
from ..sources import fixtures
from ..sources.tables import table_path

#: From so many bytes of ``lineitem`` on, plans that move the events several times are worked through in steps.
STEPS_FROM = 256 << 20
STEPS_CONF = "spark.quayline.steps.bytes"
#: Event columns that the scores, the predictions and the as-of stock read, and those that an allocation reads besides.
SCORED = ("event_id", "date", "supplier_id", "part_key", "order_key", "supplier_reliability", "demand_units", "inventory_units",
          "supplier_capacity_units", "planned_lead_time_days", "criticality_level")
COSTED = (*SCORED, "unit_cost_usd", "transport_cost_usd", "secondary_supplier_premium_pct", "air_freight_cost_usd")


def in_steps(spark: SparkSession, sf_dir: str) -> bool:
    """Whether the tables are large: the shuffle files of one plan all stay until it ends, those of a step until the step
    ends, so a plan cut into steps needs less disk.  Small tables are faster in one plan."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, "lineitem"))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(path).getLength() >= int(spark.conf.get(STEPS_CONF, str(STEPS_FROM)))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.supply_events(spark, sf_dir)


def latest_predictions(spark: SparkSession, sf_dir: str, ev: DataFrame | None = None, id_hash: bool = False) -> DataFrame:
    """The newest prediction per event; ``id_hash`` for joins by the hash of the id too."""
    preds = fixtures.predictions(spark, sf_dir, ev)
    keys = ["event_id"]
    if id_hash:
        preds, keys = relational.with_id_hash(preds), [relational.ID_HASH, "event_id"]
    return relational.latest_per_key(preds, keys, [F.col("created_on").desc(), F.col("prediction_id").desc()],
                                     few=True)


def rated_events(spark: SparkSession, sf_dir: str, ev: DataFrame) -> DataFrame:
    """``ev`` with the F15 past rate of its supplier."""
    return features.supplier_past_delay_rate(ev, like=lambda n: fixtures.event_key_sample(spark, sf_dir, n))


def kept_events(spark: SparkSession, sf_dir: str, columns=COSTED) -> DataFrame:
    """The rated events as a step of their own: computed once, all that reads events reads these."""
    return materialize(rated_events(spark, sf_dir, events(spark, sf_dir)).select(*columns, "historical_delay_rate"))


def risk_inputs(spark: SparkSession, sf_dir: str, rated: DataFrame | None = None, pred: DataFrame | None = None) -> DataFrame:
    """Events with F1-F5 features, F15 past rate and the latest prediction; ``rated`` and ``pred`` are those of a step before.

    F1-F5 read their own row alone, so they come after the shuffles and do not travel.  The hash of the id stays, for
    later joins by event."""
    ev = events(spark, sf_dir) if rated is None else rated.drop("historical_delay_rate")
    if pred is None:
        pred = latest_predictions(spark, sf_dir, ev, id_hash=True)
    pred = pred.select(relational.ID_HASH, "event_id", "delay_probability", "predicted_delay_days")
    if rated is None:
        rated = rated_events(spark, sf_dir, ev)
    x = relational.with_id_hash(rated).join(pred, [relational.ID_HASH, "event_id"])
    out = features.capacity_supplier_features(features.inventory_features(x))
    given = set(x.columns)
    return out.select(*ev.columns, *[c for c in out.columns if c not in given], *[c for c in x.columns if c not in ev.columns])


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.assess(risk_inputs(spark, sf_dir))
