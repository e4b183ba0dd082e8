"""Registry of named queries: ``name -> (builder(spark, sf_dir), oracle SQL or None)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so their queries register."""
    from . import (quality_q, feature_q, risk_q, eval_q, alloc_q, loop_q, lifecycle_q,  # noqa: F401
                   learning_q, analytics_q, model_q, stream_q, relational_q, intake_q)
