"""Named query plans: each pairs a Spark builder with its DuckDB oracle SQL."""

from .registry import ORACLE, QUERIES, register  # noqa: F401
