"""Engine-independent rounding and guarded arithmetic.

``round`` differs between engines (half-even in pandas, half-up on the decimal
text in Spark, half-away in DuckDB).  Every rounded output of this library uses
``floor(x * 10^k + 0.5) / 10^k`` evaluated in doubles, which gives identical
results in any IEEE-754 engine; the oracle SQL uses the same form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def rnd(x, dp: int) -> Column:
    """Round half-up for non-negative values (scores, ratios, rates)."""
    s = float(10 ** dp)
    return (F.floor(_c(x) * F.lit(s) + F.lit(0.5)) / F.lit(s)).cast("double")


def rnd_signed(x, dp: int) -> Column:
    """Sign-symmetric rounding (half away from zero) for variances and differences."""
    s = float(10 ** dp)
    c = _c(x)
    return (F.signum(c) * F.floor(F.abs(c) * F.lit(s) + F.lit(0.5)) / F.lit(s)).cast("double")


def clip01(x) -> Column:
    return F.least(F.greatest(_c(x), F.lit(0.0)), F.lit(1.0))


def safe_div(num, den, default=None) -> Column:
    """num / den, ``default`` (null when None) where den is 0 or null (ANSI-safe)."""
    d = _c(den)
    out = F.when(d.isNull() | (d == 0), F.lit(default)).otherwise(_c(num) / d)
    return out


def sql_rnd(expr: str, dp: int) -> str:
    """The same rounding rule as SQL text (for oracle queries)."""
    s = 10 ** dp
    return f"(floor(({expr}) * {s} + 0.5) / {s})"


def sql_rnd_signed(expr: str, dp: int) -> str:
    s = 10 ** dp
    return f"(sign({expr}) * floor(abs({expr}) * {s} + 0.5) / {s})"
