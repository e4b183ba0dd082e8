"""Distributed ordered scans: prefix sums, carried values and exact quantiles.

A running total must not run as one window over all rows of a group.  Heavy groups are cut into slices of their
order (``slices``); totals run inside each slice, and the sums of the earlier slices come as a small table.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .slices import SLICE, cut, slice_carry, slice_offsets


def grouped_cumsum(df: DataFrame, group_cols: list[str], order_cols: list[str], value_cols: list[str],
                   slices: int | None = None, prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``value_cols`` per ``group_cols`` in ``order_cols`` order.

    ``order_cols`` must order rows uniquely within a group (ties would make the
    running total depend on the cut).
    """
    x = slice_offsets(cut(df, list(group_cols), list(order_cols), slices),
                      {f"_o_{v}": F.col(v) for v in value_cols}, list(value_cols))
    wi = (Window.partitionBy(*group_cols, SLICE).orderBy(*order_cols)
          .rowsBetween(Window.unboundedPreceding, 0))
    return x.select(*df.columns, *[(F.col(f"_o_{v}") + F.sum(v).over(wi)).alias(f"{prefix}{v}") for v in value_cols])


def grouped_last(df: DataFrame, group_cols: list[str], order_cols: list[str], value: str, out: str,
                 slices: int | None = None, lowest: str | None = None,
                 like: Callable[[int], DataFrame] | None = None) -> DataFrame:
    """``last(value, ignorenulls)`` over all rows of the group up to and including each row
    (in ``order_cols`` order), without one task per group: a row takes the last value of its
    slice, or else the one carried from the slices before.  Among rows of equal order the one of the
    lowest ``lowest`` counts as the last.  ``like`` is for ``cut``."""
    x = slice_carry(cut(df, list(group_cols), list(order_cols), slices, like=like), value, "_carry", lowest)
    wi = (Window.partitionBy(*group_cols, SLICE).orderBy(*order_cols, *([F.desc(lowest)] if lowest else []))
          .rowsBetween(Window.unboundedPreceding, 0))
    return x.select(*df.columns, F.coalesce(F.last(value, ignorenulls=True).over(wi), F.col("_carry")).alias(out))


def long_values(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """(column_name, [by...], value) long form of the non-null values of ``cols`` (as double)."""
    by = list(by or [])
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value"))
                                for c in cols]))
    return (df.select(*by, stack.alias("_kv")).select("_kv.column_name", *by, "_kv.value")
            .filter(F.col("value").isNotNull()))


#: Sketch size and the rank margin (share of the rows) put on each side of a wanted rank.  The margin is
#: about twice the sketch's own error; a rank outside its bracket is found out by counting, never assumed.
SKETCH_K, MARGIN = 4096, 0.003
#: Values that may be gathered for one bracket; a bracket that may hold more is narrowed by another round.
GATHER = 20000


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], by: list[str] | None = None,
                    sketch_k: int = SKETCH_K, margin: float = MARGIN, gather: int = GATHER) -> DataFrame:
    """Exact linear-interpolation quantiles (numpy/pandas default) of several columns.

    Returns (column_name, by..., prob, quantile), without rows for all-null columns.  Without ``by``, one pass
    builds a mergeable KLL sketch per column, which brackets every wanted rank; the next ones count what lies
    below and on the ends of each bracket and gather only the values inside.  A bracket that missed its rank
    is opened again, and one that may hold more than ``gather`` values is narrowed by a sketch of its own, in
    another pass.  All columns share each pass, no value is shuffled, and the driver holds a few numbers per
    wanted rank.  With ``by``, values are counted per group and ranked by a sliced prefix sum.
    """
    if by:
        return _counted_quantiles(df, cols, probs, list(by))
    x = df.select(*[F.col(c).cast("double").alias(f"_v{j}") for j, c in enumerate(cols)])
    names = x.columns
    spread = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-margin, margin)})
    row = x.agg(*[F.count(v).alias("n" + v) for v in names], *[F.min(v).alias("a" + v) for v in names],
                *[F.max(v).alias("b" + v) for v in names],
                *[F.kll_sketch_agg_double(v, F.lit(sketch_k)).alias("s" + v) for v in names])
    row = row.select("*", *[F.when(F.col("n" + v) > 0, F.kll_sketch_get_quantile_double(
        F.col("s" + v), F.array(*[F.lit(r) for r in spread]))).alias("q" + v) for v in names]).drop(*["s" + v for v in names]).first()
    open_, found = [], []
    for c, v in zip(cols, names):
        n, low, high = row["n" + v], row["a" + v], row["b" + v]
        for p in probs if n else ():
            k = math.floor((n - 1) * p)
            q = dict(zip(spread, row["q" + v]))
            lo = low if n <= gather or p <= margin else q[max(p - margin, 0.0)]
            hi = high if n <= gather or p >= 1 - margin else q[min(p + margin, 1.0)]
            open_.append(_Bracket(c, v, float(p), n, k, lo, hi, min(n, 4 * margin * n)))
    while open_:
        within = [f"({b.values} > double('{b.lo}') AND {b.values} < double('{b.hi}'))" for b in open_]
        inside = [f"IF({w}, {b.values}, NULL)" for w, b in zip(within, open_)]
        few = [b.expected <= gather for b in open_]
        row = x.agg(*[F.expr(agg) for i, b in enumerate(open_) for agg in (
            f"count_if({b.values} < double('{b.lo}')) AS below{i}", f"count_if({b.values} = double('{b.lo}')) AS at{i}",
            f"count_if({b.values} = double('{b.hi}')) AS top{i}", f"count_if({within[i]}) AS in{i}")]).first()
        held: dict[int, list[float]] = {i: [] for i in range(len(open_))}
        if any(few):
            hit = x.where(" OR ".join(w for w, f in zip(within, few) if f))
            cells = ", ".join(f"IF({w}, struct({i} AS i, {b.values} AS v), NULL)"
                              for i, (w, b, f) in enumerate(zip(within, open_, few)) if f)
            for r in hit.selectExpr(f"inline(array_compact(array({cells})))").collect():  # about ``gather`` a bracket
                held[r.i].append(r.v)
        if not all(few):
            rest = [i for i, f in enumerate(few) if not f and row[f"in{i}"]]
            grids = x.agg(*[F.kll_sketch_agg_double(F.expr(inside[i]), F.lit(sketch_k)).alias(f"s{i}") for i in rest]).select(*[
                F.kll_sketch_get_quantile_double(f"s{i}", F.array(*[F.lit(g / 100) for g in range(101)])).alias(f"q{i}")
                for i in rest]).first() if rest else {}
            held.update({i: grids[f"q{i}"] for i in rest})
        left = []
        for i, b in enumerate(open_):
            values = b.settle(*[row[f"{w}{i}"] for w in ("below", "at", "in", "top")], held[i], gather, margin)
            if values:
                a, z = values
                found.append((b.column, b.prob, a + (z - a) * ((b.n - 1) * b.prob - b.k)))
            else:
                left.append(b)
        open_ = left
    return df.sparkSession.createDataFrame(found, "column_name string, prob double, quantile double")


@dataclass
class _Bracket:
    """The values of ranks ``k`` and ``k + 1`` (0-based) among ``n`` are looked for between ``lo`` and ``hi``."""

    column: str
    values: str
    prob: float
    n: int
    k: int
    lo: float
    hi: float
    expected: float

    def settle(self, below: int, at: int, inside: int, top: int, held: list[float], gather: int,
               margin: float) -> tuple[float, float] | None:
        """The two values, or None after the bracket was opened again or narrowed."""
        if self.lo == self.hi:
            top = 0
        gathered = self.expected <= gather
        ordered = sorted(held) if gathered else []
        ranks = self.k, min(self.k + 1, self.n - 1)
        out = []
        for r in ranks:
            place = r - below - at
            if below <= r < below + at:
                out.append(self.lo)
            elif gathered and 0 <= place < inside:
                out.append(ordered[place])
            elif inside <= place < inside + top:
                out.append(self.hi)
        if len(out) == 2:
            return out[0], out[1]
        if ranks[0] < below or ranks[1] >= below + at + inside + top:  # the sketch was off: start from all values
            self.lo, self.hi, self.expected = float("-inf"), float("inf"), self.n
        elif inside <= gather:
            self.expected = inside
        else:
            first, last = ((r - below - at) / inside for r in ranks)
            lo, hi = self.lo, self.hi
            if first > margin:
                self.lo = held[min(int((first - margin) * 100), 100)]
            if last < 1 - margin:
                self.hi = held[max(math.ceil((last + margin) * 100), 0)]
            self.expected = inside * (last - first + 2 * margin + 0.03) if (self.lo, self.hi) != (lo, hi) else inside
        return None


def _counted_quantiles(df: DataFrame, cols: list[str], probs: list[float], by: list[str]) -> DataFrame:
    """Per group: distinct values with counts, their prefix sum, and the values at the wanted ranks."""
    g = ["column_name", *by]
    vc = long_values(df, cols, by).groupBy(*g, "value").agg(F.count(F.lit(1)).alias("n"))
    cum = grouped_cumsum(vc, g, ["value"], ["n"])
    ranks = F.explode(F.array(*[F.lit(float(p)) for p in probs]))
    t = vc.groupBy(*g).agg(F.sum("n").alias("_N")).select(*g, "_N", ranks.alias("prob")).select(
        *g, "prob", ((F.col("_N") - 1) * F.col("prob")).alias("_h")).withColumn("_k", F.floor("_h"))
    # value at 0-based rank k is the smallest value whose inclusive count exceeds k
    agg = cum.join(t, g).groupBy(*g, "prob", "_h", "_k").agg(
        F.min(F.when(F.col("cum_n") >= F.col("_k") + 1, F.col("value"))).alias("_lo"),
        F.min(F.when(F.col("cum_n") >= F.col("_k") + 2, F.col("value"))).alias("_hi"))
    hi = F.coalesce(F.col("_hi"), F.col("_lo"))
    return agg.select(*g, "prob",
                      (F.col("_lo") + (hi - F.col("_lo")) * (F.col("_h") - F.col("_k"))).alias("quantile"))
