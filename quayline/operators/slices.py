"""Ordered work inside groups of any size: heavy groups are cut into slices of their order.

A window per group puts a whole group into one task.  Here a sample of fixed size (``per_slice`` rows for
each of ``slices`` slices, chosen by the hash of the keys) shows which groups are larger than a
slice, and gives the bounds at which these are cut.  The table of bounds has at most ``slices`` entries
whatever the data, so it is broadcast; a row finds its slice by comparing itself with the bounds of its
own group.  Windows then run per (group, slice) behind one shuffle, and what crosses a bound travels as a small
table: the last rows of a slice (``with_halo``) or the totals of a slice (``slice_offsets``).  Groups
that are not heavy stay whole, and without heavy groups the small tables are empty, so adaptive execution
drops their branch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"
HALO = "_halo"


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    cond = F.lit(True)
    for c in names:
        cond = cond & left[c].eqNullSafe(right["_g_" + c])
    return cond


@dataclass
class Cut:
    """``rows`` with their slice; ``bounds`` holds the heavy groups."""

    source: DataFrame
    rows: DataFrame
    bounds: DataFrame
    group: list[str]
    order: list[str]

    def heavy(self, columns: list[str]) -> DataFrame:
        """Rows of heavy groups with their slice, only the given columns."""
        names = [c for c in dict.fromkeys([*self.group, *self.order, *columns])]
        return _sliced(self.source.select(*names), self.bounds, self.group, self.order, "inner")


def _sliced(df: DataFrame, bounds: DataFrame, group: list[str], order: list[str], how: str) -> DataFrame:
    b = F.broadcast(bounds)  # at most ``slices`` bounds in all
    x = df.join(b, _same(df, bounds, group), how)
    key = F.struct(*[F.col(c) for c in order])
    block = F.size(F.filter("_firsts", lambda v: v <= key))
    inside = F.size(F.filter(F.element_at("_blocks", F.greatest(block, F.lit(1))), lambda v: v <= key))
    at = F.when(F.col("_blocks").isNull() | (block == 0), F.lit(0)).otherwise((block - 1) * F.col("_width") + inside)
    return x.select(*df.columns, at.cast("int").alias(SLICE), F.col("_last"))


def cut(df: DataFrame, group: list[str], order: list[str], slices: int | None = None, per_slice: int = 20,
        like: Callable[[int], DataFrame] | None = None) -> Cut:
    """Give every row of ``df`` its slice within ``group`` in the order of ``order`` (ascending, nulls first).

    The sample comes from ``df``, or is the ``like(n)`` of the caller: at most n rows, chosen by a hash, of about the same
    keys, where that costs less.  It is moved into one partition, an exchange, so that all that reads the bounds
    shares one sample."""
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order]
    sample = (df if like is None else like(slices * per_slice)).select(*keys).orderBy(F.xxhash64(*keys), *keys).limit(slices * per_slice).repartition(1)
    seen = sample.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("_s"))
    marks = F.array_distinct(F.transform(F.sequence(F.lit(per_slice), F.size("_s") - 1, F.lit(per_slice)),
                                         lambda i: F.element_at("_s", i + 1)))
    heavy = seen.where(F.size("_s") >= 2 * per_slice).select(
        *[F.col(c).alias("_g_" + c) for c in group], marks.alias("_b"))
    width = F.ceil(F.sqrt(F.size("_b"))).cast("int")
    heavy = heavy.withColumn("_width", width)
    blocks = F.transform(F.sequence(F.lit(0), F.ceil((F.size("_b") - 1) / F.col("_width")).cast("int")),
                         lambda i: F.slice("_b", i * F.col("_width") + 1, F.col("_width")))
    heavy = heavy.withColumn("_blocks", F.filter(blocks, lambda v: F.size(v) > 0)).select(
        *["_g_" + c for c in group], "_width", "_blocks", F.transform("_blocks", lambda v: v[0]).alias("_firsts"),
        F.size("_b").alias("_last"))
    rows = _sliced(df, heavy, group, order, "left").drop("_last")
    return Cut(df, rows, heavy, group, order)


def with_halo(c: Cut, back: int, need: list[str]) -> DataFrame:
    """``c.rows`` and, before the first row of every later slice, copies (``_halo`` true) of the ``back`` rows before
    it with the columns ``need``: a window over the previous ``back`` rows per (group, slice) is then complete."""
    heavy = c.heavy(need).where(F.col(SLICE) < F.col("_last")).drop("_last")
    newest = Window.partitionBy(*c.group, SLICE).orderBy(*[F.desc_nulls_last(o) for o in c.order])
    fields = [f for f in dict.fromkeys([*c.order, *need])]
    tails = (heavy.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= back)
             .groupBy(*c.group, SLICE).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_t")))
    # every slice has at least one row, so the last ``back`` slices hold the last ``back`` rows
    lately = Window.partitionBy(*c.group).orderBy(SLICE).rowsBetween(-(back - 1), 0)
    flat = tails.select(*c.group, SLICE, F.flatten(F.collect_list("_t").over(lately)).alias("_t"))
    halo = flat.select(*c.group, (F.col(SLICE) + 1).alias(SLICE),
                       F.explode(F.slice("_t", F.greatest(F.size("_t") - back + 1, F.lit(1)), back)).alias("_r"))
    halo = halo.select(*c.group, SLICE, "_r.*", F.lit(True).alias(HALO))
    return c.rows.withColumn(HALO, F.lit(False)).unionByName(halo, allowMissingColumns=True)


def slice_offsets(c: Cut, sums: dict[str, Column], need: list[str]) -> DataFrame:
    """``c.rows`` with, per name of ``sums``, the sum over all earlier slices of the row's group (0 in the first)."""
    totals = c.heavy(need).groupBy(*c.group, SLICE).agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    before = Window.partitionBy(*c.group).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(g).alias("_g_" + g) for g in c.group], F.col(SLICE).alias("_at"),
                            *[F.sum(n).over(before).alias(n) for n in sums])
    x = c.rows.join(F.broadcast(carried), _same(c.rows, carried, c.group) & (F.col(SLICE) == F.col("_at")), "left")
    return x.select(*c.rows.columns, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in sums])


def slice_carry(c: Cut, value: str, out: str, lowest: str | None = None) -> DataFrame:
    """``c.rows`` with the last non-null ``value`` of all earlier slices of the row's group as ``out``
    (of rows of equal order, that of the lowest ``lowest``)."""
    held = c.heavy([value, *([lowest] if lowest else [])]).where(F.col(value).isNotNull())
    if lowest:
        held = held.groupBy(*c.group, SLICE, *c.order).agg(F.min_by(value, lowest).alias(value))
    ends = (held.groupBy(*c.group, SLICE)
            .agg(F.max_by(value, F.struct(*c.order)).alias("_v")))
    slots = c.bounds.select("*", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("_at"))
    full = slots.join(ends, _same(ends, slots, c.group) & (ends[SLICE] == slots["_at"]), "left")
    before = (Window.partitionBy(*["_g_" + g for g in c.group]).orderBy("_at")
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = full.select(*["_g_" + g for g in c.group], "_at", F.last("_v", ignorenulls=True).over(before).alias(out))
    x = c.rows.join(F.broadcast(carried), _same(c.rows, carried, c.group) & (F.col(SLICE) == F.col("_at")), "left")
    return x.select(*c.rows.columns, out)
