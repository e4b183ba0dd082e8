"""Order MinHash fingerprints in DataFrame functions only.

A text's k-mers of words are numbered by occurrence, so repeats count, and the hashes of all
(k-mer, occurrence) are sorted once.  Each of ``VALUES`` selections has its own starting place in the
range of the hashes and takes the two k-mers that follow it (from the end on to the beginning), puts
them back in text order and hashes the two.  The places are evenly spread, so the selections of a text of
many k-mers take different ones and are independent; a text of few k-mers has equal selections.  Two
texts agree in a value when they select the same two k-mers in the same order, so the share of equal
values falls with the edit distance, also where only the order differs.

Hash and place travel in one long, so sorting is a primitive sort and no step needs a shuffle.  The texts are
shuffled once, into ranges of ids, where the next document is the neighbouring row; only the last row of
each range is copied to the one beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayline.operators.slices import HALO, SLICE, cut, with_halo

from .common import materialize

PLACE = (1 << 24) - 1
VALUES = 128  # the selection that a hash belongs to is its upper 7 bits, -64 to 63


def _packed(h: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftright(h, 24), 24).bitwiseOR(place)


def _hash(packed: Column) -> Column:
    return F.shiftright(packed, 24)


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(PLACE).cast("long"))


def _selection(packed: Column) -> Column:
    return F.shiftright(packed, 57).cast("int")


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = 2) -> DataFrame:
    """``df`` with ``out``: ``VALUES`` 32-bit numbers (array<int>) from all of the column ``text``.

    Words are runs without white space.  A text of fewer than ``k`` words has its word sequence as only
    k-mer; a text of one k-mer has that k-mer's hash alone; a null text counts as empty, and texts
    without words all have the one value 0.
    """
    t = f"__{out}_"
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t\n\x0b\f\r]+"), lambda w: w != "")
    df = df.withColumn(t + "w", F.transform(words, lambda w: F.xxhash64(w)))
    w = F.col(t + "w")
    grams = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))),
        lambda i: _packed(F.xxhash64(*[F.get(w, i + j) for j in range(k)]), F.pmod(i, F.lit(PLACE + 1)).cast("long")))
    df = df.withColumn(t + "s", F.when(F.size(w) > 0, F.sort_array(grams)).otherwise(F.array().cast("array<bigint>")))
    s = F.col(t + "s")
    n = F.size(s)
    # where the runs of equal k-mers begin in sorted order
    runs = F.when(n > 0, F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
                                  lambda i: (i == 0) | (_hash(s[i]) != _hash(s[F.greatest(i - 1, F.lit(0))]))))
    df = df.withColumn(t + "r", F.coalesce(runs, F.array().cast("array<int>")))
    r = F.col(t + "r")

    def numbered(p, occurrence):
        return _packed(F.xxhash64(_hash(p), occurrence), _place(p))

    plain = F.transform(s, lambda p: numbered(p, F.lit(0)))
    by_run = F.flatten(F.transform(r, lambda b, i: F.transform(
        F.slice(s, b + 1, F.coalesce(F.get(r, i + 1), n) - b), lambda p, o: numbered(p, o))))
    df = df.withColumn(t + "o", F.sort_array(F.when(F.size(r) == n, plain).otherwise(by_run)))
    o = F.col(t + "o")
    # of each selection's own stretch the first two
    df = df.withColumn(t + "m", F.filter(o, lambda p, i: (i < 2) | (_selection(p) != _selection(F.get(o, i - 2)))))
    m = F.col(t + "m")  # named several times below, so it stays a column and is not selected anew per value
    last = F.size(m) - 1
    df = df.withColumn(t + "b", F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                                         lambda i: (i == 0) | (_selection(F.get(m, i)) != _selection(F.get(m, i - 1)))))
    b = F.col(t + "b")

    def value(i):
        x, y = F.get(m, i), F.get(m, F.pmod(i + 1, F.greatest(F.size(m), F.lit(1))))
        return F.when(_place(x) <= _place(y), F.hash(_hash(x), _hash(y))).otherwise(F.hash(_hash(y), _hash(x)))

    # a selection without hashes of its own goes on to the next one that has some
    values = F.flatten(F.transform(b, lambda x, i: F.array_repeat(
        value(x), _selection(F.get(m, x)) - F.when(i == 0, -VALUES // 2 - 1).otherwise(_selection(F.get(m, F.get(b, i - 1)))))))
    after = F.array_repeat(value(F.lit(0)), VALUES // 2 - 1 - _selection(F.get(m, last)))
    df = df.withColumn(out, F.when(F.size(m) > 1, F.concat(values, after))
                       .when(F.size(m) == 1, F.transform(m, lambda p: F.hash(_hash(p)))).otherwise(F.array(F.lit(0))))
    return df.drop(*(t + c for c in "wsromb"))


def likeness(a: str, b: str) -> Column:
    """Likeness of two fingerprints, 0 to 1: the share of equal values, brought back from pairs to one
    k-mer by the square root."""
    same = F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda e: e)
    return F.sqrt(F.size(same) / F.greatest(F.size(a), F.size(b)))


def _text_of(fingerprint: str) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def next_ids(ids: DataFrame) -> DataFrame:
    """(id, next): the next smaller id, after the smallest the largest; ``ids`` has one distinct column ``id``.

    Range-partitioned: each task orders its own ids, and the ends of the ranges (one row per task) are
    matched among themselves.
    """
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(ids.repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id()))
    inside = ranged.withColumn("next", F.lag("id").over(Window.partitionBy("part").orderBy("id")))
    ends = ranged.groupBy("part").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    one = Window.partitionBy(F.lit(0)).orderBy("part")  # one row per task of the range partitioning
    last = F.max("high").over(Window.partitionBy(F.lit(0)))
    before = ends.select(F.col("low").alias("id"), F.coalesce(F.lag("high").over(one), last).alias("other"))
    first = inside.where("next is null").select("id").join(before, "id").select("id", F.col("other").alias("next"))
    return inside.where("next is not null").select("id", "next").unionByName(first)


def _beside_next(known: DataFrame, options: dict) -> DataFrame:
    """(doc_id, text, f, prefix, g): every document beside the text and the fingerprint of its next one; ids are distinct.

    The texts move once, into ranges of ids cut at sampled bounds.  Within a range the next document is the
    row before; the last row of each range is copied into the one above it, and the largest into the lowest."""
    parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(known.withColumn("_all", F.lit(0)), ["_all"], ["doc_id"], slices=4 * parts)
    top = known.orderBy(F.desc("doc_id")).limit(1).select(
        F.lit(0).alias("_all"), F.lit(0).alias(SLICE), F.lit(-(1 << 63)).cast("long").alias("doc_id"), "text", F.lit(True).alias(HALO))
    x = with_halo(ranged, 1, ["text"]).unionByName(top).repartition(SLICE)
    x = with_fingerprint(x, "text", "f", **options)
    w = Window.partitionBy(SLICE).orderBy("doc_id", F.desc(HALO))
    return x.select("doc_id", "text", "f", HALO, F.lag("text").over(w).alias("prefix"), F.lag("f").over(w).alias("g")).where(
        ~F.col(HALO)).drop(HALO)


def _beside_repeated(known: DataFrame, options: dict) -> DataFrame:
    """As ``_beside_next`` where ids repeat: joined by id, the smallest text of an id stands for it."""
    order = materialize(next_ids(known.select(F.col("doc_id").alias("id")).distinct()))
    back = order.select(F.col("next").alias("doc_id"), F.col("id").alias("user"))
    given = known.join(back.hint("shuffle_hash"), "doc_id").groupBy("user").agg(F.min("text").alias("prefix"))
    given = with_fingerprint(given, "prefix", "g", **options).withColumnRenamed("user", "doc_id")
    return with_fingerprint(known.join(given.hint("shuffle_hash"), "doc_id"), "text", "f", **options).select(
        "doc_id", "text", "f", "prefix", "g")


def fingerprints_with_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness.

    Edited: the last floor(n / 2) code points are replaced by the first as many (or all) of the next
    document in descending id order (after the last: the first).  A null text is empty; a row with a null
    id is left out of the order and compared with itself; of rows that repeat an id, the smallest text
    is the "next" text, and each row is returned.  A single document is its own next.  Other columns
    are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = rows.where("doc_id is not null")
    if known.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").limit(1).count():
        joined = _beside_repeated(known, options)
    else:
        joined = _beside_next(known, options)
    alone = with_fingerprint(rows.where("doc_id is null"), "text", "f", **options)
    joined = joined.unionByName(alone.select("doc_id", "text", "f", F.col("text").alias("prefix"), F.col("f").alias("g")))
    half = F.floor(F.char_length("text") / 2).cast("int")
    n = F.char_length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")),
                      F.substring(F.col("prefix"), F.lit(1), half))
    own = joined.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), edited.alias("edited"), "f", "g")
    compared = with_fingerprint(own, "edited", "e", **options)
    compared = compared.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))
    return compared.select(
        "doc_id", "n_chars", "edited_sha256", _text_of("f").alias("fingerprint"), _text_of("e").alias("edited_fingerprint"),
        likeness("f", "e").alias("near_edited"), likeness("f", "g").alias("near_next"))
