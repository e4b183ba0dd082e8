"""Line dedup: drop lines that many documents share.

Lines are exploded, normalised and hashed; per hash, the distinct documents are counted with a
partial count before the shuffle; hashes over the threshold are joined back and each document is
put together again from the lines that stay, by position.

Only (hash, document) pairs and dropped positions are shuffled, not the lines' texts.  A line that
a third of all documents hold is one row per map task in the count, and a row of the small side in
the join, whose large side Spark splits (adaptive skew join).
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, single, slices

_STRIP = b" \t\n\x0b\x0c\r"


def _line_keys(min_chars: int):
    """(doc, row, text) -> one row per distinct long line key: 128-bit hash and the positions of its lines."""
    def run(batches):
        for batch in batches:
            texts, docs, rows = single(batch.column("text")), batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            for lo, hi in slices(texts):
                out_doc, out_row, high, low, at = [], [], [], [], []
                for doc, row, text in zip(docs[lo:hi], rows[lo:hi], texts.slice(lo, hi - lo).cast(pa.binary()).to_pylist()):
                    keys: dict[bytes, list[int]] = {}
                    for i, line in enumerate((text or b"").split(b"\n")):
                        if len(line) >= min_chars:
                            key = line.strip(_STRIP).lower()
                            if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                                keys.setdefault(key, []).append(i)
                    for key, positions in keys.items():
                        h = xxhash.xxh3_128_intdigest(key)
                        out_doc.append(doc)
                        out_row.append(row)
                        high.append((h >> 64) - (1 << 63))
                        low.append((h & ((1 << 64) - 1)) - (1 << 63))
                        at.append(positions)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_doc, pa.int64()), pa.array(out_row, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()),
                     pa.array(at, pa.list_(pa.int32()))], ["doc_id", "row", "high", "low", "at"])
    return run


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
                      min_docs: int = 3, lines_col: str = "n_lines", dropped_col: str = "n_dropped") -> DataFrame:
    """``docs`` with ``text_col`` rebuilt without shared lines, plus ``lines_col`` (lines before) and ``dropped_col``.

    A text is split at ``\\n`` (null or empty: one empty line).  A line's key is the line without
    ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased.  Keys of at least ``min_chars`` code
    points that at least ``min_docs`` distinct documents hold lose all their lines, except in the
    document of the largest id that holds them.  Other lines stay as they are, joined by ``\\n``.
    The text of a null document stays null.  A row with a null id counts for no key and loses no
    line.  Rows that repeat an id count as one document and each lose the lines whose keys are
    dropped for that id.  Other columns pass through; the two new names must be free.
    """
    name = "__dropped"
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    doc, text, row = F.col(id_col).cast("long"), F.col(text_col), F.xxhash64(text_col)
    keys = materialize(arrow_map(
        docs.where(F.col(id_col).isNotNull()).select(doc.alias("doc_id"), row.alias("row"), text.alias("text")),
        _line_keys(min_chars), "doc_id long, row long, high long, low long, at array<int>"))
    shared = (keys.select("high", "low", "doc_id").distinct().groupBy("high", "low")
              .agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))
              .where(F.col("docs") >= min_docs).select("high", "low", "last"))
    gone = materialize(
        keys.join(shared, ["high", "low"]).where("doc_id != last").groupBy("doc_id", "row")
        .agg(F.flatten(F.collect_set("at")).alias(name))
        .select(F.col("doc_id").alias(name + "id"), F.col("row").alias(name + "row"), name))
    joined = (docs.join(gone.hint("shuffle_hash"), (doc == F.col(name + "id")) & (row == F.col(name + "row")), "left")
              .withColumn(name + "lines", F.split(F.coalesce(text, F.lit("")), "\n", -1)))
    lines = F.col(name + "lines")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(name))
    rebuilt = F.array_join(F.transform(stay, lambda i: lines[i]), "\n")
    return joined.select(
        *[F.when(F.col(name).isNull(), text).otherwise(rebuilt).alias(c) if c == text_col else F.col(f"`{c}`")
          for c in docs.columns],
        F.size(lines).cast("long").alias(lines_col),
        F.when(F.col(name).isNull(), F.lit(0)).otherwise(F.size(name)).cast("long").alias(dropped_col))
