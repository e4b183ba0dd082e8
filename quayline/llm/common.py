"""Helpers shared by the training-data operators.

* ``materialize`` writes a frame once to Parquet in the shared checkpoint folder and reads it
  back with its known schema: a narrow intermediate that several consumers read, and a place
  from which a lost executor's work is redone.
* ``words_of`` finds the word boundaries and 64-bit word hashes of a whole Arrow string column
  with numpy, without a Python object per word.
* ``slices`` cuts an Arrow batch into runs of bounded bytes, so task memory depends on the
  longest single text and not on the batch size.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.session import ensure_checkpoint_dir

CHUNK_BYTES = 1 << 21


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and return a scan of it (removed when the JVM ends)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quayline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, unless their path already holds it."""
    root, app = Path(__file__).resolve().parents[2], spark.sparkContext.applicationId
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or app in _SHIPPED:
        return
    archive = Path(tempfile.mkdtemp(prefix="quayline-py-")) / "quayline.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted((root / "quayline").rglob("*.py")):
            z.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def arrow_map(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with this package on the workers' path."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def held_out(doc_id: Column) -> Column:
    """The fold that models never learn from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0


def slices(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` text bytes each (one row where a single text is longer)."""
    ends = string_offsets(texts)
    lo, n = 0, len(texts)
    while lo < n:
        hi = int(np.searchsorted(ends, ends[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def string_offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the rows' offsets into them (a null is empty)."""
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = string_offsets(texts)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def single(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240917))
_BYTE = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64) | _U(1)
_BASE, _BASE_INV = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (kept between calls of a worker, up to 1M entries)."""
    name = str(base)
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if len(have) <= 1 << 23:
            _POWERS[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the word."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, ...]:
    """Words (maximal runs of non-separators) of concatenated texts, A-Z lower-cased.

    Returns (start, end, hash, first word of each row): byte positions in ``raw``, 64-bit
    hashes, and for row i its words are ``first[i]:first[i + 1]``.
    """
    n = len(raw)
    if n == 0:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~separators[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    np.logical_not(inside[:-1], out=before[1:])
    start = np.flatnonzero(inside & (before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = True
    np.logical_not(inside[1:], out=after[:-1])
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[_LOWER[raw]] * _powers(_BASE, n), out=total[1:])
    h = (total[end] - total[start]) * _powers(_BASE_INV, n)[start]
    h = mix(h + (end - start).astype(np.uint64))
    return start, end, h, np.searchsorted(start, offsets)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct 64-bit hashes of its k-word shingles.

    A text of fewer than k words has its whole word sequence as the only shingle; a null text
    or one without words has none.
    """
    raw, offsets = utf8(texts)
    _, _, h, first = words_of(raw, offsets)
    n = len(h)
    mult = np.array([(2 * i + 3) * 0x9E3779B97F4A7C15 % (1 << 64) | 1 for i in range(k)], dtype=np.uint64)
    grams = np.zeros(max(n - k + 1, 0), dtype=np.uint64)
    for i in range(k):
        grams += mix(h[i:n - k + 1 + i] * mult[i]) if len(grams) else grams
        grams = grams * _U(0xD6E8FEB86659FD93) if len(grams) else grams
    grams = mix(grams)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            yield np.unique(grams[a:b - k + 1])
        elif b > a:
            whole = np.zeros(1, dtype=np.uint64)
            for i in range(a, b):
                whole = whole * _U(0xD6E8FEB86659FD93) + mix(h[i:i + 1] * mult[i - a])
            yield mix(whole ^ _U(0xA24BAED4963EE407 + (b - a)))
        else:
            yield grams[:0]
