"""Document quality by Bradley-Terry ranking.

Labels give preference pairs (a document of label 1 over one of label 0).  The probability that one
beats the other is the logistic function of the difference of their scores, and a score is linear
in features of the whole text; so the weights are a logistic regression without intercept on
feature differences.  The threshold is a quantile of the scores of all labelled documents: the share
of label 0 among them lies below it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayline.operators.scan import exact_quantiles

from .common import arrow_map, held_out, materialize, single, slices, utf8, words_of

FEATURES = ("log_words", "word_length", "upper_share", "digit_share", "symbol_share", "distinct_share", "top_word_share",
            "repeat_share", "noise_share", "shout_share", "short_share", "stop_share", "line_length", "repeat_line_share",
            "worst_noise", "worst_shout", "worst_repeat", "worst_distinct", "long_text")
BLOCK_WORDS = 40

_UPPER, _DIGIT, _SYMBOL, _LETTER, _END = (np.zeros(256, dtype=bool) for _ in range(5))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[192:256] = True
_SYMBOL[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_END[list(b".,;:!?")] = True


def _running(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text, from all of it (null or empty: zeros)."""
    raw, offsets = utf8(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    if not len(raw):
        return out
    start, end, h, first = words_of(raw, offsets)
    upper, digit, symbol, letter = (_running(c[raw]) for c in (_UPPER, _DIGIT, _SYMBOL, _LETTER))
    span = lambda c: (c[end] - c[start]).astype(np.float64)
    w_upper, w_symbol, w_letter = span(upper), span(symbol), span(letter)
    noise = (w_symbol - _END[raw[end - 1]] >= 2) | (w_letter == 0)
    shout = (w_upper == w_letter) & (w_letter >= 2)
    again = np.concatenate([[False], h[1:] == h[:-1]]) if len(h) else np.zeros(0, bool)
    c_noise, c_shout, c_again = _running(noise), _running(shout), _running(again)
    c_short, c_stop = _running(end - start <= 3), _running(_END[raw[end - 1]]) if len(h) else np.zeros(1)
    c_len = _running(end - start)
    newline = _running(raw == 10)
    size = np.maximum(np.diff(offsets), 1)
    words = np.diff(first)
    n = np.maximum(words, 1)
    total = lambda c: c[first[1:]] - c[first[:-1]]
    chars = lambda c: c[offsets[1:]] - c[offsets[:-1]]
    out[:, 0] = np.log1p(words)
    out[:, 1] = np.minimum(total(c_len) / n, 30)
    out[:, 2] = chars(upper) / np.maximum(chars(letter), 1)
    out[:, 3] = chars(digit) / size
    out[:, 4] = chars(symbol) / size
    out[:, 7], out[:, 8], out[:, 9] = total(c_again) / n, total(c_noise) / n, total(c_shout) / n
    out[:, 10], out[:, 11] = total(c_short) / n, total(c_stop) / n
    out[:, 12] = np.log1p(size / (1 + chars(newline)))
    out[:, 18] = np.log1p(words) > 7
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b == a:
            continue
        own, count = np.unique(h[a:b], return_counts=True)
        out[i, 5] = len(own) / (b - a)
        out[i, 6] = count.max() / (b - a)
        edge = np.unique(np.append(np.arange(a, b, BLOCK_WORDS), b)) if b - a > BLOCK_WORDS else np.array([a, b])
        width = np.diff(edge)
        for col, c in ((14, c_noise), (15, c_shout), (16, c_again)):
            out[i, col] = (np.diff(c[edge]) / np.maximum(width, 10)).max()
        out[i, 17] = 1 - len(own) / (b - a) if b - a < 200 else max(
            0.0, 1 - min(len(np.unique(h[x:x + 200])) for x in (*range(a, b - 199, 200), b - 200)) / 200)
    lines = np.flatnonzero(raw == 10)
    cut = np.searchsorted(lines, offsets)
    for i in np.flatnonzero(np.diff(cut) >= 2).tolist():
        own = raw[offsets[i]:offsets[i + 1]].tobytes().split(b"\n")
        out[i, 13] = 1 - len(set(own)) / len(own)
    return out


def _feature_rows(batches):
    """(doc_id, held_out, text) -> (doc_id, held_out, x): the features of every row."""
    for batch in batches:
        texts = single(batch.column("text"))
        for lo, hi in slices(texts):
            x = features(texts.slice(lo, hi - lo))
            yield pa.RecordBatch.from_arrays(
                [*(single(batch.column(c)).slice(lo, hi - lo) for c in ("doc_id", "held_out")), _lists(x)], ["doc_id", "held_out", "x"])


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return single(batch.column("x")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))


class Ranking:
    """Weights on standardised features and the threshold: a plain value that travels to the tasks."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float, at: float):
        self.mean, self.scale, self.weights, self.cut, self.at = mean, scale, weights, cut, at

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (self.standard(x) * self.weights).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the threshold's quantile is at ``at``."""
        z = self.raw(x) - self.cut + np.log(self.at / (1 - self.at))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _standardised(ranking: Ranking):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("id"), _lists(ranking.standard(_matrix(batch)))],
                                             ["label", "id", "x"])
    return run


def _raw_scores(ranking: Ranking):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(ranking.raw(_matrix(batch)))], ["s"])
    return run


def _numbered(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` (label, id, x) with ``i``, 0 to n - 1 within each label in the order of the id's hash.

    Rows are numbered within buckets of hashes of about a thousand rows; the counts of the earlier buckets, one
    number per label and bucket, are added."""
    buckets = max(1, total // 1000)
    h = F.xxhash64("id")
    x = rows.withColumn("b", F.pmod(h, F.lit(buckets)))
    before = Window.partitionBy("label").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = x.groupBy("label", "b").agg(F.count(F.lit(1)).alias("n")).select(
        "label", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"))
    inside = Window.partitionBy("label", "b").orderBy(h, "id", "x")
    x = x.withColumn("r", F.row_number().over(inside) - 1)
    return x.join(F.broadcast(offsets), ["label", "b"]).select("label", (F.col("o") + F.col("r")).alias("i"), "x")


def contests(rows: DataFrame, n_good: int, n_bad: int, rivals: int) -> DataFrame:
    """Feature differences (label, x): every row of the more frequent label meets ``rivals`` rows of the other in turn,
    so each row of either is in some contest.  Every second contest is turned round (label 0), which leaves the loss as it is."""
    rows = _numbered(rows, n_good + n_bad)
    many, few, n = (1, 0, n_bad) if n_good >= n_bad else (0, 1, n_good)
    turn = F.col("i") * rivals + F.col("t")
    left = rows.where(F.col("label") == many).select("i", F.col("x").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(rivals - 1))).alias("t"))
    left = left.select("a", F.pmod(turn, F.lit(n)).alias("k"), F.pmod(F.col("t"), F.lit(2)).alias("odd"))
    right = rows.where(F.col("label") == few).select(F.col("i").alias("k"), F.col("x").alias("b"))
    won = F.col("odd") == (0 if many == 1 else 1)
    return left.join(right, "k").select(
        won.cast("double").alias("label"),
        F.when(F.col("odd") == 0, F.zip_with("a", "b", lambda a, b: a - b)).otherwise(F.zip_with("a", "b", lambda a, b: b - a)).alias("x"))


def fit_ranking(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, rivals: int = 8, at: float = 0.3) -> Ranking | None:
    """Fit on every labelled row of ``rows`` (doc_id, held_out, x) that is not held out; None if a label is missing.

    Means, deviations and the threshold are those of all these rows; each row of the more frequent label
    meets ``rivals`` rows of the other."""
    labels = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
              .where(F.col("label").isin(0, 1)).groupBy("id").agg(F.max("label").alias("label")))
    known = materialize(rows.where(~F.col("held_out")).select(F.col("doc_id").alias("id"), "x").join(labels, "id").select("label", "id", "x"))
    columns = [F.col("x")[j] for j in range(len(FEATURES))]
    row = known.agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad"),
                    F.array(*[F.avg(c) for c in columns]).alias("mean"), F.array(*[F.stddev_pop(c) for c in columns]).alias("scale")).first()
    if not row.good or not row.bad:
        return None
    mean, scale = np.array(row["mean"]), np.array(row["scale"])
    scale[scale < 1e-9] = 1.0
    ranking = Ranking(mean, scale, np.zeros(len(FEATURES)), 0.0, at)
    kind = dict(known.dtypes)["id"]
    standard = arrow_map(known.select("label", "id", "x"), _standardised(ranking), f"label int, id {kind}, x array<double>")
    diffs = contests(standard, row.good, row.bad, rivals).select("label", array_to_vector("x").alias("features")).cache()
    model = LogisticRegression(fitIntercept=False, standardization=False, regParam=1e-4, maxIter=60).fit(diffs)
    diffs.unpersist()
    ranking.weights = model.coefficients.toArray()
    # the quantile of the whole labelled fold: as many scores as there are rows of label 0 end at the threshold
    scores = materialize(arrow_map(known.select("x"), _raw_scores(ranking), "s double"))
    between = (row.bad - 0.5) / (row.good + row.bad - 1)
    upper = exact_quantiles(scores, ["s"], [between]).first().quantile
    ranking.cut = float(scores.where(F.col("s") <= upper).agg(F.max("s").alias("s")).first().s)
    return ranking


def _score(ranking: Ranking | None, at: float):
    def run(batches):
        for batch in batches:
            score = ranking.score(_matrix(batch)) if ranking else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "held_out")), pa.array(score), pa.array((score >= at).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])
    return run


def rank_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "quality", at: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row; ``predicted`` is 1 where ``score >= at``.

    Learned from all labelled documents whose id's crc32 (as text) modulo 5 is not 0; without both labels
    every score is 0.5.  A null or empty text is scored
    by its (zero) features.  Labels other than 0 and 1 are ignored, of repeated labels the larger counts;
    a row with a null id is scored and never learned from (``held_out`` null).  Equal texts have equal
    scores.  Other columns are not read.  Features are computed once and kept in the shared checkpoint folder.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    rows = materialize(arrow_map(rows, _feature_rows, f"doc_id {kind}, held_out boolean, x array<double>"))
    ranking = fit_ranking(rows, labels, id_col, label_col, at=at)
    return arrow_map(rows, _score(ranking, at), f"doc_id {kind}, held_out boolean, score double, predicted int")
