"""Secret scan: fixed patterns, plus character Markov models compared by log-likelihood ratio.

Two first-order character models are trained from labelled samples, one on random strings and one on
ordinary identifiers.  A long token outside the patterns' spans is a secret if its mean log-likelihood
ratio per character step reaches a threshold.  Unless samples are given, they are labelled by the
patterns themselves over all documents: what a pattern captures is random; other words of 8 and
more characters are ordinary, but for mixtures of digits and letters, which are left unlabelled.  Only the two transition count tables (at most 67 x 67 each) are
gathered; all scanning is vectorised over batches of whole texts.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, single, slices, utf8

# fixed values: the kinds and what they match
KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HINTS = (b"passw", b"secret", b"token", b"api")
_LEAST = {"assign": 12, "access": 18, "hex": 16}

_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdef")] = True
_TOKEN_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_INDEX = np.full(256, -1, dtype=np.int64)
_INDEX[list(_TOKEN_BYTES)] = np.arange(len(_TOKEN_BYTES))
STATES = len(_TOKEN_BYTES)
BACKOFF = 20.0


def _runs(inside: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of flagged bytes of one text, of at least ``least`` bytes."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (edge[:n] | ~np.concatenate([[False], inside[:-1]])))
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    long = end - start >= least
    return start[long], end[long]


def base_spans(raw: np.ndarray, offsets: np.ndarray, assign: str = "value") -> list[tuple[int, int, str]]:
    """Byte spans (start, end, kind) of the fixed patterns; for ``assign`` the value, group 2, or the whole match."""
    first = 0 if assign == "match" else 2
    found = [(int(a), int(b), "hex") for a, b in zip(*_runs(_HEX[raw], offsets, _LEAST["hex"]))]
    data = raw.tobytes()
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        text = data[lo:hi]
        if b"AKIA" in text:
            found += [(lo + m.start(), lo + m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= _LEAST["access"]]
        lowered = text.lower()
        if any(h in lowered for h in _HINTS):
            found += [(lo + m.start(first), lo + m.end(2), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= _LEAST["assign"]]
    return found


def transitions(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Counts of character pairs inside the spans (bytes outside the token alphabet are skipped)."""
    flags = np.zeros(len(raw) + 1, dtype=np.int64)
    np.add.at(flags, start, 1)
    np.add.at(flags, np.maximum(end - 1, start), -1)
    at = np.flatnonzero(np.cumsum(flags[:-1]) > 0)
    a, b = _INDEX[raw[at]], _INDEX[raw[np.minimum(at + 1, len(raw) - 1)]]
    ok = (a >= 0) & (b >= 0)
    return np.bincount(a[ok] * STATES + b[ok], minlength=STATES * STATES)


def _outside(start: np.ndarray, end: np.ndarray, taken: list[tuple[int, int, str]]) -> np.ndarray:
    """Which spans overlap none of ``taken``."""
    if not taken or not len(start):
        return np.ones(len(start), dtype=bool)
    taken = sorted((a, b) for a, b, _ in taken)
    lows, reach = np.array([a for a, _ in taken]), np.maximum.accumulate(np.array([b for _, b in taken]))
    before = np.searchsorted(lows, end) - 1
    return (before < 0) | (reach[np.maximum(before, 0)] <= start)


def _mixed(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Tokens that are no clear example of an ordinary identifier: of capitals, small letters and digits
    together, or of letters with a quarter or more digits."""
    upper, lower, digit = (np.concatenate([[0], np.cumsum((raw >= a) & (raw <= b))]) for a, b in ((65, 90), (97, 122), (48, 57)))
    u, w, d = (c[end] - c[start] for c in (upper, lower, digit))
    return ((u > 0) & (w > 0) & (d > 0)) | ((u + w > 0) & (4 * d >= end - start))


def _count(batches):
    """(text) -> (label, pair, n), summed per task."""
    total = np.zeros((2, STATES * STATES), dtype=np.int64)
    for batch in batches:
        texts = single(batch.column("text"))
        for lo, hi in slices(texts):
            raw, offsets = utf8(texts.slice(lo, hi - lo))
            if not len(raw):
                continue
            spans = base_spans(raw, offsets)
            if spans:
                total[1] += transitions(raw, np.array([s[0] for s in spans]), np.array([s[1] for s in spans]))
            start, end = _runs(_INDEX[raw] >= 0, offsets, 8)
            free = _outside(start, end, spans) & ~_mixed(raw, start, end)
            total[0] += transitions(raw, start[free], end[free])
    label, pair = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(label, pa.int64()), pa.array(pair, pa.int64()), pa.array(total[label, pair])],
                                     ["label", "pair", "n"])


def _count_samples(batches):
    """Labelled samples (text, label) -> (label, pair, n)."""
    total = np.zeros((2, STATES * STATES), dtype=np.int64)
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
            if len(raw) and label in (0, 1):
                total[label] += transitions(raw, np.zeros(1, np.int64), np.array([len(raw)]))
    label, pair = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(label, pa.int64()), pa.array(pair, pa.int64()), pa.array(total[label, pair])],
                                     ["label", "pair", "n"])


def train_ratio(docs: DataFrame, samples: DataFrame | None = None) -> np.ndarray:
    """Log ratio (random over ordinary) of each transition; flat where nothing was learned.

    A transition is smoothed by BACKOFF counts of the next character's own share, that by add-one.
    """
    frame = (arrow_map(docs, _count, "label long, pair long, n long") if samples is None
             else arrow_map(samples.select("text", "label"), _count_samples, "label long, pair long, n long"))
    count = np.zeros((2, STATES, STATES))
    for row in frame.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect():
        count[row.label].flat[row.pair] += row.n
    share = count.sum(axis=1, keepdims=True) + 1
    share /= share.sum(axis=2, keepdims=True)
    prob = (count + BACKOFF * share) / (count.sum(axis=2, keepdims=True) + BACKOFF)
    return np.log(prob[1] / prob[0]).ravel()


def _scan(ratio: np.ndarray, least: int, threshold: float, assign: str = "value"):
    def run(batches):
        for batch in batches:
            texts, ids = single(batch.column("text")), single(batch.column("doc_id"))
            for lo, hi in slices(texts):
                raw, offsets = utf8(texts.slice(lo, hi - lo))
                spans = base_spans(raw, offsets, assign)
                if len(raw):
                    index = _INDEX[raw]
                    start, end = _runs(index >= 0, offsets, least)
                    step = np.maximum(index[:-1], 0) * STATES + np.maximum(index[1:], 0)
                    total = np.concatenate([[0.0], np.cumsum(ratio[step])])
                    mean = (total[end - 1] - total[start]) / np.maximum(end - 1 - start, 1)
                    hit = (mean >= threshold) & _outside(start, end, spans)
                    spans += [(int(a), int(b), "markov") for a, b in zip(start[hit], end[hit])]
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                own: dict[int, list] = {}
                if spans:
                    rows = np.searchsorted(offsets, [s[0] for s in spans], side="right") - 1
                    for row, (a, b, kind) in zip(rows.tolist(), spans):
                        base = points[offsets[row]]
                        own.setdefault(row, []).append((int(points[a] - base), KINDS.index(kind), int(points[b] - base)))
                cols = [[], [], [], [], []]
                none = hashlib.sha256(b"").hexdigest()
                for row in range(hi - lo):
                    found = sorted(own.get(row, ()))
                    say = [f"{KINDS[k]}:{a}:{b}" for a, k, b in found]
                    base = ",".join(s for s, f in zip(say, found) if f[1] < 3)
                    for c, k in enumerate(range(3)):
                        cols[c].append(sum(f[1] == k for f in found))
                    cols[3].append(hashlib.sha256(base.encode()).hexdigest() if base else none)
                    cols[4].append(",".join(say))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: DataFrame | None = None,
                 least: int = 20, threshold: float = 0.7, assign: str = "value") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` per row, from the whole text.

    Spans are code points, end exclusive, listed by start and kind as ``kind:start:end``.  Base kinds are
    found per kind, leftmost and non-overlapping; matches that are too short are dropped.  The span of an
    ``assign`` secret is its value, or with ``assign="match"`` the whole match from the name on; the models
    learn from the value either way.  ``markov`` adds
    maximal runs of ``[A-Za-z0-9+/_=-]`` of at least ``least`` characters that no base span overlaps and
    whose mean log-likelihood ratio is at least ``threshold``.  ``samples`` (text, label: 1 random, 0
    ordinary) replaces the default training; an empty sample leaves a flat model.  A null text is empty and
    has no spans; a null id is returned as null; repeated rows are each returned.  Other columns are not
    read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ratio = train_ratio(rows.select("text"), samples)
    kind = dict(rows.dtypes)["doc_id"]
    return arrow_map(rows, _scan(ratio, least, threshold, assign),
                     f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
