"""Language ID by rank-order n-gram profiles (out-of-place distance).

A profile is the list of the most frequent 1- to 3-grams of letters, words padded with a blank.  A
language's profile is counted over a bounded sample of its labelled documents; a document's is
taken from its whole text.  The distance adds, over the document's most frequent n-grams, how far
each is out of its place in the language's profile (the profile's length where it is missing).

Counting works on whole batches: letters get numbers of 18 bits, an n-gram is one integer, and one
sort of (row, n-gram) integers counts every n-gram of every text exactly.  A second sort ranks each
text's n-grams by count; those of no profile keep their places and are equally far from every language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, held_out, single, slices

ORDERS = (1, 2, 3)
_ODD = 0x9E3779B97F4A7C15
BITS = 18  # of a letter's number; all letters of Unicode take fewer than 2 ** 18
_BLANK = 1
PART = 1 << 18  # bytes of text whose n-grams are sorted at a time (or one longer text)
_LETTER = np.zeros(0x110000, dtype=np.uint64)


def _letters() -> np.ndarray:
    """Number of each code point: letters in their order from 2, all else is a blank."""
    if not _LETTER[97]:
        found = [c for c in range(0x110000) if chr(c).isalpha()]
        _LETTER[:] = _BLANK
        _LETTER[found] = np.arange(2, len(found) + 2)
    return _LETTER


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the lower-cased code points with a blank for every non-letter and around each text; row of each."""
    lowered = [f" {t.lower()} " if t else " " for t in texts]
    cp = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _letters()[cp], np.repeat(np.arange(len(texts)), [len(t) for t in lowered])


def _grams(cp: np.ndarray):
    """Per order: n-gram codes and the position of each; blanks only at the ends, never blanks alone."""
    letter = cp != _BLANK
    for n in ORDERS:
        m = len(cp) - n + 1
        if m <= 0:
            continue
        code = cp[:m].copy()
        for i in range(1, n):
            code |= cp[i:m + i] << np.uint64(BITS * i)
        if n == 1:
            at = np.flatnonzero(letter)
        elif n == 2:
            at = np.flatnonzero(letter[:m] | letter[1:m + 1])
        else:
            at = np.flatnonzero(letter[1:m + 1])
        yield code[at], at


def _first(key: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), dtype=bool), key[1:] != key[:-1]]))


def ranked(cp: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and code of each text's ``size`` most frequent n-grams, the smaller code first among equals."""
    width = np.uint64(BITS * ORDERS[-1])
    parts = [row[at].astype(np.uint64) << width | code for code, at in _grams(cp)]
    key = np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
    start = _first(key)
    count = np.diff(np.append(start, len(key)))
    key = key[start]
    own = key >> width
    # the row, then how much rarer than the most frequent, then the place in the order of codes
    rarer, place = (np.uint64(int(x).bit_length()) for x in (count.max(initial=0), len(key)))
    order = np.sort(own << (rarer + place) | (count.max(initial=0) - count).astype(np.uint64) << place | np.arange(len(key), dtype=np.uint64))
    order = (order & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
    own = own[order].astype(np.int64)
    start = _first(own)
    at = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
    top = at < size
    return own[top], at[top], key[order[top]] & ((np.uint64(1) << width) - np.uint64(1))


def _count_sample():
    """(lang, text) -> (lang, gram, n) summed per batch."""
    def run(batches):
        for batch in batches:
            langs, texts = np.array(batch.column("lang").to_pylist(), dtype=object), batch.column("text").to_pylist()
            out = [[], [], []]
            for lang in sorted(set(langs)):
                cp, _ = _codes([t or "" for t, own in zip(texts, langs == lang) if own])
                for code, _ in _grams(cp):
                    gram, n = np.unique(code, return_counts=True)
                    out[0].extend([lang] * len(gram))
                    out[1].append(gram.view(np.int64))
                    out[2].append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), *(pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in out[1:])],
                ["lang", "gram", "n"])
    return run


def train_profiles(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str,
                   size: int = 400, sample: int = 1000) -> dict[str, list[int]]:
    """Most frequent n-grams per language, from the ``sample`` learnable documents of smallest id hash."""
    labelled = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = (labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
              .withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).select("id", "lang").distinct())
    texts = (labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
             .join(F.broadcast(chosen), ["id", "lang"]))  # at most ``sample`` ids a language
    counts = (arrow_map(texts.select("lang", "text"), _count_sample(), "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= size).orderBy("lang", "r").collect()
    profiles: dict[str, list[int]] = {}
    for row in top:  # ``size`` rows a language
        profiles.setdefault(row.lang, []).append(row.gram)
    return profiles


class Profiles:
    """Language profiles as one look-up table of n-gram codes and a rank matrix."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.langs, self.size = sorted(profiles), size
        self.vocabulary = np.unique(np.array([g for of in profiles.values() for g in of], dtype=np.int64)).view(np.uint64)
        self.rank = np.full((len(self.langs), len(self.vocabulary)), size, dtype=np.int32)
        position = {int(g): i for i, g in enumerate(self.vocabulary.view(np.int64))}
        for i, lang in enumerate(self.langs):
            for r, gram in enumerate(profiles[lang]):
                self.rank[i, position[gram]] = r
        bits = max(12, int(np.ceil(np.log2(len(self.vocabulary) + 1))) + 6)
        odd = _ODD
        while True:  # a multiplier for which no two n-grams of the vocabulary share a slot
            slot = (self.vocabulary * np.uint64(odd)) >> np.uint64(64 - bits)
            if len(np.unique(slot)) == len(slot):
                break
            odd = (odd * _ODD + 2) % (1 << 64) | 1
            bits = min(bits + 1, 24)
        self.odd, self.shift = np.uint64(odd), np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, dtype=np.int32)
        self.table[slot] = np.arange(len(self.vocabulary))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Per text the nearest language, its score ``1 - nearest / second`` distance, and its likeness to the
        profile, ``1 - nearest``; without a letter ``und``, 0 and 0."""
        cp, row = _codes(texts)
        own, place, code = ranked(cp, row, self.size)
        gram = self.table[(code * self.odd) >> self.shift]
        known = self.vocabulary[gram] == code
        has_letter = np.bincount(row[cp != _BLANK], minlength=len(texts)) > 0
        found = np.maximum(np.bincount(own, minlength=len(texts)), 1)
        distance = np.ones((len(texts), len(self.langs)))
        for i, rank in enumerate(self.rank):
            there = np.where(known, rank[gram], self.size)
            away = np.where(there < self.size, np.abs(there - place), self.size)
            distance[:, i] = np.bincount(own, weights=away, minlength=len(texts)) / (found * self.size)
        best = distance.argmin(axis=1)
        near = np.sort(distance, axis=1)
        second = near[:, 1] if len(self.langs) > 1 else np.ones(len(texts))
        score = np.clip(1 - near[:, 0] / np.maximum(second, 1e-12), 0.0, 1.0)
        return ([self.langs[b] if ok else "und" for b, ok in zip(best, has_letter)],
                np.where(has_letter, score, 0.0), np.where(has_letter, 1 - near[:, 0], 0.0))


def _predict(profiles: dict[str, list[int]], size: int):
    def run(batches):
        model = Profiles(profiles, size) if profiles else None
        for batch in batches:
            texts = single(batch.column("text"))
            for lo, hi in slices(texts, PART):
                part = [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
                for a in range(0, len(part), 512):
                    own = part[a:a + 512]
                    langs, scores = model.predict(own)[:2] if model else (["und"] * len(own), np.zeros(len(own)))
                    yield pa.RecordBatch.from_arrays(
                        [*(single(batch.column(c)).slice(lo + a, len(own)) for c in batch.schema.names if c != "text"),
                         pa.array(langs, pa.string()), pa.array(scores)],
                        [*(c for c in batch.schema.names if c != "text"), "lang_pred", "score"])
    return run


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       size: int = 400, sample: int = 1000) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row, from the whole text alone.

    Profiles are learned from documents with a language whose id's crc32 (as text) modulo 5 is not 0,
    at most ``sample`` per language (those of smallest id hash).  A null text or one without a letter
    is ``und`` with score 0, as is every text when nothing can be learned; a text whose n-grams are in
    no profile gets the first language with score 0.  Equal distances go to the first language by
    name.  A row with a null id is predicted and never learned from (``held_out`` null); repeated
    rows are predicted alike.  Other columns are not read.  Empty tables give an empty result; a very long
    text is one unit of work, in memory proportional to it.
    """
    learn = F.coalesce(~held_out(F.col(id_col)), F.lit(False))
    profiles = train_profiles(docs, learn, id_col, text_col, lang_col, size, sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return arrow_map(rows, _predict(profiles, size), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def _keep_recognised(profiles: dict[str, list[int]], size: int, text_col: str, least: float):
    def run(batches):
        model = Profiles(profiles, size) if profiles else None
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            texts = single(batch.column(text_col))
            for lo, hi in slices(texts, PART):
                part = [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
                for a in range(0, len(part), 512):
                    own = part[a:a + 512]
                    if model:
                        langs, _, likeness = model.predict(own)
                        keep[lo + a:lo + a + len(own)] = (np.array(langs) != "und") & (likeness >= least)
            yield batch.filter(pa.array(keep))
    return run


def recognised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
               size: int = 400, sample: int = 1000, least: float = 0.0) -> DataFrame:
    """The rows of ``docs``, with all their columns, in whose text one of the learned languages is recognised.

    Learned as in ``identify_languages``.  Rejected are the cases that are ``und`` there and texts whose
    out-of-place distance to every profile is over ``1 - least`` of the greatest possible: at 0.25, scripts of no
    learned language and random letters (likeness 0 to 0.23; documents of sf0.1 and check_s have 0.41 or more).  Empty tables give an empty result; a very long
    text is one unit of work, in memory proportional to it.
    """
    learn = F.coalesce(~held_out(F.col(id_col)), F.lit(False))
    profiles = train_profiles(docs, learn, id_col, text_col, lang_col, size, sample)
    return arrow_map(docs, _keep_recognised(profiles, size, text_col, least), docs.schema)
