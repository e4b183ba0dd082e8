"""Phrase collocation mining: frequent phrases of 2 to 4 words per language by Rabin-Karp fingerprints.

numpy prefix polynomials over the word hashes of a chunk of texts give the 64-bit fingerprint of every
n-gram of it at once.  The work is three passes over the texts and one shuffle each:

1. Fingerprint counts of all word pairs, then of the triples whose two pairs may be frequent, are added up
   per task and shuffled.  A fingerprint count is never below the count of any phrase behind it, so what
   stays under ``min_count`` holds no frequent phrase.  The survivors are kept as a bitmap of fixed size
   (``filter_bits``): a false positive costs work, never a result.
2. The last pass keeps, for every surviving fingerprint, a pointer to one occurrence, compares all other
   occurrences of the chunk with the text at the pointer (a fingerprint that stands for two texts is
   split), and materialises the text of each group once.  The shuffle then counts by text, so the counts
   are exact whatever the fingerprints did.

Scores, containment and ranks work on the frequent phrases alone, in exact decimal arithmetic.

Defined results: a null text is empty, a null ``lang`` is ``und``; an empty table gives no rows; repeated rows
count as often as they are there; phrases of equal score and count are ranked by their UTF-8 bytes; other
columns of the input are ignored.  A task holds one chunk of at most ``CHUNK`` text bytes, or one longer text,
and arrays of about 60 times that size.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _BASE, _BASE_INV, _LOWER, _powers, arrow_map, materialize, mix, single, slices, utf8, words_of

LONGEST = 4
CHUNK = 1 << 21
FLUSH = 1 << 21
SALTS = {1: 16, 2: 4, 3: 1}

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SEPARATOR = _BREAK.copy()
_SEPARATOR[[0x20, 0x09]] = True


def _runs(lengths: np.ndarray) -> np.ndarray:
    """0 .. n-1 for every n of ``lengths``, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


class Chunk:
    """The words of some texts and the fingerprints of their n-grams.

    ``mask`` narrows word hashes and fingerprints (tests use it to force collisions).
    """

    def __init__(self, texts: pa.Array, langs: pa.Array, mask: int = (1 << 64) - 1):
        self.mask = np.uint64(mask)
        raw, offsets = utf8(texts)
        self.raw = raw
        self.start, self.end, word, first = words_of(raw, offsets, _SEPARATOR)
        self.word = word & self.mask
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        codes = langs.fill_null("und").dictionary_encode()
        self.names = codes.dictionary
        self.lang = codes.indices.to_numpy(zero_copy_only=False)[self.row]
        seeds = [int.from_bytes(blake2b(s.encode(), digest_size=8).digest(), "little") for s in self.names.to_pylist()]
        self.seed = np.array(seeds, dtype=np.uint64)[self.lang] if seeds else np.empty(0, np.uint64)
        n = len(word)
        breaks = np.cumsum(_BREAK[raw], dtype=np.int64)[self.start] if n else np.empty(0, np.int64)
        new = np.ones(n, dtype=bool)
        new[1:] = (breaks[1:] != breaks[:-1]) | (self.row[1:] != self.row[:-1])
        self.piece = np.cumsum(new)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(word * _powers(_BASE, n), out=self.prefix[1:])
        self.inverse = _powers(_BASE_INV, n)

    def fingerprints(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, whether it lies within one piece) of the n-gram at every word."""
        size = max(len(self.word) - n + 1, 0)
        fp = (self.prefix[n:n + size] - self.prefix[:size]) * self.inverse[:size]
        whole = self.piece[n - 1:n - 1 + size] == self.piece[:size]
        return mix(fp ^ self.seed[:size] + np.uint64(n)) & self.mask, whole

    def word_ids(self) -> np.ndarray:
        """An id per word, equal for equal words only: hash groups are checked byte by byte."""
        _, at, group = np.unique(self.word, return_index=True, return_inverse=True)
        size, other = self.end - self.start, at[group]
        if np.array_equal(size, size[other]):
            step = _runs(size)
            low = _LOWER[self.raw]
            if np.array_equal(low[np.repeat(self.start, size) + step], low[np.repeat(self.start[other], size) + step]):
                return at[group]
        seen: dict[bytes, int] = {}
        low = _LOWER[self.raw].tobytes()
        return np.array([seen.setdefault(low[a:b], i) for i, (a, b) in
                         enumerate(zip(self.start.tolist(), self.end.tolist()))], dtype=np.int64)

    def groups(self, at: np.ndarray, fp: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """Occurrences ``at`` of n-grams grouped by text: (pointer to one occurrence, count, smallest row)."""
        order = np.argsort(fp, kind="stable")
        at, fp = at[order], fp[order]
        begin = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1]))) if len(fp) else np.empty(0, np.int64)
        count = np.diff(np.append(begin, len(fp)))
        head = np.repeat(at[begin], count)
        same = self.lang[at] == self.lang[head]
        for j in range(n):
            same &= ids[at + j] == ids[head + j]
        if not same.all():
            keys = np.stack([self.lang[at], *[ids[at + j] for j in range(n)]])
            order = np.lexsort(keys)
            at, keys = at[order], keys[:, order]
            begin = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))
            count = np.diff(np.append(begin, len(at)))
        rows = np.minimum.reduceat(self.row[at], begin) if len(at) else np.empty(0, np.int64)
        return at[begin], count, rows

    def texts(self, at: np.ndarray, n: int, ids: np.ndarray) -> pa.Array:
        """The n words from each of ``at`` on, lower-cased and joined by one space."""
        used, code = np.unique(np.concatenate([ids[at + j] for j in range(n)]), return_inverse=True)
        size = self.end[used] - self.start[used]
        data = _LOWER[self.raw[np.repeat(self.start[used], size) + _runs(size)]]
        ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        words = pa.StringArray.from_buffers(len(used), pa.py_buffer(ends), pa.py_buffer(data))
        parts = [words.take(pa.array(c)) for c in code.reshape(n, -1)]
        return parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")


def _chunks(batches, mask: int, by_doc: bool = False):
    for batch in batches:
        texts = single(batch.column("text"))
        for lo, hi in slices(texts, CHUNK):
            part = batch.slice(lo, hi - lo)
            if by_doc:
                part = part.take(pc.sort_indices(part.column("doc_id"), null_placement="at_end"))
            yield part, Chunk(single(part.column("text")), single(part.column("lang")), mask)


def _set_in(bits: np.ndarray, fp: np.ndarray) -> np.ndarray:
    at = fp & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _bits(broadcast) -> np.ndarray:
    return np.frombuffer(broadcast.value, dtype=np.uint8)


def _added(parts: list) -> tuple[np.ndarray, np.ndarray]:
    fp, count = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(fp, kind="stable")
    fp, count = fp[order], count[order]
    begin = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1]))) if len(fp) else np.empty(0, np.int64)
    return fp[begin], (np.add.reduceat(count, begin) if len(fp) else count)


def _frequent(docs: DataFrame, n: int, min_count: int, filter_bits: int, shorter, mask: int):
    """Broadcast bitmap of the fingerprints of n-grams that may occur ``min_count`` times in a language."""
    def run(batches):
        held, size = [], 0

        def emit(fp, count):
            return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(count)], ["fp", "n"])

        for _, chunk in _chunks(batches, mask):
            fp, whole = chunk.fingerprints(n)
            if shorter is not None:
                part = _set_in(_bits(shorter), chunk.fingerprints(n - 1)[0])
                whole &= part[:len(fp)] & part[1:len(fp) + 1]
            held.append(np.unique(fp[whole], return_counts=True))
            size += len(held[-1][0])
            if size > 2 * FLUSH:
                held = [_added(held)]
                size = len(held[0][0])
                if size > FLUSH:
                    yield emit(*held.pop())
                    size = 0
        if held:
            yield emit(*_added(held))

    counts = arrow_map(docs.select("lang", "text"), run, "fp long, n long")
    kept = counts.repartition("fp").groupBy("fp").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    place = kept.select((F.expr(f"fp & {(1 << filter_bits) - 1}L") + 1).alias("p"))
    blocks = place.groupBy(F.bitmap_bucket_number("p").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    whole = bytearray(max(1 << filter_bits >> 3, 4096))
    for r in blocks.collect():  # at most 2**filter_bits / 32768 rows of 4 KB
        whole[(r.block - 1) * 4096:r.block * 4096] = r.bits
    return docs.sparkSession.sparkContext.broadcast(bytes(whole[:1 << filter_bits >> 3]))


def phrase_counts(docs: DataFrame, min_count: int = 30, filter_bits: int = 26, mask: int = (1 << 64) - 1) -> DataFrame:
    """(lang, words, phrase, f, doc_id): words and phrases of 2 to 4 words with at least ``min_count``
    occurrences in their language, with the smallest id of a document that holds them; a row with
    ``words`` 0 and an empty phrase per language has all its word occurrences."""
    docs = docs.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    two = _frequent(docs, 2, min_count, filter_bits, None, mask)
    three = _frequent(docs, 3, min_count, filter_bits, two, mask)

    def run(batches):
        for part, chunk in _chunks(batches, mask, by_doc=True):
            doc = single(part.column("doc_id"))
            totals = np.bincount(chunk.lang, minlength=len(chunk.names))
            empty = pa.nulls(len(totals), doc.type)
            yield pa.RecordBatch.from_arrays(
                [chunk.names, pa.array(np.zeros(len(totals), np.int32)), pa.array([""] * len(totals)),
                 pa.array(totals), empty], ["lang", "words", "phrase", "f", "doc_id"])
            if not len(chunk.word):
                continue
            ids = chunk.word_ids()
            in_two, in_three = _bits(two), _bits(three)
            for n in range(1, LONGEST + 1):
                fp, whole = chunk.fingerprints(n)
                if n == 2:
                    whole &= _set_in(in_two, fp)
                elif n >= 3:
                    part3 = _set_in(in_three, chunk.fingerprints(3)[0])
                    whole &= part3[:len(fp)]
                    if n == 4:
                        whole &= part3[1:len(fp) + 1]
                at = np.flatnonzero(whole)
                if not len(at):
                    continue
                at, count, row = chunk.groups(at, fp[at], ids, n)
                yield pa.RecordBatch.from_arrays(
                    [chunk.names.take(pa.array(chunk.lang[at])), pa.array(np.full(len(at), n, np.int32)),
                     chunk.texts(at, n, ids), pa.array(count), doc.take(pa.array(row))],
                    ["lang", "words", "phrase", "f", "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = arrow_map(docs, run, f"lang string, words int, phrase string, f long, doc_id {kind}")
    counts = found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"), F.min("doc_id").alias("doc_id"))
    return counts.where((F.col("words") == 0) | (F.col("f") >= min_count))


def _exact(c) -> F.Column:
    return F.col(c).cast("decimal(20,0)")


def collocations(docs: DataFrame, min_count: int = 30, top: int = 2000, filter_bits: int = 26,
                 mask: int = (1 << 64) - 1) -> DataFrame:
    """The ``top`` phrases of every language by the score of their weakest cut.

    Returns lang, rank, phrase, a, l, r, n, score and doc_id (the smallest id of a document that holds the
    phrase).  Phrases of which a longer candidate has 80 % or more of the occurrences are left out.
    """
    known = materialize(phrase_counts(docs, min_count, filter_bits, mask))
    words = F.split("phrase", " ", -1)
    candidates = known.where("words >= 2").select("lang", "words", "phrase", F.col("f").alias("a"), "doc_id",
                                                 words.alias("w"))

    def sub(i, n):
        return F.array_join(F.slice("w", i, n), " ")

    # every cut asks for two counts; a word that is part of many phrases is spread over salted keys
    cuts = F.array(*[F.when(F.col("words") > k, F.struct(
        F.lit(k).alias("k"), F.lit(side).alias("side"), (size := (F.lit(k) if side else F.col("words") - k)).alias("size"),
        (sub(1, k) if side else sub(k + 1, size)).alias("part")))
        for k in range(1, LONGEST) for side in (True, False)])
    salts = F.element_at(F.create_map(*[F.lit(x) for kv in SALTS.items() for x in kv]), F.col("size"))
    asked = (candidates.select("lang", "phrase", F.explode(F.array_compact(cuts)).alias("c"))
             .select("lang", "phrase", "c.*").withColumn("salt", F.pmod(F.hash("phrase"), salts).cast("int")))
    answers = (known.where(F.col("words").between(1, LONGEST - 1))
               .select("lang", F.col("phrase").alias("part"), "f", F.col("words").alias("size"))
               .select("lang", "part", "f", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")))
    pairs = asked.join(answers, ["lang", "part", "salt"])
    sums = pairs.groupBy("lang", "phrase").agg(*[
        F.max(F.when((F.col("k") == k) & (F.col("side") == F.lit(side)), F.col("f"))).alias(f"{'l' if side else 'r'}{k}")
        for k in range(1, LONGEST) for side in (True, False)])
    inside = F.array(*[F.when(F.col("words") >= n + i, sub(i + 1, n))
                       for n in range(2, LONGEST) for i in range(LONGEST - n + 1)])
    covered = (candidates.where("words > 2")
               .select("lang", F.explode(F.array_compact(F.when(F.col("words") > 3, inside).otherwise(
                   F.array(sub(1, 2), sub(2, 2))))).alias("phrase"), "a")
               .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = (candidates.drop("w").join(covered, ["lang", "phrase"], "left").join(sums, ["lang", "phrase"])
            .where(F.col("longer").isNull() | (_exact("longer") * 100 < _exact("a") * 80)))
    scored = F.array_min(F.array_compact(F.array(*[
        F.when(F.col(f"l{k}").isNotNull(), F.struct(
            F.expr(f"cast(a as decimal(20,0)) * 2000000 div (cast(l{k} as decimal(20,0)) + r{k})").alias("score"),
            F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        for k in range(1, LONGEST)])))
    best = kept.select("lang", "phrase", "a", "doc_id", scored.alias("s")).select(
        "lang", "phrase", "a", "s.l", "s.r", "s.score", "doc_id")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    first = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    totals = known.where("words = 0").select("lang", F.col("f").alias("n"))
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "doc_id")
