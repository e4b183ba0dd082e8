"""Benchmark decontamination by CGK embedding and bit-sampling LSH, confirmed by exact edit distance.

Texts and items are sequences of normalised words.  The CGK random walk copies the current word
and then advances or stays by a random bit of (step, word); two sequences few edits apart have
embeddings of small Hamming distance.  Each repetition has its own walk and its own sample of
steps; windows of an item's size whose sampled words agree with the item's are candidates, and an
edit distance on words decides.  Walks are as long as the item needs, and as many go backwards from
the passage's last word as forwards from its first, so edits close together at either end leave whole
walks alone.

Every word position of every whole text starts a window.  Before the walks, a window is left out
if it cannot be within ``e`` edits of any item of ``n`` words: an edit changes at most ``q`` of the item's
runs of ``q`` words, so ``n - q + 1 - q * e`` of them, for each q of ``RUNS``, must lie in the ``n + e`` words
from the window's start.  Running counts over all words say how many runs of some item lie there;
the counts are never too low, so nothing is lost by it.

The items are a parameter table: their words go to the tasks in blocks of at most ``block_words``
words (8 MB), one pass over the texts per block, so any number of items is worked through.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, mix, single, slices, utf8, words_of

_SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_PAD = np.uint64(1)
RUNS = (1, 2, 3)  # lengths of the word runs that are counted before the walks


def item_words(text: str | None) -> np.ndarray:
    """Hashes of the normalised words: lower case, ASCII letters and digits and all other letters."""
    raw = np.frombuffer((text or "").lower().encode(), dtype=np.uint8)
    return words_of(raw, np.array([0, len(raw)]), _SEPARATORS)[2]


def allowed(n: int, ratio: float) -> int:
    return int(n * ratio)


@lru_cache(maxsize=1 << 16)
def _odd(step: int, rep: int) -> np.uint64:
    return mix(np.array([rep << 32 | step], dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))[0] | np.uint64(1)


def _bit(words: np.ndarray, step: int, rep: int) -> np.ndarray:
    """Random bit of (repetition, step, word): the top bit of a multiplicative hash of the word's hash."""
    return ((words * _odd(step, rep)) >> np.uint64(63)).astype(np.int64)


def _sampled(rep: int, samples: int, steps: int) -> list[int]:
    rng = np.random.Generator(np.random.PCG64(1000 + rep))
    return sorted(rng.choice(steps, size=min(samples, steps), replace=False).tolist())


def _embed(words: np.ndarray, start: np.ndarray, end: np.ndarray, rep: int, samples: list[int],
           wanted: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Walk from ``start`` (within texts that end at ``end``); hash the words shown at the sampled steps.

    Returns the starts still walking and, per sampled step, the hashes so far.  With ``wanted``
    (sorted hashes per sampled step), a walk ends once its hash is not among them: it could agree
    with no item at the remaining samples.
    """
    at, sig, seen = start, np.zeros(len(start), dtype=np.uint64), []
    chosen = set(samples)
    for step in range(samples[-1] + 1):
        inside = at < end
        here = np.where(inside, words[np.minimum(at, len(words) - 1)], _PAD)
        if step in chosen:
            sig = mix(sig * np.uint64(0xD6E8FEB86659FD93) + here)
            if wanted is not None:
                table = wanted[len(seen)]
                keep = table[np.minimum(np.searchsorted(table, sig), len(table) - 1)] == sig
                start, at, end, sig, here, inside = (x[keep] for x in (start, at, end, sig, here, inside))
            seen.append(sig)
        at = at + np.where(inside, _bit(here, step, rep), 0)
    return start, seen


def best_window(item, text, most: int) -> tuple[int, int, int]:
    """(distance, start, end) of the substring of ``text`` nearest to ``item`` (distance over ``most``: most + 1).

    Semi-global edit distance with the start carried along; of equal distances the first end, then the latest
    start.  One row of the table per word of the item, each as whole-array steps: a cell is
    ``distance * unit - start``, so the least cell is the least distance with the latest start, and the step along
    the row is a running minimum.
    """
    item, text = np.asarray(item, dtype=np.uint64), np.asarray(text, dtype=np.uint64)
    place = np.arange(len(text) + 1, dtype=np.int64)
    unit = len(text) + 1
    cell = -place
    for i, word in enumerate(item, 1):
        new = cell + unit
        np.minimum(new[1:], cell[:-1] + np.where(text != word, unit, 0), out=new[1:])
        new[0] = i * unit
        new -= place * unit
        np.minimum.accumulate(new, out=new)
        cell = new + place * unit
    cost = -(-cell // unit)
    end = int(cost.argmin())
    if cost[end] > most:
        return most + 1, 0, 0
    return int(cost[end]), int(cost[end] * unit - cell[end]), end


def _runs(words: np.ndarray, q: int) -> np.ndarray:
    """Hash of the ``q`` words from each position on that has as many."""
    code = words[:max(len(words) - q + 1, 0)]
    for i in range(1, q):
        code = mix(code * np.uint64(0xD6E8FEB86659FD93) + words[i:i + len(code)])
    return code


def _class(n: int) -> int:
    """Items of n words walk with those of the same upper three bits of n; the class is the least such n."""
    low = max(n.bit_length() - 3, 0)
    return n >> low << low


def _steps(c: int) -> int:
    """Length of the walk of a class: a step shows half a word, so it shows about all words of the class's least item."""
    return 2 * c


def repetitions(ratio: float, samples: int, target: float) -> int:
    """Repetitions, of each direction, that find a passage with probability ``target`` when ``2 * ratio`` of a walk's steps differ."""
    hit = max(1 - 2 * ratio, 0.1) ** samples
    return max(1, math.ceil(math.log(1 - target) / math.log(1 - hit)))


class Index:
    """Sampled signatures of a block of items, per size and repetition."""

    def __init__(self, items: list[tuple[int, np.ndarray]], ratio: float, reps: int, samples: int):
        self.items, self.ratio, self.reps, self.samples = items, ratio, reps, samples
        self.counts = [Counter(w.tolist()) for _, w in items]
        # per q, which slots of a table the items' runs of q words fall into: at most 1 in 16 is taken
        self.known: dict[int, tuple[np.uint64, np.ndarray]] = {}
        for q in RUNS:
            runs = np.unique(np.concatenate([_runs(w, q) for _, w in items]))
            bits = max(16, len(runs).bit_length() + 4)
            table = np.zeros(1 << bits, dtype=bool)
            table[runs >> np.uint64(64 - bits)] = True
            self.known[q] = np.uint64(64 - bits), table
        self.sizes: dict[int, list[int]] = {}
        for i, (_, w) in enumerate(items):
            self.sizes.setdefault(len(w), []).append(i)
        # class -> per repetition, first all forwards, then all backwards: sampled steps, hashes wanted, signatures, items
        self.tables: dict[int, list[tuple]] = {}
        for c in sorted({_class(n) for n in self.sizes}):
            own = np.array([i for n, of in self.sizes.items() if _class(n) == c for i in of])
            end = np.cumsum([len(items[i][1]) for i in own])
            start = np.concatenate([[0], end[:-1]])
            ways = [np.concatenate([items[i][1][::way] for i in own]) for way in (1, -1)]
            for rep in range(2 * reps):
                chosen = _sampled(rep, samples, _steps(c))
                sigs = np.stack(_embed(ways[rep >= reps], start, end, rep, chosen)[1], axis=1)
                order = np.argsort(sigs[:, -1], kind="stable")
                self.tables.setdefault(c, []).append(
                    (chosen, [np.unique(sigs[:, j]) for j in range(sigs.shape[1])], sigs[order, -1], own[order]))

    def candidates(self, words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> set[tuple[int, int]]:
        """(start word, item) pairs that some repetition finds; ``begins`` and ``ends``: those of each word's text.

        Backwards, walks start at a passage's last word, so edits at its beginning come last.
        """
        count = len(words)
        counts = {q: np.concatenate([[0], np.cumsum(table[_runs(words, q) >> shift], dtype=np.int32)])
                  for q, (shift, table) in self.known.items()}
        found = set(self._walked(words, ends, counts, slice(0, self.reps)))
        counts = {q: of[-1] - of[::-1] for q, of in counts.items()}
        for at, i in self._walked(words[::-1], count - begins[::-1], counts, slice(self.reps, None)):
            found.add((max(int(begins[count - 1 - at]), count - at - len(self.items[i][1])), i))
        return found

    def _likely(self, sizes: list[int], ends: np.ndarray, counts: dict[int, np.ndarray]) -> np.ndarray:
        """Starts of windows that enough runs of the items lie in to be within the limit of one of ``sizes`` words."""
        def enough(first: np.ndarray, some: list[int]) -> np.ndarray:
            """Of ``first``, those that pass what all of ``some`` ask at least."""
            most = max(n + allowed(n, self.ratio) for n in some)
            for q, before in counts.items():
                need = min(n - q + 1 - q * allowed(n, self.ratio) for n in some)
                if need > 0:
                    first = first[before[np.minimum(first + most, ends[first]) - q + 1] - before[first] >= need]
            return first

        least = min(n - allowed(n, self.ratio) for n in sizes)
        first = enough(np.flatnonzero(ends - np.arange(len(ends)) >= least), sizes)
        own = [first[ends[first] - first >= n - allowed(n, self.ratio)] for n in sizes]
        return np.unique(np.concatenate([enough(x, [n]) for n, x in zip(sizes, own)]))

    def _walked(self, words: np.ndarray, ends: np.ndarray, counts: dict[int, np.ndarray], reps: slice) -> set[tuple[int, int]]:
        """(first word, item) pairs that some of the repetitions find; ``counts``: per q, known runs before each place."""
        if not len(words):
            return set()
        found: set[tuple[int, int]] = set()
        for c, by_rep in self.tables.items():
            first = self._likely([n for n in self.sizes if _class(n) == c], ends, counts)
            limit = ends[first]
            for rep, (chosen, wanted, table, own) in enumerate(by_rep[reps], reps.start):
                start, seen = _embed(words, first, limit, rep, chosen, wanted)
                lo = np.searchsorted(table, seen[-1], side="left")
                hi = np.searchsorted(table, seen[-1], side="right")
                for at, x, y in zip(start.tolist(), lo.tolist(), hi.tolist()):
                    found.update((at, i) for i in own[x:y].tolist())
        return found

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, int, int, int]]:
        """(row, item, edits, words of the item, start, end) per row and item: the best place in the text."""
        lowered = pa.array([(t or "").lower() for t in texts.to_pylist()], pa.large_string())
        raw, offsets = utf8(lowered)
        start, end, words, first = words_of(raw, offsets, _SEPARATORS)
        rows = np.repeat(np.arange(len(texts)), np.diff(first))
        best: dict[tuple[int, int], tuple] = {}
        places: dict[tuple[int, int], list[list[int]]] = {}  # per row and item, the stretches round its candidates
        for at, i in sorted(self.candidates(words, first[:-1][rows], first[1:][rows])):
            row, n = int(rows[at]), len(self.items[i][1])
            most = allowed(n, self.ratio)
            lo, hi = max(int(first[row]), at - most), min(int(first[row + 1]), at + n + most)
            own = places.setdefault((row, i), [])
            if own and lo <= own[-1][1]:
                own[-1][1] = max(hi, own[-1][1])
            else:
                own.append([lo, hi])
        for key, own in places.items():
            item = self.items[key[1]][1]
            most = allowed(len(item), self.ratio)
            for lo, hi in own:
                if key in best and best[key][0] == 0:
                    break
                part = words[lo:hi]
                if (self.counts[key[1]] & Counter(part.tolist())).total() < len(item) - most:
                    continue
                edits, a, b = best_window(item, part, most)
                if edits <= most and (key not in best or (edits, lo + a) < best[key][:2]):
                    best[key] = (edits, lo + a, lo + b)
        out = []
        for (row, i), (edits, a, b) in best.items():
            base = int(offsets[row])
            text = raw[base:int(offsets[row + 1])].tobytes()
            out.append((row, i, edits, len(self.items[i][1]),
                        len(text[:int(start[a]) - base].decode()), len(text[:int(end[b - 1]) - base].decode())))
        return out


_INDEXES: dict[bytes, Index] = {}


def _find(items: list[tuple[int, bytes]], ratio: float, reps: int, samples: int):
    def run(batches):
        key = repr((ratio, reps, samples)).encode() + b"".join(i.to_bytes(8, "little", signed=True) + w for i, w in items)
        if key not in _INDEXES:
            _INDEXES.clear()
            _INDEXES[key] = Index([(i, np.frombuffer(w, dtype=np.uint64)) for i, w in items], ratio, reps, samples)
        index = _INDEXES[key]
        for batch in batches:
            texts, docs = single(batch.column("text")), single(batch.column("doc_id"))
            for lo, hi in slices(texts, 1 << 22):
                found = index.matches(texts.slice(lo, hi - lo))
                ids = docs.slice(lo, hi - lo).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[f[0]] for f in found], pa.int64()), pa.array([index.items[f[1]][0] for f in found], pa.int64()),
                     *(pa.array([f[c] for f in found], pa.int64()) for c in (2, 3, 4, 5))],
                    ["doc_id", "item_id", "edits", "item_words", "start", "end"])
    return run


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text", ratio: float = 0.2, samples: int = 3,
                 target: float = 0.99, block_words: int = 1_000_000) -> DataFrame:
    """Benchmark passages in documents: ``doc_id, item_id, edits, item_words, start, end`` per document and item found.

    A document holds an item if some part of its word sequence is within ``floor(ratio * words of the
    item)`` word edits of it; the part of fewest edits (the first of these) is returned, as positions in
    the lower-cased text (end exclusive).  Words are lower-cased runs of letters and digits.  Null or
    empty texts hold nothing; null, empty or word-free items are found nowhere.  Items of equal text are
    each found; repeated rows give repeated results; a null id is returned as null.  Other columns are not
    read.  Empty tables on either side give an empty result.  A very long text is one unit of work: time grows with
    its words (times the item's words where candidates lie side by side), memory with its words.  The number of repetitions follows from ``target``, the recall wanted of passages with as many
    edits as allowed; exact copies agree with their item in every repetition.
    """
    reps = repetitions(ratio, samples, target)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_id_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("t is not null and i is not null")
    schema = "doc_id long, item_id long, edits long, item_words long, start long, end long"
    out, block, held = None, [], 0

    def passed(block):
        return arrow_map(docs, _find(block, ratio, reps, samples), schema)

    for row in items.distinct().orderBy("i", "t").toLocalIterator():
        words = item_words(row.t)
        if len(words):
            if held + len(words) > block_words and block:
                out, block, held = passed(block) if out is None else out.unionByName(passed(block)), [], 0
            block.append((row.i, words.tobytes()))
            held += len(words)
    if block:
        out = passed(block) if out is None else out.unionByName(passed(block))
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)
