"""Bounded-space online packing of tokenised documents into fixed-length sequences.

Each partition streams its documents once: a document is tokenised, its whole windows of
``length`` ids become sequences of their own, and the remaining tail goes best-fit into one of at
most ``open_windows`` open sequences.  When the tail fits nowhere, the fullest open sequence is
emitted; if its gap is at least ``min_cut`` the head of the tail fills it first, so an emitted
sequence lacks fewer than ``min_cut`` ids.  What is open at the end of a partition (at most
``open_windows`` sequences, with their ids) is dealt to about 1/64 as many tasks and packed again
by the same rule, until one task is left; the last sequences are cut to powers of two, which need
no padding.

Token ids come from a word cache: the tokenizer's normaliser and splitter never join across
white space, so a text's ids are those of its white-space-free chunks in order.  Texts for which
that is not plainly so (special-token strings, control separators) go to the tokenizer whole.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, single, slices

OUT = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
       "ids binary, level int")
_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "level"]
_TYPES = [pa.int64()] * 7 + [pa.binary(), pa.int32()]


class WordTokens:
    """Ids of whole texts for a lower-casing word BPE, as little-endian uint32 bytes."""

    CACHE = 400_000  # words of each of two generations
    _whole = re.compile("<\\||[\x1c-\x1f]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.byte_char = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.new, self.old = {}, {}

    def _direct(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _load(self, chunk: str) -> bytes:
        got = self.old.get(chunk)
        if got is None:
            if chunk.isascii() or max(chunk) < "ɐ":
                ids = [t.id for part in self.split(chunk)
                       for t in self.model.tokenize("".join(map(self.byte_char.__getitem__, part.encode())))]
                got = np.array(ids, dtype="<u4").tobytes()
            else:
                got = self._direct(chunk)
        if len(self.new) >= self.CACHE:
            self.old, self.new = self.new, {}
        self.new[chunk] = got
        return got

    def ids(self, text: str) -> bytes:
        if self._whole.search(text):
            return self._direct(text)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() would look at what follows
        get, miss = self.new.get, self._load
        return b"".join([get(w) or miss(w) for w in text.lower().split()])


_TOKENIZERS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One tokenizer and cache per worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokens(path)
    return _TOKENIZERS[path]


class Packer:
    """Open sequences of one task; ``rows`` collects the pieces of emitted ones."""

    def __init__(self, length: int, open_windows: int, min_cut: int, first_id: int):
        self.length, self.most, self.min_cut, self.next_id = length, open_windows, min_cut, first_id
        self.open: list[list] = []  # [used, [(doc, start, ids, doc_tokens), ...]]
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next_id, offset, None, 0))
            offset += n
        self.next_id += 1

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        while ids:
            n = len(ids) // 4
            if n >= self.length:
                cut = 4 * self.length
                self.emit([(doc, start, ids[:cut], total)])
                ids, start = ids[cut:], start + self.length
                continue
            fits = [w for w in self.open if w[0] + n <= self.length]
            if fits:
                best = max(fits, key=lambda w: w[0])
                best[1].append((doc, start, ids, total))
                best[0] += n
                if best[0] == self.length:
                    self.emit(best[1])
                    self.open.remove(best)
                return
            if len(self.open) < self.most:
                self.open.append([n, [(doc, start, ids, total)]])
                return
            fullest = max(self.open, key=lambda w: w[0])
            gap = self.length - fullest[0]
            if gap >= self.min_cut:
                fullest[1].append((doc, start, ids[:4 * gap], total))
                ids, start = ids[4 * gap:], start + gap
            self.emit(fullest[1])
            self.open.remove(fullest)

    def close(self, level: int) -> None:
        """Hand the open pieces to the next level, with their ids."""
        for _, pieces in self.open:
            self.rows += [(doc, start, len(ids) // 4, 0, total, 0, 0, ids, level) for doc, start, ids, total in pieces]
        self.open = []

    def finish(self) -> None:
        """Emit what is open as one run cut to full windows, then to powers of two."""
        pieces = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        self.open, room, held = [], 0, []
        left = sum(len(p[2]) // 4 for p in pieces)
        for doc, start, ids, total in pieces:
            while ids:
                if room == 0:
                    room = self.length if left >= self.length else 1 << (left.bit_length() - 1)
                n = min(room, len(ids) // 4)
                held.append((doc, start, ids[:4 * n], total))
                ids, start, room, left = ids[4 * n:], start + n, room - n, left - n
                if room == 0:
                    self.emit(held)
                    held = []

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows)) if rows else [[] for _ in _COLUMNS]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _COLUMNS)


def _pack_texts(path: str, end_id: int, length: int, open_windows: int, min_cut: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]):
        tokens = word_tokens(path)
        packer = Packer(length, open_windows, min_cut, TaskContext.get().partitionId() << 36)
        for batch in batches:
            texts, ids = single(batch.column("text")), batch.column("doc_id")
            for lo, hi in slices(texts):
                for doc, text in zip(ids.slice(lo, hi - lo).to_pylist(), texts.slice(lo, hi - lo).to_pylist()):
                    own = tokens.ids(text or "") + end
                    packer.add(doc, 0, own, len(own) // 4)
                yield packer.take()
        packer.close(1)
        yield packer.take()
    return run


def _pack_again(length: int, open_windows: int, min_cut: int, level: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]):
        packer = Packer(length, open_windows, min_cut, (level << 58) | (TaskContext.get().partitionId() << 36))
        for batch in batches:
            for doc, start, ids, total in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))):
                packer.add(doc, start, ids, total)
            yield packer.take()
        if last:
            packer.finish()
        else:
            packer.close(level + 1)
        yield packer.take()
    return run


def pack_sequences(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
                   length: int = 4096, open_windows: int = 16, min_cut: int = 32, fan_in: int = 64) -> DataFrame:
    """Pieces of packed sequences: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document's ids are the tokenizer's (no special tokens added) and then ``end_id``.  A null or
    empty text has ``end_id`` alone; a row with a null id is packed like any other; rows that
    repeat an id are packed as documents of their own.  Each id lies in exactly one piece; pieces
    of a sequence follow each other without a gap from offset 0.  A sequence lacks fewer than
    ``min_cut`` ids of ``length``, or is a power of two long.  Other columns are not read.  An
    empty table gives no rows.

    ``sequence_id`` holds the level, the task and a running number, so a task that is run again
    after a lost executor gives the same ids.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    packed = materialize(arrow_map(docs, _pack_texts(tokenizer_path, end_id, length, open_windows, min_cut), OUT))
    done = [packed.where("level = 0")]
    rest, level = packed.where("level = 1"), 1
    while True:
        left = rest.agg(F.sum("length")).first()[0]
        if not left:
            break
        tasks = -(-left // (length * open_windows * fan_in))
        dealt = (rest.select("doc_id", "start", "ids", "doc_tokens").repartition(tasks, F.xxhash64("doc_id", "start"))
                 .sortWithinPartitions(F.length("ids").desc(), "doc_id", "start"))
        again = materialize(arrow_map(dealt, _pack_again(length, open_windows, min_cut, level, tasks == 1), OUT))
        done.append(again.where("level = 0"))
        level += 1
        rest = again.where(F.col("level") == level)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
