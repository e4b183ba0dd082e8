"""Count-only Viterbi for a unigram tokenizer.

The tokenizer puts a word mark before each word and chooses for each word the segmentation of the
greatest score sum.  An Aho-Corasick automaton lists the vocabulary pieces that end at each position;
the dynamic programme keeps, per position, the best score and that path's number of pieces, nothing
else.  Ties follow the tokenizer: at a position, paths are tried in the order of where their last piece
starts, and a later one wins only if strictly greater; a character without a piece of its own may be an
unknown of score ``least - 10``; neighbouring unknowns are one piece, or their UTF-8 bytes where the
vocabulary has byte pieces.

A text's count is the sum over its words, so each worker counts a distinct word once and keeps it in a
bounded cache.
"""

from __future__ import annotations


import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, single, slices

MARK = "▁"
_UNKNOWN = 10.0  # fixed value: how far below the least piece score an unknown character scores


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with scores, and the unknown's id, of a sentencepiece model file."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


class UnigramCounter:
    CACHE = 400_000

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - _UNKNOWN
        pieces = {p for p, _ in vocabulary}
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def viterbi(self, word: str) -> int:
        """Number of pieces of the best segmentation of one marked word."""
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, found in self.automaton.iter(word):
            ends[end + 1].append(found)
        best, count, unknown_from = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        for e in range(1, n + 1):
            top, pieces, run, single_piece = None, 0, -1, False
            for length, score in sorted(ends[e], reverse=True):  # earlier starts first
                single_piece = single_piece or length == 1
                value = score + best[e - length]
                if top is None or value > top:
                    top, pieces, run = value, count[e - length] + 1, -1
            if not single_piece:
                value = self.unknown + best[e - 1]
                if top is None or value > top:
                    top, run = value, unknown_from[e - 1] if unknown_from[e - 1] >= 0 else e - 1
                    pieces = count[run] + (len(word[run:e].encode("utf-8", "surrogatepass")) if self.bytes else 1)
            best[e], count[e], unknown_from[e] = top, pieces, run
        return count[n]

    def word(self, word: str) -> int:
        got = self.old.get(word)
        if got is None:
            got = self.viterbi(MARK + word)
        if len(self.new) >= self.CACHE:
            self.old, self.new = self.new, {}
        self.new[word] = got
        return got

    def count(self, text: str) -> int:
        """Pieces of a whole text: each blank starts a marked word, and so does the text itself."""
        get, miss = self.new.get, self.word
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        if len(words) > 1 and not words[0]:
            words = words[1:]  # a leading blank is the first mark itself
        total = 0
        for w in words:
            total += get(w) or miss(w)
        return total


_COUNTERS: dict[str, UnigramCounter] = {}


def _counts(path: str):
    def run(batches):
        if path not in _COUNTERS:
            _COUNTERS[path] = UnigramCounter(read_vocabulary(path)[0])
        counter = _COUNTERS[path]
        for batch in batches:
            texts, ids = single(batch.column("text")), single(batch.column("doc_id"))
            for lo, hi in slices(texts):
                n = [counter.count(t or "") for t in texts.slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` per row: the unigram token count of the whole text.

    A null or empty text has 0 tokens.  A null id is returned as null; repeated rows are each counted.
    Other columns are not read.  ``vocabulary_path`` is opened on each executor.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return arrow_map(rows, _counts(vocabulary_path), f"doc_id {kind}, n_tokens long")
