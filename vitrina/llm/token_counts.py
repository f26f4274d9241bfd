"""Unigram token counts without building the tokens.

The best segmentation of a text under a unigram vocabulary is found by dynamic programming over
the vocabulary's matches, which one Aho-Corasick pass enumerates; each position carries only the
best score and the number of pieces of the best path. The rules are those of the public Unigram
model: a match replaces the path to its end only if its score is strictly better, and matches
that start earlier are offered first; a character that is no piece of its own costs the least
score minus 10 and counts one piece for each of its UTF-8 bytes (byte fallback). Control, unknown and byte
pieces never match text.

Of a unigram model file, scores are its own. Other piece models have ranks for scores; their pieces get the log-probabilities
of the Zipf-Mandelbrot law, log p = -log(rank + 2.7) + c, a fixed rule that trains nothing. These are rounded to
multiples of 2 ** -10, so that sums are exact in any order and equal paths are real ties.

Spaces become U+2581 and one stands before the text. No piece goes from another character to U+2581 (if the vocabulary has one that
does, a text is one chunk), so the program runs over chunks that begin with U+2581 and keeps the counts of chunks it
has met (a bounded cache that is cleared when full; it changes the time, never the result).

Defined results: null and empty texts have 0 pieces; text of any length is processed whole, chunk
by chunk; repeated rows are counted one by one; an empty table gives none; a column n_tokens is replaced, others stay.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vitrina.llm.common import map_rows, texts_of

MARK = "▁"
#: What an unknown character costs more than the worst piece.
UNKNOWN_PENALTY = 10.0
CACHE_CHUNKS = 400_000
#: The Zipf-Mandelbrot law's shift of the rank, and the steps of its log-probabilities.
SHIFT, GRID = 2.7, 1024
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
UNIGRAM = 1


class Vocabulary(NamedTuple):
    pieces: list[tuple[str, float]]
    byte_fallback: bool


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (raw[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if not raw[at - 1] & 128:
            return value, at


def proto_fields(raw: bytes) -> list[tuple[int, int, "bytes | int"]]:
    """(number, wire type, value) of the fields of a protocol buffer message."""
    out, at = [], 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        else:
            size, at = _varint(raw, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at : at + size], at + size
        out.append((key >> 3, kind, value))
    return out


def model_type(raw: bytes) -> int:
    """1 unigram, 2 BPE: field 3 of the trainer's specification (field 2 of the model)."""
    return next((v for spec in (v for n, _, v in proto_fields(raw) if n == 2) for n, _, v in proto_fields(spec) if n == 3), UNIGRAM)


def zipf_scores(n: int) -> list[float]:
    """Log-probabilities of n ranks."""
    weights = [1 / (r + SHIFT) for r in range(n)]
    total = math.log(sum(weights)) if n else 0.0
    return [round((math.log(w) - total) * GRID) / GRID for w in weights]


def load_vocabulary(path: str) -> Vocabulary:
    """Text pieces of a sentencepiece model file in order of their ids, and whether it falls back to bytes."""
    import sentencepiece

    with open(path, "rb") as f:
        raw = f.read()
    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    ids = range(model.get_piece_size())
    normal = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = [float(model.get_score(i)) for i in normal] if model_type(raw) == UNIGRAM else zipf_scores(len(normal))
    return Vocabulary(list(zip(map(model.id_to_piece, normal), scores, strict=True)), sum(map(model.is_byte, ids)) == 256)


class Counter(dict):
    """Pieces of a chunk, by chunk."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((score for _, score in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes_known = vocabulary.byte_fallback
        self.chunked = not any(re.search(f"[^{MARK}]{MARK}", p) for p, _ in vocabulary.pieces)

    def __missing__(self, chunk: str) -> int:
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        self[chunk] = n = self.count(chunk)
        return n

    def of_text(self, text: str) -> int:
        """Pieces of a text."""
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        return sum(map(self.__getitem__, CHUNK.findall(marked))) if self.chunked else self.count(marked)

    def count(self, text: str) -> int:
        """Pieces of the best path through a chunk."""
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        pieces = [0] * (n + 1)
        best[0] = 0.0
        done = 0  # ends up to here are final
        single = False
        for end, (length, score) in self.automaton.iter(text):
            end += 1
            while done < end - 1:  # no piece of one character ends here: the unknown is offered last
                done += 1
                if not single:
                    self._unknown(text, done, best, pieces)
                single = False
            start = end - length
            if best[start] is not None:
                now = best[start] + score
                if best[end] is None or now > best[end]:
                    best[end], pieces[end] = now, pieces[start] + 1
            single = single or length == 1
        while done < n:
            done += 1
            if not single:
                self._unknown(text, done, best, pieces)
            single = False
        return pieces[n]

    def _unknown(self, text: str, end: int, best: list, pieces: list) -> None:
        now = best[end - 1] + self.unknown
        if best[end] is None or now > best[end]:
            best[end] = now
            pieces[end] = pieces[end - 1] + (len(text[end - 1].encode()) if self.bytes_known else 1)


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, *, text_col: str = "text") -> DataFrame:
    """docs with n_tokens. The vocabulary is a model file's content, of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        counts = _counter(shared.value)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([counts.of_text(t) for t in texts_of(batch, text_col)], pa.int64())]

        return work

    return map_rows(docs, T.StructType([T.StructField("n_tokens", T.LongType())]), make)


_counters: dict = {}


def _counter(vocabulary: Vocabulary) -> Counter:
    key = hash((tuple(vocabulary.pieces), vocabulary.byte_fallback))
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(vocabulary)
    return _counters[key]
