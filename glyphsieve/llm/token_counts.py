"""Token counts of a unigram vocabulary without the tokens: a count-only Viterbi.

An Aho-Corasick automaton enumerates all pieces of the vocabulary in a word; dynamic programming carries the best score up to each character and how many
pieces gave it. Ties go as in the tokenizer: candidates come by their start, and a later one must be better, so that of equal scores the longest last piece
stays. No piece reaches over the start of a run of spaces, so texts split there without a change, and each distinct word is solved once.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache, partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructField, StructType

from glyphsieve.llm._common import text_batches
from glyphsieve.sources.tables import read_table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: What an unknown character costs beside the worst piece.
UNKNOWN_PENALTY = 10.0
_NORMAL, _USER = 1, 4
_SLICE = 1 << 20
#: Words known to a worker, and as many that it knew before.
_WORDS_KEPT = 1 << 18


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[i]
        value |= (b & 127) << shift
        i, shift = i + 1, shift + 7
        if b < 128:
            return value, i


def fields(data: bytes) -> Iterator[tuple[int, int, object, int, int]]:
    """Number, wire type, value, start and end of each field of a protocol buffer."""
    i = 0
    while i < len(data):
        start = i
        tag, i = _varint(data, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(data, i)
        elif kind == 2:
            n, i = _varint(data, i)
            value, i = data[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = data[i : i + n], i + n
        yield tag >> 3, kind, value, start, i


def pieces_of(path: str) -> tuple[list[tuple[str, float]], bool]:
    """The pieces that match text, with scores, and whether unknown characters fall back to a piece a byte."""
    pieces, fallback = [], False
    with open(path, "rb") as f:
        model = f.read()
    for number, _, value, _, _ in fields(model):
        if number == 1:
            piece, score, kind = "", 0.0, _NORMAL
            for n, _, v, _, _ in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    (score,) = struct.unpack("<f", v)
                elif n == 3:
                    kind = v
            if kind == _USER:
                raise ValueError("a vocabulary with pieces defined by users isn't supported")
            if kind == _NORMAL:
                pieces.append((piece, score))
        elif number == 2:
            fallback = any(n == 35 and v for n, _, v, _, _ in fields(value))
    return pieces, fallback


class Counter(dict):
    """Pieces of the best segmentation of a word; words met before are looked up."""

    def __init__(self, pieces: list[tuple[str, float]], fallback: bool):
        super().__init__()
        self.older: dict[str, int] = {}  # what was met before the words here; those met again move
        self.fallback = fallback
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.singles = {p for p, _ in pieces if len(p) == 1}
        for p, _ in pieces:
            if SPACE in p.lstrip(SPACE):
                raise ValueError(f"the piece {p!r} reaches over the start of a word")
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()

    def solve(self, word: str) -> tuple[float, int]:
        """The best score and its number of pieces. Unknown characters side by side are one piece, if there are no bytes to fall back to."""
        n = len(word)
        best, count, last_unknown = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        done = 0

        def unknown(end: int) -> None:
            c = word[end - 1]
            if c in self.singles:
                return
            score = best[end - 1] + self.unknown
            if best[end] is None or score > best[end]:
                best[end], last_unknown[end] = score, True
                count[end] = count[end - 1] + (len(c.encode()) if self.fallback else not last_unknown[end - 1])

        for at, (size, score) in self.automaton.iter(word):
            end = at + 1
            while done < end - 1:
                done += 1
                unknown(done)
            # matches that end here come longest first, which is the order of their starts
            begin = end - size
            total = best[begin] + score
            if best[end] is None or total > best[end]:
                best[end], count[end], last_unknown[end] = total, count[begin] + 1, False
        while done < n:
            done += 1
            unknown(done)
        return best[n], count[n]

    def __missing__(self, word: str) -> int:
        if len(self) >= _WORDS_KEPT:
            self.older = dict(self)
            self.clear()
        n = self.older.pop(word, None)
        if n is None:
            n = self.solve(word)[1]
        self[word] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        if "" in words:  # runs of spaces belong to what follows them
            words = [w.replace(" ", SPACE) for w in re.findall(" +[^ ]*", " " + text.replace(SPACE, " "))]
        else:
            words = [SPACE + w for w in words]
        return sum(map(self.__getitem__, words)) if self.fallback else self._joined(words)

    def _joined(self, words: list[str]) -> int:
        """Unknown characters at both sides of a border can't be: a word begins with a space, so counts add up unless that is unknown too."""
        if SPACE in self.singles:
            return sum(map(self.__getitem__, words))
        return self.solve("".join(words))[1]


@lru_cache(4)
def counter_of(path: str) -> Counter:
    return Counter(*pieces_of(path))


def _count(path: str, text_at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = counter_of(path)
    for batch, text in text_batches(batches, text_at, _SLICE):
        n = [None if t is None else counter.count(t) for t in text.to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int32())], names=[*batch.schema.names, "n_tokens"])


def count_tokens(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """docs with n_tokens: how many pieces the best segmentation of text has under the vocabulary at `path` (the same on every machine).

    A text is taken as with a space before it; spaces count as SPACE, and nothing else is normalised. Characters that no piece holds count a piece a byte.
    Null text has null, empty text 0. Rows stay as they are, repeated ones too; a column of docs named n_tokens is replaced. Texts count whole.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "n_tokens"])
    schema = StructType([*docs.schema.fields, StructField("n_tokens", IntegerType())])
    return docs.mapInArrow(partial(_count, path, [c.lower() for c in docs.columns].index("text")), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_tokens")
