"""BPE encoding and decoding by prefix-sharing traversal of a trie of distinct words.

The encoding of any prefix of a word is that of a shorter prefix and one last token: the token that ends the prefix and is compatible with the last token of
what stands before it. So a trie node needs only its last token. Sorted distinct words are the trie in depth-first order: going from a word to the next pops
the nodes that they don't share and computes the rest, so that a shared prefix is computed once.

Documents never leave their partition; a worker keeps the encodings of the words that it met.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from glyphsieve.llm._common import text_batches
from glyphsieve.sources.tables import read_table

TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
#: How text is split into words before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SLICE = 1 << 20
#: Beyond so many words, a worker forgets those that it met but once; they are computed again when met again.
_WORDS_KEPT = 1 << 18
_PAIRS_KEPT = 1 << 19
_NEVER = 1 << 40


class Vocabulary:
    """The ranks of a byte-level BPE, which are its ids, and what the traversal needs: each token's last merge, and which pairs merge."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens: list[bytes] = [b""] * (1 + max(self.ranks.values()))
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.halves: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        self.states: dict[bytes, int] = {}  # the tokens that encode to themselves
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.states[token] = rank
                continue
            parts = self.merge(token, below=rank)
            if len(parts) == 2:
                self.halves[rank] = x, y = self.ranks[parts[0]], self.ranks[parts[1]]
                self.merges[x, y] = rank
                self.states[token] = rank
        self._rights, self._lefts, self._fits = {}, {}, {}
        self._automaton()
        sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.sizes, self.data = sizes, np.frombuffer(b"".join(self.tokens), np.uint8)
        self.begins = np.cumsum(sizes) - sizes

    def merge(self, word: bytes, below: int = _NEVER) -> list[bytes]:
        """The parts of a word after all merges of a rank below the given one, lowest and leftmost first."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _chain(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that once stood at this end of a token (0: its left end), and the rank whose merge ended each."""
        out, end = [(token, _NEVER)], token
        while end in self.halves:
            out.append((self.halves[end][side], end))
            end = out[-1][0]
        return out

    def fit(self, left: int, right: int) -> bool:
        """Whether bytes that encode to `left` and to `right` encode, joined, to these two: no merge across the border comes before those within."""
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if left not in self._rights:
                self._rights[left] = self._chain(left, 1)
            if right not in self._lefts:
                self._lefts[right] = self._chain(right, 0)
            lefts, known = self._lefts[right], True
            for x, x_ends in self._rights[left]:
                for y, y_ends in lefts:
                    m = self.merges.get((x, y), _NEVER)
                    if m < x_ends and (m <= y_ends < _NEVER or m < y_ends):  # of equal ranks, the left one merges first
                        known = False
                        break
                if not known:
                    break
            if len(self._fits) > _PAIRS_KEPT:
                self._fits.clear()
            self._fits[key] = known
        return known

    def _automaton(self) -> None:
        """Which tokens end at a byte, longest first, by one step from what they were a byte before: a trie of the tokens with links to longest suffixes."""
        self._steps: dict[int, int] = {}
        steps, parent, byte, own, depth = self._steps, [0], [0], [()], [0]
        for token, rank in self.states.items():
            state = 0
            for b in token:
                key = state << 8 | b
                state = steps.get(key) or steps.setdefault(key, len(parent))
                if state == len(parent):
                    parent.append(key >> 8)
                    byte.append(b)
                    own.append(())
                    depth.append(depth[key >> 8] + 1)
            own[state] = ((rank, len(token)),)
        self._fallback, self._ends = [0] * len(parent), own
        for state in sorted(range(1, len(parent)), key=depth.__getitem__):
            if depth[state] > 1:
                f = self._fallback[parent[state]]
                while f and f << 8 | byte[state] not in steps:
                    f = self._fallback[f]
                self._fallback[state] = steps.get(f << 8 | byte[state], 0)
            own[state] += own[self._fallback[state]]

    def _step(self, key: int) -> int:
        state, b = key >> 8, key & 255
        found = None
        while found is None:
            if state == 0:
                found = self._steps.get(b, 0)
            else:
                state = self._fallback[state]
                found = self._steps.get(state << 8 | b)
        self._steps[key] = found
        return found

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Encodings of distinct sorted words. A node is a prefix: its last token, and the automaton's state."""
        steps, ends, fits, sizes = self._steps.get, self._ends, self._fits, self.sizes.tolist()
        out, last, states, before = [], [-1], [0], b""
        for word in words:
            whole = self.ranks.get(word)
            if whole is not None:  # a word that is a token is that token
                out.append([whole])
                continue
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], states[shared + 1 :]
            before, state = word, states[shared]
            for end in range(shared + 1, len(word) + 1):
                key = state << 8 | word[end - 1]
                state = steps(key)
                if state is None:
                    state = self._step(key)
                for token, size in ends[state]:
                    if size == end:
                        break
                    left = last[end - size]
                    known = fits.get(left << 32 | token)
                    if self.fit(left, token) if known is None else known:
                        break
                else:
                    raise AssertionError(f"no token ends {word[:end]!r}")
                last.append(token)
                states.append(state)
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end -= sizes[last[end]]
            ids.reverse()
            out.append(ids)
        return out


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


_words = regex.compile(PATTERN).findall


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers starts[k], ..., starts[k] + lengths[k] - 1 for every k in turn."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))


class Encoder:
    """Encodes texts; keeps the words met, for the next task of the process too."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.index: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.uses, self.used = np.zeros(1 << 16, np.int64), 0

    def trim(self) -> None:
        """Forgets the words that were met once since the last time, and the rarer ones of the rest beyond half of _WORDS_KEPT."""
        n = len(self.index)
        sizes = self.sizes[:n].astype(np.int64)
        kept = np.flatnonzero(self.uses[:n] > 1)
        if len(kept) > _WORDS_KEPT // 2:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[: _WORDS_KEPT // 2]])
        ids = self.ids[ragged((np.cumsum(sizes) - sizes)[kept], sizes[kept])]
        words = list(self.index)
        self.index = {words[i]: k for k, i in enumerate(kept.tolist())}
        self.sizes[: len(kept)], self.uses[: len(kept)], self.used = self.sizes[kept], 1, len(ids)
        self.ids[: len(ids)] = ids
        self.uses[len(kept) :] = 0

    def _learn(self, new: set[str]) -> None:
        pairs = sorted((w.encode(), w) for w in new)
        encoded = self.vocabulary.encode_words([b for b, _ in pairs])
        sizes = np.fromiter(map(len, encoded), np.int32, len(encoded))
        n, total = len(self.index), int(sizes.sum())
        while n + len(pairs) > len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            self.uses = np.concatenate([self.uses, np.zeros_like(self.uses)])
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.sizes[n : n + len(pairs)] = sizes
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(encoded), np.int32, total)
        self.used += total
        for k, (_, w) in enumerate(pairs, n):
            self.index[w] = k

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row and their number for each text; null has none."""
        words = [_words(t) if t else () for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        flat = list(chain.from_iterable(words))
        if len(self.index) > _WORDS_KEPT:
            self.trim()
        if new := set(flat).difference(self.index):
            self._learn(new)
        at = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        self.uses[: len(self.index)] += np.bincount(at, minlength=len(self.index))
        begins = np.cumsum(self.sizes[: len(self.index)], dtype=np.int64) - self.sizes[: len(self.index)]
        sizes = self.sizes[at].astype(np.int64)
        ids = self.ids[ragged(begins[at], sizes)]
        ends, done = np.cumsum(counts), np.concatenate([[0], np.cumsum(sizes)])
        return ids, done[ends] - done[ends - counts]


@lru_cache(4)
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


def decode_bytes(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """The bytes of tokens, in a row."""
    return v.data[ragged(v.begins[ids], v.sizes[ids])]


def _encode(path: str, text_at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = encoder_of(path)
    for batch, text in text_batches(batches, text_at, _SLICE):
        ids, n = encoder.encode(text.to_pylist())
        null = text.is_null().to_numpy(zero_copy_only=False)
        offsets = np.zeros(len(n) + 1, np.int32)
        np.cumsum(n, out=offsets[1:])
        lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(null, False)) if null.any() else pa.array(offsets), pa.array(ids))
        counts = pa.array(n.astype(np.int32), mask=null)
        # round trip: the bytes of each text's tokens are those of the text
        back = decode_bytes(encoder.vocabulary, ids)
        size = np.concatenate([[0], np.cumsum(encoder.vocabulary.sizes[ids])])[offsets]
        data, begin = text.buffers()[2], np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        source = np.frombuffer(data, np.uint8)[begin[0] : begin[-1]] if data is not None and len(text) else np.zeros(0, np.uint8)
        same = np.diff(size) == np.diff(begin)
        if same.all() and np.array_equal(source, back):
            exact = same
        else:
            raw = source.tobytes(), back.tobytes()
            begin = begin - begin[0]
            exact = np.array([raw[0][begin[i] : begin[i + 1]] == raw[1][size[i] : size[i + 1]] for i in range(len(same))], bool)
        columns = [*batch.columns, lists, counts, pa.array(exact, mask=null)]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "ids", "n_tokens", "exact"])


def encode(docs: DataFrame, path: str = f"{TOKENIZERS}/{RANKS}") -> DataFrame:
    """docs with ids (the tokens of text), n_tokens, and exact: whether the ids decode to the text's very bytes.

    path: a file of ranks, the same on every machine. Null text has null in all three; empty text has no tokens. Rows stay as they are, repeated ones too.
    Columns of docs named ids, n_tokens or exact are replaced. Texts are encoded whole, however long; special tokens are ordinary text.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("ids", "n_tokens", "exact")])
    schema = StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", IntegerType()), StructField("exact", BooleanType())])
    return docs.mapInArrow(partial(_encode, path, [c.lower() for c in docs.columns].index("text")), schema)


def _decode(path: str, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path)
    for batch in batches:
        texts = []
        for ids in batch.column(at):
            known = None
            if ids.is_valid:
                x = ids.values.to_numpy(zero_copy_only=False)
                if len(x) == 0:
                    known = ""
                elif ids.values.null_count == 0 and x.min() >= 0 and x.max() < len(v.tokens):
                    known = decode_bytes(v, x).tobytes().decode("utf-8", "replace")
            texts.append(known)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])


def decode(encoded: DataFrame, path: str = f"{TOKENIZERS}/{RANKS}") -> DataFrame:
    """encoded with decoded: the text of its column ids. Null, and ids that aren't the vocabulary's, give null; bytes that aren't UTF-8 give U+FFFD."""
    encoded = encoded.drop(*[c for c in encoded.columns if c.lower() == "decoded"])
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])
    return encoded.mapInArrow(partial(_decode, path, [c.lower() for c in encoded.columns].index("ids")), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "ids", "n_tokens", "exact")
