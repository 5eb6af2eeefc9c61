"""Benchmark decontamination: an FM-index of every training shard is searched backwards for the phrases of a benchmark, and what they cover goes.

The symbols are words, lower case. A shard is a run of whole documents of about SHARD_BYTES. Words that no phrase has can't be part of an occurrence: each
run of them is one separator, so that the alphabet is the benchmark's vocabulary. Documents never leave their partition: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsieve.llm._common import share, shared, text_batches
from glyphsieve.llm._words import WORD, bytes_of, char_index, offsets_of, words
from glyphsieve.llm.fm_index import FMIndex
from glyphsieve.sources.tables import read_table

#: Words of a phrase: every run of so many of an item. An item of fewer words is one phrase; of fewer than MIN_WORDS, too common to tell from clean prose.
PHRASE_WORDS = 8
MIN_WORDS = 5
SHARD_BYTES = 2 << 20
#: Bytes of benchmark text whose phrases a task holds at once. Those of a larger benchmark lie in the shared folder in such parts, and a shard is searched for one
#: part after the other before anything is cut.
BENCHMARK_BYTES = 16 << 20


@dataclass(frozen=True)
class Phrases:
    """The vocabulary of a part of a benchmark (sorted word hashes; symbol k + 1 is word k) and its distinct phrases by length."""

    vocabulary: np.ndarray
    by_length: dict[int, np.ndarray]

    @property
    def bits(self) -> int:
        return max(1, int(len(self.vocabulary)).bit_length())


def phrases_of(texts: pa.Array, size: int = PHRASE_WORDS, least: int = MIN_WORDS) -> Phrases:
    h, _, _, first, _ = words(texts.cast(pa.large_string()))
    vocabulary = np.unique(h)
    symbols = np.searchsorted(vocabulary, h) + 1
    rows: dict[int, list[np.ndarray]] = {}
    for i in range(len(first) - 1):
        item = symbols[first[i] : first[i + 1]]
        n = min(size, len(item))
        if n >= least:
            rows.setdefault(n, []).append(np.lib.stride_tricks.sliding_window_view(item, n))
    return Phrases(vocabulary, {n: np.unique(np.concatenate(x), axis=0) for n, x in rows.items()})


def _covered(h: np.ndarray, first: np.ndarray, doc: np.ndarray, phrases: Phrases) -> np.ndarray:
    """Which words (hashes h, of texts that begin at `first`) the phrases cover."""
    inside = np.zeros(len(h), bool)
    if not phrases.by_length:
        return inside
    place = np.minimum(np.searchsorted(phrases.vocabulary, h), len(phrases.vocabulary) - 1)
    symbol = np.where(phrases.vocabulary[place] == h, place + 1, 0)
    # a separator before every text and after the last
    t = np.zeros(len(h) + len(first), np.int64)
    at = np.arange(len(h)) + doc + 1
    t[at] = symbol
    keep = t != 0
    keep[1:] |= t[:-1] != 0
    keep[0] = keep[-1] = True
    index = FMIndex(t[keep], phrases.bits)
    word_at = np.zeros(len(t), np.int64)
    word_at[at] = np.arange(len(h))
    word_at = word_at[keep]
    covered = np.zeros(len(h) + 1, np.int64)
    for n, rows in phrases.by_length.items():
        _, low, high = index.search(rows)
        count = high - low
        suffixes = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        begin = word_at[index.locate(suffixes)]
        np.add.at(covered, begin, 1)
        np.add.at(covered, begin + n, -1)
    return np.cumsum(covered)[:-1] > 0


def find_spans(text: pa.Array, *parts: Phrases | str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merged occurrences in a shard: the row, first and last character (end excluded) and words of each, in order. parts: phrases, or where they are shared."""
    h, starts, ends, first, folded = words(text)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.zeros(len(h), bool)
    for part in parts if len(h) else ():
        inside |= _covered(h, first, doc, shared(part) if isinstance(part, str) else part)
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | (doc[1:] != doc[:-1])
    closes[:-1] &= ~inside[1:] | (doc[1:] != doc[:-1])
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    if len(a) == 0:
        return (np.zeros(0, np.int64),) * 4
    data, offsets = bytes_of(folded), offsets_of(folded)
    return doc[a], char_index(data, offsets, doc[a], starts[a]), char_index(data, offsets, doc[a], ends[b]), b - a + 1


def _spans(found: list[Phrases | str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, text in text_batches(batches, 1, SHARD_BYTES):
        row, start, end, n = find_spans(text, *found)
        ids = batch.column(0).take(pa.array(row))
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.astype(np.int32)) for x in (start, end, n))], names=["doc_id", "span_start", "span_end", "span_words"])


def _cut(found: list[Phrases | str], text_at: int, chars_at: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, text in text_batches(batches, text_at, SHARD_BYTES):
        row, start, end, _ = find_spans(text, *found)
        if len(row) == 0:
            yield batch
            continue
        texts, cut = batch.column(text_at).to_pylist(), {}
        for i, s, e in zip(row[::-1].tolist(), start[::-1].tolist(), end[::-1].tolist()):  # from the back: earlier places stay
            cut[i] = True
            texts[i] = texts[i][:s] + texts[i][e:]
        left = pa.array(texts, pa.string())
        _, _, _, first, _ = words(left.cast(pa.large_string()))
        gone = {i for i in cut if first[i + 1] == first[i]}
        columns = list(batch.columns)
        columns[text_at] = left
        if chars_at is not None:
            kind = batch.schema.field(chars_at).type
            columns[chars_at] = pa.array([len(texts[i]) if i in cut else v for i, v in enumerate(batch.column(chars_at).to_pylist())], kind)
        out = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
        yield out.take(pa.array([i for i in range(len(texts)) if i not in gone], pa.int64())) if gone else out


def parts(benchmark: DataFrame, size: int, least: int) -> list[Phrases | str]:
    """The phrases of benchmark(text), a part for about every BENCHMARK_BYTES: one as it is, several as files of the shared folder."""
    items = benchmark.where("text IS NOT NULL").select("text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BENCHMARK_BYTES)
    made = (phrases_of((items if n == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)).toArrow().column(0).combine_chunks(), size, least) for k in range(n))
    return list(made) if n < 2 else [share(benchmark.sparkSession, p) for p in made]


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, size: int = PHRASE_WORDS, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, span_start, span_end, span_words) of everything in docs that phrases of benchmark(text) cover: characters from 0, the end excluded.

    Overlapping and touching occurrences are one span. Null and empty texts have none; so has an empty table, or any table beside an empty benchmark. A null
    doc_id stays null; of repeated rows each gives its spans. Other columns are ignored. Texts are searched whole, however long.
    """
    rows = docs.select("doc_id", "text")
    schema = rows.select("doc_id", F.lit(0).alias("span_start"), F.lit(0).alias("span_end"), F.lit(0).alias("span_words")).schema
    found = parts(benchmark, size, least)
    return rows.mapInArrow(partial(_spans, found), schema) if found else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = PHRASE_WORDS, least: int = MIN_WORDS) -> DataFrame:
    """docs without the spans of contaminated_spans(): the same columns, with text (and n_chars, if there) of what is left.

    A document of which no word is left goes; all others stay, null and empty texts and rows without an id unchanged.
    """
    columns = [c.lower() for c in docs.columns]
    at, chars_at = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None
    found = parts(benchmark, size, least)
    return docs.mapInArrow(partial(_cut, found, at, chars_at), docs.schema) if found else docs


def oracle(size: int = PHRASE_WORDS, least: int = MIN_WORDS) -> str:
    """DuckDB SQL for contaminated_spans(documents, benchmark)."""
    return f"""
WITH items AS (SELECT regexp_extract_all(lower(text), '{WORD}') AS w FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT w, least({size}, len(w)) AS n FROM items WHERE len(w) >= {least}),
phrases AS (SELECT DISTINCT n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS p FROM sized),
sizes AS (SELECT DISTINCT n FROM sized),
docs AS (SELECT row_number() OVER () AS rid, doc_id, text, regexp_extract_all(lower(text), '{WORD}') AS w, regexp_split_to_array(lower(text), '{WORD}') AS gaps FROM documents WHERE text IS NOT NULL),
windows AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT rid, i AS a, max(i + n - 1) AS b FROM windows JOIN phrases USING (n, p) GROUP BY rid, i),
marked AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY rid ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS opens FROM hits),
islands AS (SELECT rid, min(a) AS a, max(b) AS b FROM (SELECT *, sum(opens) OVER (PARTITION BY rid ORDER BY a) AS g FROM marked) GROUP BY rid, g)
SELECT doc_id, CAST(list_sum(list_transform(gaps[1:a], lambda g: length(g))) + coalesce(list_sum(list_transform(w[1:a - 1], lambda x: length(x))), 0) AS INTEGER) AS span_start,
  CAST(list_sum(list_transform(gaps[1:b], lambda g: length(g))) + list_sum(list_transform(w[1:b], lambda x: length(x))) AS INTEGER) AS span_end,
  CAST(b - a + 1 AS INTEGER) AS span_words
FROM islands JOIN docs USING (rid)"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return contaminated_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
