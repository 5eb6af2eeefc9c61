"""Line dedup by a segment-partition edit join.

Two lines within `threshold` edits share, by pigeonhole, one of the threshold + 1 segments of the shorter one, at nearly the same place. Every distinct line
is indexed under the hashes of its own segments and probes with those of its substrings that can match a segment of a line of each allowed length (the
multi-match-aware choice of starts). Lines that meet under a hash, and whose pairs of characters are so nearly the same that they can be near, are candidates, and a
banded bit-parallel edit distance verifies them. How many edits two lines may be apart follows from the shorter one's length: CHARS_PER_EDIT characters for
each, THRESHOLD at most. So the shortest lines must be equal, which needs no candidates.

What is shuffled: 24 bytes for each of some 12 keys a distinct line (threshold 2), never the text; texts travel for candidates only. Lines under one key are
compared in blocks of BLOCK, so that a key of however many lines is the work of many tasks, each of bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphsieve.llm._common import fresh, materialise, small_side, whole_groups
from glyphsieve.llm._words import Prefix, mix
from glyphsieve.sources.tables import read_table

THRESHOLD = 2
CHARS_PER_EDIT = 8
#: Lines of a key that are compared with one another, or with so many others, in one place.
BLOCK = 4096
_PAIRS_AT_ONCE = 1 << 20
_CELLS_AT_ONCE = 1 << 21


def codes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings in a row, and the n + 1 offsets of the strings in them."""
    strings = text.to_pylist()
    offsets = np.zeros(len(strings) + 1, np.int64)
    np.cumsum([len(s) for s in strings], out=offsets[1:])
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def _key(h: np.ndarray, length: np.ndarray, segment: int, indexed: bool) -> np.ndarray:
    k = mix(h ^ (length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(segment)))
    return ((k & ~np.uint64(1)) | np.uint64(indexed)).view(np.int64)


def segment_keys(data: np.ndarray, offsets: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all lines, and the line of each. The lowest bit tells an index key from a probe; longer than threshold characters is every line."""
    prefix, n, at = Prefix(data), np.diff(offsets), offsets[:-1]
    keys, rows = [], []
    for less in range(threshold + 1):
        target = n - less
        for i in range(threshold + 1):
            base, longer = target // (threshold + 1), target % (threshold + 1)
            first_long = threshold + 1 - longer
            size = base + (i >= first_long)
            place = base * i + np.maximum(0, i - first_long)
            right = threshold - i
            for shift in range(max(-i, less - right), min(i, less + right) + 1):
                start = place + shift
                ok = np.flatnonzero((start >= 0) & (start + size <= n) & (size > 0))
                s = at[ok] + start[ok]
                keys.append(_key(prefix.hash(s, s + size[ok]), target[ok], i, less == 0 and shift == 0))
                rows.append(ok)
    return np.concatenate(keys), np.concatenate(rows)


#: Bits of parities() that an edit changes at most: of two neighbouring pairs of characters, before and after.
_BITS_AN_EDIT = 4


def parities(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each string 64 bits, each of which tells whether pairs of characters of one class occur an odd number of times."""
    out, n = np.zeros(len(offsets) - 1, np.uint64), np.diff(offsets)
    some = np.flatnonzero(n > 1)
    if len(some):
        one = np.uint64(1) << (mix((data[:-1].astype(np.uint64) << np.uint64(32)) | data[1:]) & np.uint64(63))
        last = offsets[1:-1][(n[:-1] > 0) & (offsets[1:-1] < len(data))] - 1
        one[last] = 0  # the pair across two strings
        out[some] = np.bitwise_xor.reduceat(one, offsets[:-1][some])
    return out


def _keys_of_batches(threshold: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = batch.column(0).to_numpy()
        _, first = np.unique(h, return_index=True)
        batch = batch.take(pa.array(first)) if len(first) < len(h) else batch
        data, offsets = codes(batch.column(1))
        key, row = segment_keys(data, offsets, threshold)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, batch.column(0).to_numpy()[row], parities(data, offsets).view(np.int64)[row])], names=["key", "h", "bits"])


def _pairs_of_keys(threshold: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of lines that may be near, of batches(group, p, q, key, h, bits, block) in order of (group, p, q): within a block, if p is q, else across the two."""
    for group, p, q, key, h, bits, block in whole_groups(batches, 3):
        edge = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]), [True]]))
        number = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        indexed = np.flatnonzero((key & 1 == 1) & (np.diff(edge)[number] > 1))
        low, count = edge[number[indexed]], np.diff(edge)[number[indexed]]
        done = np.zeros(len(indexed) + 1, np.int64)
        np.cumsum(count, out=done[1:])
        bits, i = bits.view(np.uint64), 0
        while i < len(indexed):
            j = max(i + 1, int(np.searchsorted(done, done[i] + _PAIRS_AT_ONCE, side="right")) - 1)
            x = indexed[np.repeat(np.arange(i, j), count[i:j])]
            y = np.repeat(low[i:j] - done[i:j] + done[i], count[i:j]) + np.arange(len(x))
            keep = (np.bitwise_count(bits[x] ^ bits[y]) <= _BITS_AN_EDIT * threshold) & (h[x] != h[y]) & ((p[x] == q[x]) | (block[x] != block[y]))
            a, b = h[x[keep]], h[y[keep]]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])
            i = j


def bounded_distances(left: list[str], right: list[str], limit: int) -> np.ndarray:
    """Edit distances of pairs of strings, in characters, as far as `limit`; limit + 1 stands for more.

    A column of the band around the diagonal is one machine word a pair, and all pairs advance together.
    """
    out = np.full(len(left), limit + 1, np.int64)
    left, right = map(list, zip(*map(_core, left, right))) if left else ([], [])
    for k, (x, y) in enumerate(zip(left, right)):
        if min(len(x), len(y)) <= limit:
            out[k] = min(limit + 1, _plain_distance(x, y))
    todo = np.array([k for k in range(len(left)) if abs(len(left[k]) - len(right[k])) <= limit < min(len(left[k]), len(right[k]))], np.int64)
    sizes = np.array([len(right[k]) for k in todo], np.int64)
    todo = todo[np.argsort(sizes, kind="stable")]
    i = 0
    while i < len(todo):
        j = i + 1
        while j < len(todo) and (j - i + 1) * (len(right[todo[j]]) + limit) <= _CELLS_AT_ONCE and len(right[todo[j]]) <= 1.1 * len(right[todo[i]]) + 16:
            j += 1
        part = todo[i:j]
        out[part] = _banded([left[k] for k in part], [right[k] for k in part], limit)
        i = j
    return out


def _core(x: str, y: str) -> tuple[str, str]:
    """x and y without the characters that both begin with, then without those that both end with."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        k = (low + high + 1) // 2
        low, high = (k, high) if x[low:k] == y[low:k] else (low, k - 1)
    x, y = x[low:], y[low:]
    low, high = 0, min(len(x), len(y))
    while low < high:
        k = (low + high + 1) // 2
        low, high = (k, high) if x[len(x) - k : len(x) - low] == y[len(y) - k : len(y) - low] else (low, k - 1)
    return x[: len(x) - low], y[: len(y) - low]


def _plain_distance(x: str, y: str) -> int:
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        diagonal, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (c != d))
    return row[-1]


def _matrix(strings: list[str], before: int, size: int) -> np.ndarray:
    """Code points, a string a column, with `before` empty rows above and at least `size` rows in all."""
    out = np.zeros((len(strings), size), np.uint32)
    for k, s in enumerate(strings):
        out[k, before : before + len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) + 1
    return np.ascontiguousarray(out.T)


def _banded(pattern: list[str], text: list[str], t: int) -> np.ndarray:
    m, n = np.array([len(s) for s in pattern]), np.array([len(s) for s in text])
    width = 2 * t + 1
    band, one, top = np.uint64((1 << width) - 1), np.uint64(1), np.uint64(1 << (width - 1))
    columns = int(n.max())
    # row r of the pattern (from 1) stands in row r + t: column j sees rows j .. j + 2t of it
    p, s = _matrix(pattern, t + 1, columns + 2 * t + 2), _matrix(text, 1, columns + 1)
    vp = np.full(len(m), np.uint64((((1 << width) - 1) << t) & ((1 << width) - 1)))
    vn = np.zeros(len(m), np.uint64)
    distance = np.full(len(m), t, np.int64)
    for j in range(1, columns + 1):
        x = np.zeros(len(m), np.uint64)
        for b in range(width):
            x |= (p[j + b] == s[j]).astype(np.uint64) << np.uint64(b)
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & band
        hp = (vn | ~(d0 | vp)) & band
        hn = d0 & vp
        down = j <= m - t
        place = np.clip(m - j + t, 0, width - 1).astype(np.uint64)
        step = np.where(down, (d0 & top == 0).astype(np.int64), ((hp >> place) & one).astype(np.int64) - ((hn >> place) & one).astype(np.int64))
        distance += np.where(j <= n, step, 0)
        half = d0 >> one
        vp = (hn | ~(half | hp)) & band
        vn = half & hp
    return np.minimum(distance, t + 1)


def _verify(threshold: int, per_edit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        d = bounded_distances(left, right, threshold)
        most = np.array([min(threshold, min(len(x), len(y)) // per_edit) for x, y in zip(left, right)], np.int64)
        ok = np.flatnonzero(d <= most)
        kept = batch.take(pa.array(ok))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(d[ok].astype(np.int32))], names=["a", "b", "distance"])


def _lines(docs: DataFrame) -> DataFrame:
    one = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return one.where(F.trim("line") != "").select("doc_id", "line_no", F.xxhash64("line").alias("h"), "line")


def edit_join(lines: DataFrame, threshold: int = THRESHOLD, per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """All pairs (a < b, distance) of the hashes `h` of distinct lines that are 1 to threshold edits apart, and no more than one for every per_edit characters of the
    shorter line. lines: h, line; equal lines have equal hashes."""
    keys = lines.where(F.length("line") >= per_edit).select("h", "line").mapInArrow(partial(_keys_of_batches, threshold), "key long, h long, bits long")
    group = Window.partitionBy("group")
    keys = keys.select(F.shiftright("key", 1).alias("group"), "key", "h", "bits")
    # counts and places within a key come from a sort that spills; keys of a single line go
    met = keys.select("*", F.row_number().over(group.orderBy("h", "key")).alias("place"), F.count("*").over(group).alias("n")).where("n > 1")
    met = materialise(met.select("group", "key", "h", "bits", F.floor((F.col("place") - 1) / BLOCK).cast("int").alias("block"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("p"), F.greatest(o, "block").alias("q")))
    rows = met.select("group", F.explode(others).alias("o"), "key", "h", "bits", "block").select("group", "o.p", "o.q", "key", "h", "bits", "block")
    rows = rows.repartition("group", "p", "q").sortWithinPartitions("group", "p", "q")
    pairs = materialise(rows.mapInArrow(partial(_pairs_of_keys, threshold), "a long, b long").distinct())
    seen = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    texts = lines.join(small_side(seen, 2 * pairs.count(), 24), "h", "left_semi").groupBy("h").agg(F.first("line").alias("line"))
    texts = materialise(texts)
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("left")), "a")
    both = both.join(texts.select(F.col("h").alias("b"), F.col("line").alias("right")), "b").select("a", "b", "left", "right")
    return both.mapInArrow(partial(_verify, threshold, per_edit), "a long, b long, distance int")


def repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """Occurrences of lines near an earlier line: doc_id, line_no, first_doc_id, first_line_no (the earliest such line), distance.

    Lines are near if they are equal, or as many edits apart as threshold allows and the shorter one has per_edit characters for: with 2 and 8, lines of fewer than 8
    characters must be equal, of fewer than 16 may differ by one edit, others by two. Every line that isn't blank takes part, whatever its length, and counts whole.
    Earlier means a smaller (doc_id, line_no), whether or not that line is itself a repeat. line_no counts from 0. Documents without id or text have no lines. Rows
    with the same doc_id are one document: lines at the same place don't repeat each other. Other columns are ignored; an empty table has no repeats.
    """
    if per_edit <= threshold:
        raise ValueError("per_edit must be greater than threshold")
    lines = _lines(docs)
    spots = materialise(lines.select("h", F.struct("doc_id", "line_no").alias("spot")).distinct())
    firsts = spots.groupBy("h").agg(F.min("spot").alias("first"))
    pairs = edit_join(lines, threshold, per_edit)
    there, back = (F.struct(F.col(x).alias("h"), F.col(y).alias("other"), "distance") for x, y in ("ab", "ba"))
    both = pairs.select(F.explode(F.array(there, back)).alias("p")).select("p.*")
    both = both.join(firsts, "h").withColumnRenamed("first", "own").join(firsts.withColumnRenamed("h", "other"), "other")
    near = both.where("first < own").groupBy("h").agg(F.min(F.struct("first", "distance")).alias("near"))
    found = spots.join(firsts, "h").join(near, "h", "left")
    found = found.where("near IS NOT NULL OR first < spot").select(
        "spot.doc_id", "spot.line_no", F.coalesce("near", F.struct(F.col("first"), F.lit(0).alias("distance"))).alias("by")
    )
    return found.select("doc_id", "line_no", F.col("by.first.doc_id").alias("first_doc_id"), F.col("by.first.line_no").alias("first_line_no"), F.col("by.distance").alias("distance"))


def drop_repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """docs without the lines that repeated_lines() finds: the same columns, with text (and n_chars, if there) of what is left.

    A document of which no line is left goes: all of it stands elsewhere. Documents without repeats, id or text pass unchanged; so does an empty table. Columns are
    known by name whatever its case.
    """
    numbers, kept, key = fresh(docs, "gs_numbers"), fresh(docs, "gs_left"), fresh(docs, "gs_doc_id")
    gone = repeated_lines(docs, threshold, per_edit).groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("line_no").alias(numbers))
    joined = docs.join(gone, docs["doc_id"].cast("long") == gone[key], "left")
    # what is in an array that a function's variable stands for is split once, and not for each line
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(numbers))
    left = F.get(F.transform(F.array(F.split("text", "\n")), lambda lines: F.transform(stay(lines), lambda i: F.get(lines, i))), F.lit(0))
    cut = F.when(F.col(numbers).isNotNull(), F.array_join(left, "\n"))
    joined = joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array(cut)).alias(kept))
    joined = joined.where(F.col(kept).isNull() | (F.trim(F.regexp_replace(kept, "\n", "")) != ""))
    new = {"text": F.coalesce(F.col(kept), F.col("text"))}
    if "n_chars" in {c.lower() for c in docs.columns}:
        new["n_chars"] = F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length(kept).cast("long"))
    return joined.select(*[new.get(c.lower(), F.col(f"`{c}`")).alias(c) for c in docs.columns])


def oracle(threshold: int = THRESHOLD, per_edit: int = CHARS_PER_EDIT, source: str = "documents") -> str:
    """DuckDB SQL for repeated_lines(documents): compares any two lines of nearly the same length.

    DuckDB's levenshtein counts bytes, so each character outside ASCII first becomes a control character of its own (there are 30 for them).
    """
    return f"""
WITH raw AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM {source} WHERE doc_id IS NOT NULL AND text IS NOT NULL),
spots AS (SELECT DISTINCT doc_id, CAST(line_no AS INTEGER) AS line_no, l FROM raw WHERE trim(l) <> ''),
other AS (SELECT DISTINCT unnest(string_split(l, '')) AS c FROM spots),
names AS (SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS a, coalesce(string_agg(chr(CAST(k + CASE WHEN k < 9 THEN 0 ELSE 2 END AS INTEGER)), '' ORDER BY c), '') AS b
  FROM (SELECT c, row_number() OVER (ORDER BY c) AS k FROM other WHERE unicode(c) > 127)),
firsts AS (SELECT l, translate(l, any_value(a), any_value(b)) AS t, length(l) AS n, min((doc_id, line_no)) AS first FROM spots, names GROUP BY l),
near AS (SELECT l, min((first, distance)) AS near FROM (
  SELECT x.l, y.first, levenshtein(x.t, y.t) AS distance, least({threshold}, least(x.n, y.n) // {per_edit}) AS most FROM firsts x JOIN firsts y ON y.n BETWEEN x.n - {threshold} AND x.n + {threshold} AND x.n >= {per_edit} AND y.n >= {per_edit} AND y.first < x.first)
  WHERE distance <= most GROUP BY l),
found AS (SELECT s.doc_id, s.line_no, coalesce(near.near[1], firsts.first) AS f, coalesce(near.near[2], 0) AS distance
  FROM spots s JOIN firsts USING (l) LEFT JOIN near USING (l) WHERE near.near IS NOT NULL OR firsts.first < (s.doc_id, s.line_no))
SELECT doc_id, line_no, f[1] AS first_doc_id, f[2] AS first_line_no, CAST(distance AS INTEGER) AS distance FROM found"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(read_table(spark, sf_dir, "documents", "doc_id", "text"))
