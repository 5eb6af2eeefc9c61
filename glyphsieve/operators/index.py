"""Candidate indexes as tables: byte trigrams and suffixes. Candidates are checked again, so every answer is that of a scan.

Both are (key, row) tables, written once in the order of their keys and then opened: a probe for a few keys reads the row groups whose range of keys holds one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsieve.functions.pattern import Pattern, byte_view, compile_like, latin1
from glyphsieve.sources.files import shared_folder

#: Bytes of a suffix that the suffix table keeps.
SUFFIX_BYTES = 24
#: A literal with more suffixes than the larger of these (a number, a share of all) is too broad to be worth probing.
BROAD, BROAD_SHARE = 100_000, 0.01
#: Bytes of texts taken at once, and of a row group of an index: small ones, so that a probe reads little.
_SLICE, _ROW_GROUP = 1 << 20, 2 << 20
#: Places whose suffixes are made at once, and bytes of a corpus whose suffixes or grams are sorted by one task.
_WINDOW, _PART = 1 << 15, {"trigram": 16 << 20, "suffix": 2 << 20}


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of batches(..., data) of about _SLICE bytes, with the bytes of all their texts and the n + 1 places of these."""
    for batch in batches:
        data = batch.column(batch.num_columns - 1).cast(pa.large_binary()).fill_null(b"")
        at = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        i = 0
        while i < len(data):
            j = max(i + 1, int(np.searchsorted(at, at[i] + _SLICE, side="right")) - 1)
            raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[at[i] : at[j]]
            yield batch.slice(i, j - i), raw, at[i : j + 1] - at[i]
            i = j


def _postings(borders: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, raw, at in slices(batches):
        if len(raw) < 3:
            continue
        names = batch.column(0).dictionary_encode()
        code = names.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")  # rows of a table together
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        gram = (raw[:-2].astype(np.int64) << 16) | (raw[1:-1].astype(np.int64) << 8) | raw[2:]
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        inside = row[:-2] == row[2:]  # a run doesn't reach into the next text
        key = np.unique((gram[inside] << 32) | place[row[:-2][inside]])
        if not len(key):
            continue
        gram, row = key >> 32, order[key & 0xFFFFFFFF]
        first = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (code[row[1:]] != code[row[:-1]]))))
        ids = batch.column(1).take(pa.array(row))
        some = gram[first].astype(np.int32)
        part = np.searchsorted(borders, some, side="right").astype(np.int32)
        cells = [part, some, names.dictionary.take(pa.array(code[row[first]])), pa.LargeListArray.from_arrays(pa.array(np.append(first, len(key))), ids).cast(pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in cells], names=["part", "gram", "table", "ids"])


def _gram_parts(corpus: DataFrame, borders: list[bytes]) -> DataFrame:
    """(part, gram, table, ids): the rows of a stretch of texts that hold a gram, together; part is the place of the gram among the borders."""
    rows = corpus.where(F.octet_length("data") >= 3).select("table", F.col("row_id").cast("long").alias("row_id"), "data")
    places = np.array([int.from_bytes(b[:3].ljust(3, b"\0"), "big") for b in borders], np.int32)
    return rows.mapInArrow(partial(_postings, places), "part int, gram int, table string, ids array<long>")


def trigram_index(corpus: DataFrame) -> DataFrame:
    """(gram, table, row_id): the distinct runs of three bytes of each text, as numbers of 24 bits."""
    return _gram_parts(corpus, []).select("gram", "table", F.explode("ids").alias("row_id"))


def grams_of(literal: str) -> list[int]:
    b = literal.encode()
    return sorted({int.from_bytes(b[i : i + 3], "big") for i in range(len(b) - 2)})


def trigram_candidates(index: DataFrame, literal: str) -> DataFrame | None:
    """(table, row_id) of the rows that hold all runs of three bytes of a literal; None if it has none."""
    grams = grams_of(literal)
    if not grams:
        return None
    return index.where(F.col("gram").isin(grams)).groupBy("table", "row_id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("table", "row_id")


def trigram_like(corpus: DataFrame, index: DataFrame, pattern: str, underscore: str = "byte") -> DataFrame:
    """execute() by way of the index: candidates of the longest literal, the last of equals, then the pattern; a scan where no literal has three bytes."""
    compiled = compile_like(pattern, underscore)
    usable = [x for x in compiled.literals if len(x.encode()) >= 3]
    if usable:
        longest = max(enumerate(usable), key=lambda x: (len(x[1].encode()), x[0]))[1]
        corpus = corpus.join(trigram_candidates(index, longest), ["table", "row_id"], "left_semi")
    return corpus.where(compiled.matches(F.col("data")))


def _suffixes(keep: int, borders: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wide = np.where(np.arange(256) < 128, 1, 2)
    for batch, raw, at in slices(batches):
        for low in range(0, len(raw), _WINDOW):
            place = np.arange(low, min(low + _WINDOW, len(raw)))
            row = np.searchsorted(at, place, side="right") - 1
            upto = np.minimum(place + keep, at[row + 1])
            own = raw[low : int(upto.max())]
            # a byte becomes one character, of one or two bytes in UTF-8
            text = np.frombuffer(own.tobytes().decode("iso-8859-1").encode(), np.uint8)
            begin = np.zeros(len(own) + 1, np.int64)
            np.cumsum(wide[own], out=begin[1:])
            first = begin[place - low]
            sizes = begin[upto - low] - first
            offsets = np.zeros(len(place) + 1, np.int64)
            np.cumsum(sizes, out=offsets[1:])
            data = text[np.repeat(first - offsets[:-1], sizes) + np.arange(offsets[-1])]
            suffix = pa.Array.from_buffers(pa.string(), len(place), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
            head = np.zeros(len(place), np.uint64)
            padded = np.concatenate((own, np.zeros(8, np.uint8)))
            for k in range(8):
                head = (head << np.uint64(8)) | np.where(place + k < upto, padded[place - low + k], 0).astype(np.uint64)
            part, take = np.searchsorted(borders, head, side="right").astype(np.int32), pa.array(row)
            cells = [pa.array(part), suffix, batch.column(0).take(take), batch.column(1).take(take), pa.array((place - at[row]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cells, names=["part", "suffix", "table", "row_id", "position"])


def _suffix_parts(corpus: DataFrame, borders: list[bytes], keep: int = SUFFIX_BYTES) -> DataFrame:
    """(part, suffix, table, row_id, position): part is the place of a suffix' first 8 bytes among those of the borders."""
    rows = corpus.where(F.octet_length("data") > 0).select("table", F.col("row_id").cast("long").alias("row_id"), "data")
    places = np.array([int.from_bytes(b[: min(8, keep)].ljust(8, b"\0"), "big") for b in borders], np.uint64)
    return rows.mapInArrow(partial(_suffixes, keep, places), "part int, suffix string, table string, row_id long, position int")


def suffix_index(corpus: DataFrame, keep: int = SUFFIX_BYTES) -> DataFrame:
    """(suffix, table, row_id, position): the first `keep` bytes of every suffix of each text, a character a byte; positions from 0."""
    return _suffix_parts(corpus, [], keep).drop("part")


def _borders(corpus: DataFrame, part: int) -> list[bytes]:
    """Beginnings of suffixes that part those of a corpus in ranges of about the same size: at least one a core, unless it is small, and one for every `part` bytes.

    They only tell what is sorted together. They are of every so many-th place, some 50,000 in all, sought without leaving the JVM, so that texts aren't indexed twice.
    """
    total = corpus.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    n = max(min(corpus.sparkSession.sparkContext.defaultParallelism, total >> 16), total // part) + 1
    step = max(1, total // max(50_000, 50 * n))
    start = (F.pmod(F.xxhash64("table", "row_id"), F.lit(step)) + 1).cast("int")
    rows = corpus.select(F.encode("data", "utf-8").alias("b"), start.alias("s")).where(F.col("s") <= F.octet_length("b"))
    places = F.transform(F.sequence("s", F.octet_length("b"), F.lit(step)), lambda i: F.substring("b", i, F.lit(8)))
    seen = sorted(bytes(r[0]) for r in rows.select(F.explode(places)).collect()) if n > 1 else []
    return sorted({seen[len(seen) * k // n] for k in range(1, n)}) if seen else []


def write_index(corpus: DataFrame, kind: str, path: str) -> None:
    """The trigram or suffix index of a corpus as Parquet, its keys in order over all files and within them."""
    borders = _borders(corpus, _PART[kind])
    key = "gram" if kind == "trigram" else "suffix"
    rows = _gram_parts(corpus, borders) if kind == "trigram" else _suffix_parts(corpus, borders)
    rows = rows.repartitionById(len(borders) + 1, "part").sortWithinPartitions(key).drop("part")
    if kind == "trigram":
        rows = rows.select("gram", "table", F.explode("ids").alias("row_id"))
    rows.write.option("parquet.block.size", str(_ROW_GROUP)).mode("overwrite").parquet(path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def persisted(corpus: DataFrame, kind: str, name: str) -> DataFrame:
    """The trigram or suffix index of a corpus, opened from the cluster's shared folder; written there first, if no session did so before.

    name: what tells this corpus, as it is now, from all others. An index that a lost session left unfinished has no _SUCCESS file, and is written again.
    """
    spark = corpus.sparkSession
    path = f"{shared_folder(spark)}/{kind}-{hashlib.sha1(name.encode()).hexdigest()}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        write_index(corpus, kind, path)
    return open_index(spark, path)


def _starts(c, prefix: str):
    """startswith() for the characters of byte views, with its range of keys, by which row groups are left out."""
    return c.startswith(prefix) & (c >= prefix) & (c < prefix + "Ā")


def suffix_search(index: DataFrame, literal: str, corpus: DataFrame | None = None, keep: int = SUFFIX_BYTES) -> DataFrame:
    """(table, row_id, position) of a literal. One longer than `keep` bytes is probed by its beginning, and needs the corpus to be checked again."""
    b = literal.encode()
    found = index.where(_starts(F.col("suffix"), latin1(literal)[:keep])).select("table", "row_id", "position")
    if len(b) <= keep:
        return found
    if corpus is None:
        raise ValueError(f"a literal of more than {keep} bytes needs the corpus")
    rows = found.join(corpus, ["table", "row_id"])
    return rows.where(F.substring(byte_view(F.col("data")), F.col("position") + 1, F.lit(len(b))) == latin1(literal)).select("table", "row_id", "position")


def suffix_search_wildcard(index: DataFrame, pattern: str, corpus: DataFrame | None = None, keep: int = SUFFIX_BYTES) -> DataFrame:
    """suffix_search() of a pattern whose _ stands for any one byte. One longer than `keep` bytes needs the corpus."""
    view = latin1(pattern)

    def fits(c, p: str):
        compiled = compile_like(p + "%", "char")
        return Pattern(p, "char", compiled.tokens, 0, compiled.strategy).matches(c)

    found = index.where(fits(F.col("suffix"), view[:keep]))
    if head := view[:keep].split("_")[0]:
        found = found.where(_starts(F.col("suffix"), head))
    found = found.select("table", "row_id", "position")
    if len(view) <= keep:
        return found
    if corpus is None:
        raise ValueError(f"a pattern of more than {keep} bytes needs the corpus")
    rows = found.join(corpus, ["table", "row_id"])
    return rows.where(fits(F.substring(byte_view(F.col("data")), F.col("position") + 1, F.lit(len(view))), view)).select("table", "row_id", "position")


def selectivity(index: DataFrame, literals: list[str]) -> DataFrame:
    """(literal, n, broad): the suffixes that begin with each literal, and whether they are too many to be worth probing. One scan of the ranges of keys of all literals;
    how many suffixes there are is told by the files' footers."""
    begins = [_starts(F.col("suffix"), latin1(x)) for x in literals]
    counts = [F.coalesce(F.sum(x.cast("long")), F.lit(0)).alias(f"n{i}") for i, x in enumerate(begins)]
    cells = F.array(*[F.struct(F.lit(x).alias("literal"), F.col(f"n{i}").alias("n")) for i, x in enumerate(literals)])
    rows = index.where(reduce(Column.__or__, begins)).agg(*counts).select(F.explode(cells).alias("c"))
    rows = rows.crossJoin(F.broadcast(index.agg(F.count("*").alias("total"))))
    return rows.select("c.literal", "c.n", (F.col("c.n") > F.greatest(F.lit(BROAD), F.floor(F.col("total") * BROAD_SHARE))).alias("broad"))


def intersect(sets: list[DataFrame]) -> DataFrame:
    """The rows that all sets of (table, row_id) have."""
    first = sets[0].select("table", "row_id").distinct()
    return reduce(lambda x, y: x.join(y, ["table", "row_id"], "left_semi"), sets[1:], first)


class SuffixLookup:
    """Searches of a suffix index that remember what they found out: the number of suffixes of the index, and of those that begin with each literal asked for.

    A count is a probe of a range of keys, not a scan.
    """

    def __init__(self, index: DataFrame, corpus: DataFrame | None = None, keep: int = SUFFIX_BYTES):
        self.index, self.corpus, self.keep = index, corpus, keep
        self._total: int | None = None
        self._counts: dict[str, int] = {}

    def count(self, literal: str) -> int:
        """Suffixes that begin with the first `keep` bytes of a literal."""
        if literal not in self._counts:
            self._counts[literal] = self.index.where(_starts(F.col("suffix"), latin1(literal)[: self.keep])).count()
        return self._counts[literal]

    def broad(self, literal: str) -> bool:
        if self._total is None:
            self._total = self.index.count()
        return self.count(literal) > max(BROAD, int(self._total * BROAD_SHARE))

    def rows(self, literal: str) -> DataFrame:
        """(table, row_id, position) of the suffixes that count() counts."""
        return self.index.where(_starts(F.col("suffix"), latin1(literal)[: self.keep])).select("table", "row_id", "position")


def suffix_like(corpus: DataFrame, index: DataFrame | SuffixLookup, pattern: str, underscore: str = "byte", keep: int = SUFFIX_BYTES) -> DataFrame:
    """execute() by way of the index: plain strategies need none; else rows that hold every literal that isn't too broad, rarest first, then the pattern; a scan if
    none is left."""
    compiled = compile_like(pattern, underscore)
    lookup = index if isinstance(index, SuffixLookup) else SuffixLookup(index, corpus, keep)
    if compiled.strategy in ("percent", "general") and compiled.literals:
        usable = sorted((x for x in dict.fromkeys(compiled.literals) if not lookup.broad(x)), key=lookup.count)
        if usable:
            corpus = corpus.join(intersect([lookup.rows(x) for x in usable]), ["table", "row_id"], "left_semi")
    return corpus.where(compiled.matches(F.col("data")))
