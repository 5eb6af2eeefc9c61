"""MinHash near-dedup by a multi-index Hamming join.

A document's signature is HASHES minimum hashes of its word pairs, of which the low byte is kept. Signatures are split into chunks of CHUNK symbols. By
pigeonhole, two signatures that differ in fewer than 2 * HASHES / CHUNK symbols differ in at most one symbol of some chunk; that one error is enumerated by
masking each symbol of the chunk in turn. So all pairs up to MAX_DISTANCE meet under a masked chunk, and no pair is missed.

What is shuffled: 16 bytes a masked chunk of every distinct signature; the signatures themselves go only to the members of shared chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphsieve.llm._common import fresh, materialise, text_batches, whole_groups
from glyphsieve.llm._words import mix, words
from glyphsieve.llm.components import components
from glyphsieve.sources.tables import read_table

HASHES = 72
CHUNK = 6
#: Differing symbols of HASHES at most: at a resemblance of 0.8, pairs differ in 14.4 of them, standard deviation 3.4.
MAX_DISTANCE = 2 * HASHES // CHUNK - 1
#: Ids of a masked chunk that are compared with one another, or with so many others, in one place.
BLOCK = 4096
_SLICE = 1 << 20
_random = np.random.default_rng(20240229)
_MULTIPLIERS = _random.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_ADDENDS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def signatures_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (texts x HASHES bytes) of texts, and which texts have one: those with a word. A text of one word has the one shingle."""
    h, _, _, first, _ = words(text)
    n = np.diff(first)
    out = np.zeros((len(n), HASHES), np.uint8)
    some = np.flatnonzero(n > 0)
    if len(some) == 0:
        return out, n > 0
    shingle = h.copy()
    shingle[:-1] = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    last = first[1:][some] - 1
    single = n[some] == 1
    keep = np.ones(len(h), bool)
    keep[last[~single]] = False  # the pair across two texts
    shingle[last[single]] = h[last[single]]
    x = (shingle[keep] >> np.uint64(32)).astype(np.uint32)
    starts = np.zeros(len(some), np.int64)
    np.cumsum((n[some] - ~single)[:-1], out=starts[1:])
    for k in range(HASHES):
        v = mixed32(x * _MULTIPLIERS[k] + _ADDENDS[k])
        out[some, k] = np.minimum.reduceat(v, starts).astype(np.uint8)
    return out, n > 0


def mixed32(x: np.ndarray) -> np.ndarray:
    """Spreads the high bits of x over the low ones; one to one."""
    return x ^ (x >> np.uint32(15))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, text in text_batches(batches, 1, _SLICE):
        sig, has = signatures_of(text)
        kept = np.flatnonzero(has)
        data = pa.py_buffer(np.ascontiguousarray(sig[kept]).tobytes())
        offsets = pa.py_buffer((np.arange(len(kept) + 1) * HASHES).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.Array.from_buffers(pa.binary(), len(kept), [None, offsets, data])], names=["doc_id", "sig"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, sig) of the documents with an id and a word. docs: doc_id, text; rows and columns as they are, the text whole."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_signatures, "doc_id long, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES) if len(column) else np.zeros((0, HASHES), np.uint8)


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """The masked chunks (signatures x HASHES) of signatures, each an exact 64-bit number."""
    out = np.zeros((len(sig), HASHES), np.int64)
    for chunk in range(HASHES // CHUNK):
        part = sig[:, chunk * CHUNK : (chunk + 1) * CHUNK].astype(np.int64)
        for mask in range(CHUNK):
            key = np.full(len(sig), chunk * CHUNK + mask, np.int64)
            for i in range(CHUNK):
                if i != mask:
                    key = (key << 8) | part[:, i]
            out[:, chunk * CHUNK + mask] = key
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = chunk_keys(_matrix(batch.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), HASHES))], names=["key", "id"])


def bucket_edges(ids: np.ndarray, sig: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Edges between ids (sorted) of one bucket within `limit`, enough to connect all that are connected by such pairs: a pivot is compared with all ids of other components."""
    comp, edges = np.arange(len(ids)), []
    for p in range(len(ids)):
        rest = np.flatnonzero(comp != comp[p])
        if len(rest) == 0:
            break
        for q in rest[(sig[rest] != sig[p]).sum(1) <= limit]:
            if comp[q] != comp[p]:
                comp[comp == comp[q]] = comp[p]
                edges.append((int(min(ids[p], ids[q])), int(max(ids[p], ids[q]))))
    return edges


def _verified(limit: int, every: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of batches(key, p, q, id, sig) in order of these: all pairs within limit of each group of (key, p, q), or (every=False) a spanning part of them."""
    for key, p, q, ids, packed in whole_groups(batches, 3):
        sig = np.frombuffer(b"".join(packed.tolist()), np.uint8).reshape(-1, HASHES)
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]), [True]]))
        n = np.diff(edge)
        a, b = [], []
        if not every:  # first all ids against the first of their group, at once
            first = np.repeat(edge[:-1], n)
            step = 1 << 18
            near = np.concatenate([(sig[i : i + step] != sig[first[i : i + step]]).sum(1) <= limit for i in range(0, len(key), step)])
            link = np.flatnonzero(near & (first != np.arange(len(key))))
            a, b = [ids[first[link]]], [ids[link]]
            groups = np.flatnonzero(np.add.reduceat(~near, edge[:-1]) > 0)
        else:
            groups = np.flatnonzero(n > 1)
        for g in groups:
            i, j = edge[g], edge[g + 1]
            if every:
                for k in range(i, j - 1):
                    other = np.flatnonzero((sig[k + 1 : j] != sig[k]).sum(1) <= limit) + k + 1
                    a.append(np.full(len(other), ids[k]))
                    b.append(ids[other])
            else:
                pairs = np.array(bucket_edges(ids[i:j], sig[i:j], limit), np.int64).reshape(-1, 2)
                a.append(pairs[:, 0])
                b.append(pairs[:, 1])
        x, y = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (a, b))
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1).astype(np.int64), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def hamming_join(sigs: DataFrame, limit: int = MAX_DISTANCE, every: bool = True) -> DataFrame:
    """Pairs (a < b) of ids whose signatures differ in at most `limit` symbols: all of them, or (every=False) enough to connect what they connect.

    sigs: id, sig, unique by id. limit can't exceed MAX_DISTANCE, up to which the chunks guarantee that no pair is missed. The ids of a masked chunk are compared in
    blocks of BLOCK, each with itself and with every other, so that a chunk of however many is the work of many tasks, each of bounded memory.
    """
    if not 0 <= limit <= MAX_DISTANCE:
        raise ValueError(f"limit must be from 0 to {MAX_DISTANCE}")
    keys = sigs.select("id", "sig").mapInArrow(_keys, "key long, id long")
    group = Window.partitionBy("key")
    # counts and places come from a sort that spills; chunks of a single id go
    met = keys.select("key", "id", F.row_number().over(group.orderBy("id")).alias("place"), F.count("*").over(group).alias("n")).where("n > 1")
    block, last = F.floor((F.col("place") - 1) / BLOCK).cast("int"), F.floor((F.col("n") - 1) / BLOCK).cast("int")
    pairs = F.when(last == 0, F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))).otherwise(
        F.transform(F.sequence(F.lit(0), last), lambda o: F.struct(F.least(o, block).alias("p"), F.greatest(o, block).alias("q")))
    )
    rows = met.select("key", "id", F.explode(pairs).alias("o")).select("key", "o.p", "o.q", "id").join(sigs.select("id", "sig"), "id").select("key", "p", "q", "id", "sig")
    rows = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "id")
    return rows.mapInArrow(partial(_verified, limit, every), "a long, b long").distinct()


def near_groups(docs: DataFrame, limit: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, group_id) of all documents in a group of two or more: those connected by pairs of signatures within limit. group_id is the smallest doc_id.

    Exact copies have equal signatures, and are grouped by these alone. Documents without an id, text or word are in no group. Rows with one doc_id are one
    document: if their texts differ, it is in the groups of all of them, which are thereby one. Other columns are ignored; an empty table gives no rows.
    """
    sigs = materialise(signatures(docs).distinct())
    reps = materialise(sigs.groupBy("sig").agg(F.min("doc_id").alias("id")))
    # a doc_id may represent several signatures: ids of the join are their places in the order of (id, sig)
    twice = reps.groupBy("id").count().where("count > 1").limit(1).count() > 0
    if twice:
        reps = materialise(reps.select(F.xxhash64("id", "sig").alias("id"), "sig", F.col("id").alias("doc")))
        pairs = hamming_join(reps.select("id", "sig"), limit, every=False)
        pairs = pairs.join(reps.select(F.col("id").alias("a"), F.col("doc").alias("x")), "a").join(reps.select(F.col("id").alias("b"), F.col("doc").alias("y")), "b")
        pairs, reps = pairs.select(F.col("x").alias("a"), F.col("y").alias("b")), reps.select("sig", F.col("doc").alias("id"))
    else:
        pairs = hamming_join(reps, limit, every=False)
    copies = sigs.join(reps, "sig").where("id <> doc_id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    return components(pairs.unionByName(copies)).select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"))


def drop_near_duplicates(docs: DataFrame, limit: int = MAX_DISTANCE) -> DataFrame:
    """docs with one document of each group of near_groups(): that of the smallest doc_id. Same columns; of rows with one doc_id, all stay or all go.

    Documents without an id, text or word pass unchanged; so does an empty table.
    """
    gone = near_groups(docs, limit).where("doc_id <> group_id")
    key = fresh(docs, "gs_doc_id")
    gone = gone.select(F.col("doc_id").alias(key))
    return docs.join(gone, docs["doc_id"].cast("long") == gone[key], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read_table(spark, sf_dir, "documents", "doc_id", "text"))
