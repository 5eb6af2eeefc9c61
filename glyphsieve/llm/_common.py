"""What the operators of this subpackage share: shared-folder tables, checked broadcasts, fresh names."""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its counted rows need no more than this.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where a local session names none."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = os.path.join(tempfile.gettempdir(), "glyphsieve-shared")
    return d.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/glyphsieve-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def share(spark: SparkSession, value: Any) -> str:
    """Writes value into the shared folder; the place from which shared() reads it in any task."""
    path = f"{shared_dir(spark)}/glyphsieve-{uuid.uuid4().hex}.pickle"
    fs, at = pa.fs.FileSystem.from_uri(path)
    fs.create_dir(at.rpartition("/")[0])
    with fs.open_output_stream(at) as out:
        out.write(pickle.dumps(value, pickle.HIGHEST_PROTOCOL))
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def shared(path: str) -> Any:
    fs, at = pa.fs.FileSystem.from_uri(path)
    with fs.open_input_stream(at) as f:
        return pickle.loads(f.read())


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df marked for broadcast if `rows` rows of `row_bytes` stay under BROADCAST_BYTES; otherwise df as it is, so that the join shuffles."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def measured_side(df: DataFrame) -> DataFrame:
    """df, a table in the shared folder, marked for broadcast if its rows, measured, stay under BROADCAST_BYTES; otherwise as it is, so that the join shuffles."""
    n = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))) + 16 * len(df.columns)
    return F.broadcast(df) if (df.agg(F.sum(n.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else df


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def slices(offsets, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes reach about `limit`; a single longer row stands alone. offsets: n + 1 byte offsets."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(offsets.searchsorted(offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def text_batches(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of each batch of about `limit` text bytes, and their text column as a 64-bit string array."""
    from glyphsieve.llm._words import offsets_of

    for batch in batches:
        text = batch.column(column).cast(pa.large_string())
        for i, j in slices(offsets_of(text), limit):
            yield batch.slice(i, j - i), text.slice(i, j - i)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of batches in order of their first `keys` columns, in parts that never divide rows that agree in these."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        got = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
        held = got if held is None else [np.concatenate(x) for x in zip(held, got)]
        n = len(held[0])
        same = np.ones(n, bool)
        for k in range(keys):
            same &= held[k] == held[k][-1] if n else True
        cut = n - int(np.argmin(same[::-1])) if n and not same.all() else 0
        if cut:
            yield [x[:cut] for x in held]
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield held
