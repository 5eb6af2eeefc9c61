"""Parquet tables, with as many partitions as there are cores to work on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(rows: DataFrame) -> DataFrame:
    """rows in at least as many partitions as the session has cores. A scan of few row groups, as of a small file, is dealt out; a large table is left as it is, unshuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The table `name` of a folder, or some of its columns."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows.select(*columns) if columns else rows)
