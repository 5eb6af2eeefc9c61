"""Searches over a corpus of (table, row_id, data): one pattern, many in one pass, counts by pattern and table, table statistics, differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsieve.functions.pattern import ALGORITHMS, compile_like, plan_family
from glyphsieve.functions.text import count_overlapping, find_first, kmer_find

#: Patterns judged by one projection: more would outgrow the size of a compiled method.
AT_ONCE = 48


def as_corpus(rows: DataFrame, table: str, row_id: Column, text_column: str) -> DataFrame:
    """A text column as a table of a corpus. Nulls stay, so that filters reach the scan; searches and statistics take them as empty texts."""
    return rows.select(F.lit(table).alias("table"), row_id.cast("long").alias("row_id"), F.col(text_column).alias("data"))


def unpivot(rows: DataFrame, name: str, row_id: Column, columns: list[str]) -> DataFrame:
    """Several text columns as tables `name.column`, read in one scan."""
    cells = F.array(*[F.struct(F.lit(f"{name}.{c}").alias("table"), F.coalesce(F.col(c), F.lit("")).alias("data")) for c in columns])
    return rows.select(row_id.cast("long").alias("row_id"), F.explode(cells).alias("c")).select("c.table", "row_id", "c.data")


def execute(corpus: DataFrame, pattern: str, underscore: str = "byte") -> DataFrame:
    """The rows that match."""
    return corpus.where(compile_like(pattern, underscore).matches(F.col("data")))


def execute_all(corpus: DataFrame, patterns: list[str], underscore: str = "byte") -> DataFrame:
    """(pattern_index, table, row_id) of every match of every pattern, in one scan for each AT_ONCE patterns."""
    out = []
    for k in range(0, len(patterns), AT_ONCE):
        hits = [F.when(compile_like(p, underscore).matches(F.col("data")), F.lit(k + i)) for i, p in enumerate(patterns[k : k + AT_ONCE])]
        found = F.filter(F.array(*hits), lambda x: x.isNotNull())
        out.append(corpus.select(F.explode(found).alias("pattern_index"), "table", "row_id"))
    return reduce(DataFrame.unionByName, out)


def hits_by_pattern_table(tables: list[tuple[str, DataFrame, str]], patterns: list[str], underscore: str = "byte") -> DataFrame:
    """(pattern_index, pattern, table, hits), zeros included. tables: name, rows, text column. Tables of the same rows are read in one scan of them.

    One projection judges all texts of all tables by up to AT_ONCE patterns; each task sums up its hits, and what is shuffled is a row a pattern, table and task.
    """
    by_rows: dict[int, tuple[DataFrame, list[tuple[str, str]]]] = {}
    for name, rows, column in tables:
        by_rows.setdefault(id(rows), (rows, []))[1].append((name, column))
    parts = []
    for rows, columns in by_rows.values():
        cells = [F.struct(F.lit(name).alias("table"), F.col(column).alias("data")) for name, column in columns]
        parts.append(rows.select(F.explode(F.array(*cells)).alias("c")).select("c.*") if len(cells) > 1 else rows.select(F.lit(columns[0][0]).alias("table"), F.col(columns[0][1]).alias("data")))
    corpus, out = reduce(DataFrame.unionByName, parts), []
    for k in range(0, len(patterns), AT_ONCE):
        hits = [F.when(compile_like(p, underscore).matches(F.col("data")), F.lit(k + i)) for i, p in enumerate(patterns[k : k + AT_ONCE])]
        out.append(corpus.select("table", F.explode(F.array_compact(F.array(*hits))).alias("pattern_index")))
    counts = reduce(DataFrame.unionByName, out).groupBy("pattern_index", "table").agg(F.count("*").alias("hits"))
    every = corpus.sparkSession.createDataFrame([(i, p, name) for i, p in enumerate(patterns) for name, _, _ in tables], "pattern_index int, pattern string, table string")
    return every.join(counts, ["pattern_index", "table"], "left").select("pattern_index", "pattern", "table", F.coalesce("hits", F.lit(0)).alias("hits"))


def table_stats(corpus: DataFrame) -> DataFrame:
    """(table, rows, avg_len, max_len), lengths in bytes."""
    n = F.coalesce(F.octet_length("data"), F.lit(0))
    return corpus.groupBy("table").agg(F.count("*").alias("rows"), (F.coalesce(F.sum(n), F.lit(0)) / F.count("*")).alias("avg_len"), F.coalesce(F.max(n), F.lit(0)).cast("long").alias("max_len"))


def correctness_diff(actual: DataFrame, baseline: DataFrame) -> DataFrame:
    """(pattern_index, table, expected, actual) where counts differ; what the baseline lacks is expected to be 0."""
    base = baseline.select("pattern_index", "table", F.col("hits").alias("expected"))
    rows = actual.select("pattern_index", "table", F.col("hits").alias("actual")).join(base, ["pattern_index", "table"], "left")
    return rows.withColumn("expected", F.coalesce("expected", F.lit(0)).cast("long")).where("expected <> actual").select("pattern_index", "table", "expected", "actual")


def literal_sweep(corpus: DataFrame, literals: list[str], algorithms: list[str] | None = None) -> DataFrame:
    """(algorithm, pattern, table, hits) of literals by every algorithm that searches literals, k-mers of min(4, length) with one hit among them.

    All scans count the same way, so texts are judged once for each literal and way, and a row a table is dealt out to the algorithms.
    """
    names = algorithms or [a for a in ALGORITHMS if plan_family(a) == "scan"] + ["kmer"]
    sums: dict[tuple[bool, str], str] = {}
    for a in names:
        for p in literals:
            sums.setdefault((a == "kmer", p), f"n{len(sums)}")
    hits = lambda kmer, p: kmer_find(F.col("data"), p, min(len(p), 4), 1) if kmer else find_first(F.col("data"), p)
    count = lambda kmer, p: F.when(hits(kmer, p).isNotNull(), count_overlapping(F.col("data"), p)).otherwise(0).cast("long")
    totals = corpus.groupBy("table").agg(*[F.sum(count(*k)).alias(n) for k, n in sums.items()])
    cells = [F.struct(F.lit(a).alias("algorithm"), F.lit(p).alias("pattern"), F.col(sums[a == "kmer", p]).alias("hits")) for a in names for p in literals]
    return totals.select("table", F.explode(F.array(*cells)).alias("c")).select("c.algorithm", "c.pattern", "table", "c.hits")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "table string, row_id long, data string")
