"""The test tables as a corpus and as a results table, in Spark and in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsieve.functions.text import quote
from glyphsieve.operators import engine
from glyphsieve.sources.tables import read_table

#: Table of the corpus, file, row id (an expression of both dialects), text column.
COLUMNS = (
    ("part.p_name", "part", "p_partkey", "p_name"), ("part.p_type", "part", "p_partkey", "p_type"), ("part.p_brand", "part", "p_partkey", "p_brand"),
    ("customer.c_mktsegment", "customer", "c_custkey", "c_mktsegment"), ("orders.o_orderpriority", "orders", "o_orderkey", "o_orderpriority"),
    ("documents.text", "documents", "doc_id", "text"), ("conversations.text", "conversations", "conv_id * 1000 + turn", "text"), ("pages.html", "pages", "page_id", "html"),
)
SMALL = tuple(c for c in COLUMNS if c[1] in ("part", "customer", "orders"))
PATTERNS = ["%bolt%", "blue%", "%gear", "b%t", "ECONOMY", "%", "%the%ing%", "%a%e%i%o%", "BUILD%G", "%_PROM_%", "_-%", "%e_t%", "%re_d%on%", "%\\%", "%💩%", "1-URGENT", "%%"]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return read_table(spark, sf_dir, table)


def corpus(spark: SparkSession, sf_dir: str, columns=COLUMNS) -> DataFrame:
    return reduce(DataFrame.unionByName, [engine.as_corpus(load(spark, sf_dir, t), name, F.expr(key), c) for name, t, key, c in columns])


def corpus_sql(columns=COLUMNS) -> str:
    return "corpus AS (" + " UNION ALL ".join(f"SELECT '{name}' AS \"table\", CAST({key} AS BIGINT) AS row_id, coalesce({c}, '') AS data FROM {t}" for name, t, key, c in columns) + ")"


def values(rows: list[tuple], *names: str) -> str:
    """A table of constants."""
    cell = lambda x: quote(x) if isinstance(x, str) else "NULL" if x is None else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS v({', '.join(names)})"


def patterns_sql(patterns: list[str] = PATTERNS) -> str:
    return "SELECT * FROM " + values([(i, p) for i, p in enumerate(patterns)], "pattern_index", "pattern")


_PATTERN = "CASE k % 4 WHEN 0 THEN concat('w', repeat('x', CAST(k % 23 AS INT)), CAST(k AS STRING)) WHEN 1 THEN concat('%', repeat('yz', CAST(k % 17 AS INT)), CAST(k AS STRING), '%') WHEN 2 THEN concat('a_%', CAST(k AS STRING)) ELSE concat(CAST(k AS STRING), '%b') END"
_TOLD = "CASE k % 5 WHEN 0 THEN concat('own-len-exists|len=', CAST(k % 13 * 16 + 4 AS STRING)) WHEN 1 THEN concat('own-len-nomatch|len=', CAST(k % 7 * 25 + 20 AS STRING)) WHEN 2 THEN '' ELSE concat('contains:', CAST(k AS STRING)) END"
_NAMED = "CASE event_type WHEN 'click' THEN 'kmp' WHEN 'error' THEN 'fm' WHEN 'purchase' THEN 'trigram' WHEN 'signup' THEN 'std' ELSE 'bm' END"
_RESULTS = f"""SELECT concat('d', CAST(user_id % 4 AS STRING)) AS dataset, {_NAMED} AS algorithm, k AS pattern_index, {_PATTERN} AS pattern, {_TOLD} AS pattern_desc, concat('t', CAST(user_id AS STRING)) AS `table`, 'text' AS file_type,
  CAST(value AS DECIMAL(18, 4)) AS duration, CAST(event_id % 17 AS BIGINT) AS found_count, event_id % 50 = 0 AS skipped, CAST(user_id % 1000 + 1 AS BIGINT) AS table_rows, CAST(user_id % 97 AS DOUBLE) / 4 + 1.5 AS table_avg_len,
  CAST(user_id % 97 * 3 + 5 AS BIGINT) AS table_max_len, CAST(row_number() OVER (PARTITION BY event_type, user_id, props ORDER BY event_id) AS INT) AS run
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM SOURCE)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `events` as a table of search timings: event_type stands for the algorithm, value for the duration, user_id for the table, props for the pattern."""
    return spark.sql(_RESULTS.replace("SOURCE", "{events}"), events=load(spark, sf_dir, "events"))


def results_sql() -> str:
    return "results AS (" + _RESULTS.replace("SOURCE", "events").replace("`table`", '"table"').replace("STRING", "VARCHAR").replace("AS INT)", "AS INTEGER)") + ")"
