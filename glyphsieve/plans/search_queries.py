"""Queries of sources, predicates, search functions, indexes and execution, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsieve.functions import text as T
from glyphsieve.operators import engine, index
from glyphsieve.plans.tables import COLUMNS, PATTERNS, SMALL, corpus, corpus_sql, load, patterns_sql, values
from glyphsieve.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def matching(name: str, columns, pattern: str, underscore: str, condition: str) -> None:
    """All rows of some columns that match a pattern."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine.execute(corpus(spark, sf_dir, columns), pattern, underscore).select("table", "row_id")

    query(name, f'WITH {corpus_sql(columns)} SELECT "table", row_id FROM corpus WHERE {condition}')(run)


TEXTS = tuple(c for c in COLUMNS if c[1] in ("documents", "conversations"))
matching("like_all", SMALL, "%%", "byte", "data LIKE '%%'")
matching("like_exact", SMALL, "ECONOMY", "byte", "data = 'ECONOMY'")
matching("like_prefix", SMALL, "blue%", "byte", "data LIKE 'blue%'")
matching("like_suffix", SMALL, "%gear", "byte", "data LIKE '%gear'")
matching("like_contains", COLUMNS, "%the%", "byte", "data LIKE '%the%'")
matching("like_underscore_byte", TEXTS, "% _ %", "byte", "regexp_full_match(hex(encode(data)), '(..)*20..20(..)*')")
matching("like_underscore_char", TEXTS, "% _ %", "char", "data LIKE '% _ %'")
matching("like_percent_only", COLUMNS, "%a%e%on%", "byte", "data LIKE '%a%e%on%'")
matching("like_two_literals", SMALL, "b%t", "byte", "data LIKE 'b%t'")
matching("like_anchored_overlap", SMALL, "BUILDING%G", "byte", "data LIKE 'BUILDING%G'")
matching("like_general", COLUMNS, "%e_t%on%", "char", "data LIKE '%e_t%on%'")
matching("min_len_filter", SMALL, "________%", "byte", "octet_length(encode(data)) >= 8")
matching("execute_single", COLUMNS, "%the%ing%", "byte", "data LIKE '%the%ing%'")


@query("like_literal_underscore", "SELECT 'nation.n_name' AS \"table\", CAST(n_nationkey AS BIGINT) AS row_id FROM nation WHERE n_name LIKE '%N\\_1%' ESCAPE '\\'")
def _(spark, d):
    return engine.execute(engine.as_corpus(load(spark, d, "nation"), "nation.n_name", F.col("n_nationkey"), "n_name"), "%N_1%", "literal").select("table", "row_id")


@query("unpivot_columns", f'WITH {corpus_sql(SMALL[:3])} SELECT "table", row_id, data FROM corpus')
def _(spark, d):
    return engine.unpivot(load(spark, d, "part"), "part", F.col("p_partkey"), ["p_name", "p_type", "p_brand"])


@query("exclude_contains", f"WITH {corpus_sql(SMALL)} SELECT \"table\", row_id FROM corpus WHERE NOT contains(data, 'bolt') AND NOT contains(data, 'URG')")
def _(spark, d):
    return files.exclude(corpus(spark, d, SMALL), "data", ["bolt", "", "URG"]).select("table", "row_id")


@query("clip_bytes", "SELECT doc_id, left(text, CAST(list_max(list_filter(range(0, least(length(text), 40) + 1), lambda k: octet_length(encode(left(text, CAST(k AS INTEGER)))) <= 40)) AS INTEGER)) AS clipped FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", T.clip_bytes(F.col("text"), 40).alias("clipped"))


@query("bytes_equal", "SELECT p_partkey, encode(p_name) = encode(reverse(reverse(p_name))) AS same FROM part")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", T.bytes_equal(F.col("p_name"), F.reverse(F.reverse("p_name"))).alias("same"))


def patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(PATTERNS)), "pattern_index int, pattern string")


_P = f"({patterns_sql()}) AS p"
_LESS = "length(pattern) - length(replace(pattern, '{}', ''))"


@query("pattern_strategy", f"""SELECT pattern, CASE WHEN s = '%' THEN 'all' WHEN NOT regexp_matches(s, '[%_]') THEN 'exact' WHEN contains(s, '_') THEN 'general' WHEN regexp_matches(s, '^[^%]+%$') THEN 'prefix'
  WHEN regexp_matches(s, '^%[^%]+$') THEN 'suffix' WHEN regexp_matches(s, '^%[^%]+%$') THEN 'contains' ELSE 'percent' END AS strategy FROM (SELECT pattern, regexp_replace(pattern, '%+', '%', 'g') AS s FROM {_P})""")
def _(spark, d):
    return patterns(spark).select("pattern", T.pattern_strategy(F.col("pattern")).alias("strategy"))


@query("pattern_kind", f"""SELECT pattern, CASE WHEN NOT regexp_matches(pattern, '[%_]') THEN 'exact' WHEN regexp_full_match(pattern, '%[^%_]*%') THEN 'contains' ELSE 'wildcard' END AS kind FROM {_P}""")
def _(spark, d):
    return patterns(spark).select("pattern", T.pattern_kind(F.col("pattern")).alias("kind"))


@query("pattern_literals", f"SELECT pattern, array_to_string(list_filter(regexp_split_to_array(pattern, '[%_]+'), lambda x: x <> ''), '|') AS literals FROM {_P}")
def _(spark, d):
    return patterns(spark).select("pattern", F.array_join(T.pattern_literals(F.col("pattern")), "|").alias("literals"))


@query("pattern_complexity", f"SELECT pattern, score, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS norm FROM (SELECT pattern, CAST(3 * ({_LESS.format('%')}) + 2 * ({_LESS.format('_')}) + length(pattern) AS INTEGER) AS score FROM {_P})")
def _(spark, d):
    rows = patterns(spark).select("pattern", T.complexity(F.col("pattern")).alias("score"))
    ends = rows.agg(F.min("score").alias("a"), F.max("score").alias("b"))
    return rows.crossJoin(F.broadcast(ends)).select("pattern", "score", ((F.col("score") - F.col("a")) / (F.col("b") - F.col("a"))).alias("norm"))


_DESCRIBED = [("%abc%", "len=12 exists"), ("a_c%", "other"), ("abc", ""), ("%%", None)]


@query("literal_length", f"SELECT pattern, CAST(coalesce(TRY_CAST(nullif(regexp_extract(description, 'len=([0-9]+)', 1), '') AS INTEGER), length(regexp_replace(pattern, '[%_]', '', 'g'))) AS INTEGER) AS n FROM {values(_DESCRIBED, 'pattern', 'description')}")
def _(spark, d):
    return spark.createDataFrame(_DESCRIBED, "pattern string, description string").select("pattern", T.literal_length(F.col("pattern"), F.col("description")).alias("n"))


_CONV = "CAST(conv_id * 1000 + turn AS BIGINT) AS row_id"


def row_id():
    return F.expr("conv_id * 1000 + turn").alias("row_id")


@query("find_first", f"SELECT {_CONV}, CASE WHEN contains(text, 'en') THEN CAST(octet_length(encode(left(text, CAST(strpos(text, 'en') - 1 AS INTEGER)))) AS INTEGER) END AS place FROM conversations")
def _(spark, d):
    return load(spark, d, "conversations").select(row_id(), T.find_first(F.col("text"), "en").alias("place"))


_HEX_AT = "list_filter(range(0, octet_length(encode(text))), lambda i: substr(hex(encode(text)), CAST(2 * i + 1 AS BIGINT), 6) = '656E65')"


@query("find_all_positions", f"SELECT {_CONV}, array_to_string({_HEX_AT}, ',') AS places FROM conversations")
def _(spark, d):
    return load(spark, d, "conversations").select(row_id(), F.array_join(T.find_all(F.col("text"), "ene").cast("array<string>"), ",").alias("places"))


@query("count_overlapping", "SELECT doc_id, CAST(len(list_filter(range(2, len(p) + 1), lambda i: starts_with(p[i], 'e') OR (p[i] = '' AND i < len(p)))) AS INTEGER) AS n FROM (SELECT doc_id, string_split(text, 'en') AS p FROM documents)")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", T.count_overlapping(F.col("text"), "ene").alias("n"))


@query("kmer_diagonals", """WITH q AS (SELECT substr('blue gear', j + 1, 3) AS g, j FROM (SELECT unnest(range(0, 7)) AS j)), t AS (SELECT p_partkey AS id, substr(p_name, CAST(i + 1 AS BIGINT), 3) AS g, i FROM (SELECT p_partkey, p_name, unnest(range(0, length(p_name) - 2)) AS i FROM part))
SELECT id, CAST(i - j AS INTEGER) AS diagonal, count(*) AS hits FROM t JOIN q USING (g) WHERE i >= j GROUP BY id, i - j HAVING count(*) >= 2""")
def _(spark, d):
    return T.kmer_diagonals(load(spark, d, "part"), "p_partkey", "p_name", "blue gear", 3, 2)


@query("kmer_find", "SELECT p_partkey, CAST(nullif(strpos(p_name, 'gear'), 0) - 1 AS INTEGER) AS place FROM part")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", T.kmer_find(F.col("p_name"), "gear", 3, 2).alias("place"))


@query("find_wildcard", f"SELECT {_CONV}, CAST(octet_length(encode(regexp_extract(hex(encode(text)), '^((?:..)*?)65..65', 1))) // 2 AS INTEGER) + CASE WHEN regexp_matches(hex(encode(text)), '^(..)*65..65') THEN 0 ELSE NULL END AS place FROM conversations")
def _(spark, d):
    return load(spark, d, "conversations").select(row_id(), T.find_wildcard(F.col("text"), "e_e").alias("place"))


_BYTES = "SELECT unnest(list_transform(range(0, octet_length(encode({0}))), lambda i: CAST('0x' || substr(hex(encode({0})), CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER))) AS byte"


@query("byte_frequency", f"SELECT byte, count(*) AS n FROM ({_BYTES.format('text')} FROM conversations) GROUP BY byte")
def _(spark, d):
    return T.byte_frequency(load(spark, d, "conversations"), "text")


_LITERALS = [("the",), ("Zorn",), ("été",), ("%",), ("bb",)]
_LIT = values(_LITERALS, "literal")


@query("literal_rarity", f"""WITH f AS (SELECT byte, count(*) AS n FROM ({_BYTES.format('text')} FROM conversations) GROUP BY byte), b AS (SELECT literal, {_BYTES.format('literal')[7:]} FROM {_LIT})
SELECT literal, CAST(min(coalesce(n, 0)) AS BIGINT) AS rarity FROM b LEFT JOIN f USING (byte) GROUP BY literal""")
def _(spark, d):
    return T.literal_rarity(T.byte_frequency(load(spark, d, "conversations"), "text"), spark.createDataFrame(_LITERALS, "literal string"))


@query("rarest_byte", f"""WITH b AS (SELECT literal, generate_subscripts(range(0, octet_length(encode(literal))), 1) AS i, {_BYTES.format('literal')[7:]} FROM {_LIT}), c AS (SELECT literal, byte, count(*) AS n, min(i) AS i FROM b GROUP BY literal, byte)
SELECT literal, arg_min(byte, (n, i)) AS byte FROM c GROUP BY literal""")
def _(spark, d):
    return T.rarest_byte(spark.createDataFrame(_LITERALS, "literal string"))


_SUPPLIER = ("supplier.s_name", "supplier", "s_suppkey", "s_name")
INDEXED = (*SMALL[:3], _SUPPLIER, TEXTS[1])
_GRAMS = f"""{corpus_sql(TEXTS)}, grams AS (SELECT DISTINCT "table", row_id, unnest(list_transform(range(0, octet_length(encode(data)) - 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 6) AS INTEGER))) AS gram FROM (SELECT *, hex(encode(data)) AS h FROM corpus))"""


def indexed(spark: SparkSession, sf_dir: str, kind: str, columns) -> tuple[DataFrame, DataFrame]:
    """A corpus of the test tables and its index, which the first query of all that ask for it writes."""
    jvm = spark.sparkContext._jvm
    place = lambda t: jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
    told = sorted({t for _, t, _, _ in columns})
    times = [place(t).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place(t)).getModificationTime() for t in told]
    rows = corpus(spark, sf_dir, columns)
    return rows, index.persisted(rows, kind, f"{sf_dir} {columns} {times}")


@query("trigram_index", f'WITH {_GRAMS} SELECT gram, "table", row_id FROM grams')
def _(spark, d):
    return indexed(spark, d, "trigram", TEXTS)[1]


@query("trigram_candidates", f"""WITH {_GRAMS} SELECT "table", row_id FROM grams WHERE gram IN ({0x746865}, {0x686572}, {0x657265}) GROUP BY ALL HAVING count(*) = 3""")
def _(spark, d):
    return index.trigram_candidates(indexed(spark, d, "trigram", TEXTS)[1], "there")


@query("trigram_like", f'WITH {corpus_sql(TEXTS)} SELECT "table", row_id FROM corpus WHERE data LIKE \'%the%tion%\'')
def _(spark, d):
    return index.trigram_like(*indexed(spark, d, "trigram", TEXTS), "%the%tion%").select("table", "row_id")


_SUFFIXES = f"""{corpus_sql(INDEXED)}, hexed AS (SELECT "table", row_id, hex(encode(data)) AS h, CAST(unnest(range(0, octet_length(encode(data)))) AS INTEGER) AS i FROM corpus), suffixes AS (SELECT "table", row_id, i AS position, substr(h, CAST(2 * i + 1 AS BIGINT), {2 * index.SUFFIX_BYTES}) AS suffix FROM hexed)"""


@query("suffix_index", f'WITH {_SUFFIXES} SELECT suffix, "table", row_id, position FROM suffixes')
def _(spark, d):
    """Suffixes in hexadecimal, since DuckDB has no text with a character a byte."""
    return indexed(spark, d, "suffix", INDEXED)[1].withColumn("suffix", F.hex(F.encode("suffix", "iso-8859-1")))


def _hex(text: str) -> str:
    return text.encode().hex().upper()


@query("suffix_search", f"WITH {_SUFFIXES} SELECT \"table\", row_id, position FROM suffixes WHERE starts_with(suffix, '{_hex('bo')}')")
def _(spark, d):
    return index.suffix_search(indexed(spark, d, "suffix", INDEXED)[1], "bo")


@query("suffix_search_long", f"WITH {corpus_sql(INDEXED)}, l AS (SELECT left(data, 60) AS x FROM corpus WHERE \"table\" = 'conversations.text' ORDER BY row_id LIMIT 1) SELECT \"table\", row_id, CAST(octet_length(encode(split_part(data, x, 1))) AS INTEGER) AS position FROM corpus, l WHERE contains(data, x)")
def _(spark, d):
    """The beginning of the first conversation, longer than the index keeps."""
    rows, suffixes = indexed(spark, d, "suffix", INDEXED)
    literal = rows.where(F.col("table") == TEXTS[1][0]).orderBy("row_id").select(F.left("data", F.lit(60))).first()[0]
    return index.suffix_search(suffixes, literal, rows)


@query("suffix_search_wildcard", f"WITH {_SUFFIXES} SELECT \"table\", row_id, position FROM suffixes WHERE regexp_matches(suffix, '^{_hex('b')}..{_hex('l')}')")
def _(spark, d):
    return index.suffix_search_wildcard(indexed(spark, d, "suffix", INDEXED)[1], "b_l")


@query("suffix_like", f"WITH {corpus_sql(INDEXED)} SELECT \"table\", row_id FROM corpus WHERE data LIKE '%e%ol_%'")
def _(spark, d):
    return index.suffix_like(*indexed(spark, d, "suffix", INDEXED), "%e%ol_%", "char").select("table", "row_id")


@query("selectivity_guard", f"WITH {_SUFFIXES}, l AS (SELECT * FROM {_LIT}) SELECT literal, count(suffix) AS n, count(suffix) > greatest({index.BROAD}, floor((SELECT count(*) FROM suffixes) * {index.BROAD_SHARE})) AS broad FROM l LEFT JOIN suffixes ON starts_with(suffix, hex(encode(literal))) GROUP BY literal")
def _(spark, d):
    return index.selectivity(indexed(spark, d, "suffix", INDEXED)[1], [x for (x,) in _LITERALS])


@query("rowset_intersect", f"WITH {corpus_sql(INDEXED)} SELECT \"table\", row_id FROM corpus WHERE contains(data, 'e') AND contains(data, 'bo')")
def _(spark, d):
    suffixes = indexed(spark, d, "suffix", INDEXED)[1]
    return index.intersect([index.suffix_search(suffixes, "e"), index.suffix_search(suffixes, "bo")])


@query("execute_batch", f'WITH {corpus_sql()}, p AS ({patterns_sql()}) SELECT CAST(pattern_index AS INTEGER) AS pattern_index, "table", row_id FROM corpus CROSS JOIN p WHERE data LIKE pattern')
def _(spark, d):
    return engine.execute_all(corpus(spark, d), PATTERNS, "char")


_HITS = f'{corpus_sql()}, p AS ({patterns_sql()}), hits AS (SELECT CAST(pattern_index AS INTEGER) AS pattern_index, pattern, "table", CAST(sum(CASE WHEN data LIKE pattern THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM corpus CROSS JOIN p GROUP BY ALL)'


def corpus_tables(spark: SparkSession, d: str):
    rows = {t: load(spark, d, t) for _, t, _, _ in COLUMNS}
    return [(name, rows[t], c) for name, t, _, c in COLUMNS]


@query("hits_by_pattern_table", f"WITH {_HITS} SELECT * FROM hits")
def hits(spark, d):
    return engine.hits_by_pattern_table(corpus_tables(spark, d), PATTERNS, "char")


@query("table_stats", f'WITH {corpus_sql()} SELECT "table", count(*) AS rows, CAST(sum(octet_length(encode(data))) AS DOUBLE) / count(*) AS avg_len, CAST(max(octet_length(encode(data))) AS BIGINT) AS max_len FROM corpus GROUP BY "table"')
def _(spark, d):
    return engine.table_stats(corpus(spark, d))


_BYTE = {9: "(..)*..50524F4D..(..)*", 10: "..2D(..)*", 11: "(..)*65..74(..)*", 12: "(..)*7265..64(..)*6F6E(..)*"}


@query("correctness_diff", f"""WITH {_HITS}, own AS (SELECT CAST(pattern_index AS INTEGER) AS pattern_index, "table", CAST(sum(CASE pattern_index {' '.join(f"WHEN {i} THEN CAST(regexp_full_match(hex(encode(data)), '{e}') AS INTEGER)" for i, e in _BYTE.items())} ELSE CASE WHEN data LIKE pattern THEN 1 ELSE 0 END END) AS BIGINT) AS actual FROM corpus CROSS JOIN p GROUP BY ALL)
SELECT pattern_index, "table", hits AS expected, actual FROM hits JOIN own USING (pattern_index, "table") WHERE hits <> actual""")
def _(spark, d):
    """Counts where _ is a byte against those where it is a character."""
    tables = corpus_tables(spark, d)
    return engine.correctness_diff(engine.hits_by_pattern_table(tables, PATTERNS, "byte"), engine.hits_by_pattern_table(tables, PATTERNS, "char"))


_SWEEP = ["bolt", "blue g", "BUILDING", "x"]


@query("literal_sweep", f"""WITH {corpus_sql(SMALL)}, l AS (SELECT literal FROM {values([(x,) for x in _SWEEP], 'literal')}), a AS (SELECT a FROM {values([(x,) for x in ('std', 'naive-scalar', 'naive-vector', 'naive-vector-v2', 'naive-mixed', 'kmp', 'bm', 'two-way', 'lut-short', 'kmer')], 'a')})
SELECT a AS algorithm, literal AS pattern, "table", CAST(sum(len(string_split(data, literal)) - 1) AS BIGINT) AS hits FROM corpus, l, a GROUP BY ALL""")
def _(spark, d):
    return engine.literal_sweep(corpus(spark, d, SMALL), _SWEEP)


@query("limit_rows_per_table", f'WITH {corpus_sql(SMALL)} SELECT "table", row_id, data FROM corpus QUALIFY row_number() OVER (PARTITION BY "table" ORDER BY row_id) <= 100')
def _(spark, d):
    return files.limit_rows(corpus(spark, d, SMALL), 100)


_BUDGET = 60_000
_RUNNING = "sum(octet_length(encode(data))) OVER (PARTITION BY \"table\" ORDER BY row_id)"


def _budget_sql() -> str:
    """Tables one after the other by name, each taking of what those before left."""
    names = sorted(c[0] for c in SMALL)
    parts, left = [], str(_BUDGET)
    for k, name in enumerate(names):
        parts.append(f"t{k} AS (SELECT \"table\", row_id, data, n FROM s WHERE \"table\" = '{name}' AND upto <= {left}), l{k} AS (SELECT {left} - coalesce(sum(n), 0) AS x FROM t{k})")
        left = f"(SELECT x FROM l{k})"
    return f"WITH {corpus_sql(SMALL)}, s AS (SELECT *, octet_length(encode(data)) AS n, {_RUNNING} AS upto FROM corpus), {', '.join(parts)} " + " UNION ALL ".join(f'SELECT "table", row_id, data FROM t{k}' for k in range(len(names)))


@query("limit_byte_budget", _budget_sql())
def _(spark, d):
    """One budget for all tables."""
    return files.limit_bytes(corpus(spark, d, SMALL), _BUDGET)


_NAMES = [("a.FASTA",), ("b.fa",), ("c.fna.txt",), ("d.faa",), ("e",), ("f.Fsa",), ("g.tbl",)]


@query("infer_file_type", f"SELECT name, CASE WHEN regexp_matches(lower(name), '[.](fasta|fa|fna|faa|fsa)$') THEN 'fasta' ELSE 'text' END AS kind FROM {values(_NAMES, 'name')}")
def _(spark, d):
    return spark.createDataFrame(_NAMES, "name string").select("name", files.infer_kind(F.col("name")).alias("kind"))


def written(spark: SparkSession, rows: DataFrame, form: str, **options) -> str:
    """rows as files of a form in the shared folder."""
    path = files.scratch(spark)
    rows.write.format(form).options(**options).save(path)
    return path


#: Lines of a file that is read back as one row.
AT_MOST = 5_000


@query("src_text", "SELECT sum(length(text)) AS chars, count(*) AS rows FROM documents")
def _(spark, d):
    """Every document is written as a line of a file, and the files, of AT_MOST lines each, read back whole. A line is what ends with a newline, be it empty."""
    path = written(spark, load(spark, d, "documents").select(F.regexp_replace("text", "\n", " ").alias("value")), "text", maxRecordsPerFile=AT_MOST)
    ends = F.length("data") - F.length(F.replace("data", F.lit("\n"), F.lit("")))
    read = files.read_text(spark, path).select(F.length("data").alias("n"), ends.alias("ends"))
    return read.agg(F.sum(F.col("n") - F.col("ends")).alias("chars"), F.coalesce(F.sum("ends"), F.lit(0)).cast("long").alias("rows"))


def _fasta(spark: SparkSession, d: str) -> str:
    rows = load(spark, d, "part").select(F.concat(F.lit(">"), F.col("p_partkey").cast("string"), F.lit(" "), "p_brand", F.lit("\n"), F.left("p_name", F.lit(4)), F.lit("\n\n"), F.substring("p_name", 5, 100), F.lit("\r")).alias("value"))
    return written(spark, rows, "text")


_PARTS = "SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS \"desc\", p_name AS data FROM part"


@query("src_fasta", _PARTS)
def _(spark, d):
    return files.read_fasta(spark, _fasta(spark, d)).select("id", "desc", "data")


@query("fasta_totals", f"SELECT count(*) AS entries, CAST(sum(octet_length(encode(data))) AS BIGINT) AS bytes, CAST(sum(octet_length(encode(id || \"desc\" || data)) + 7) AS BIGINT) AS raw_bytes FROM ({_PARTS})")
def _(spark, d):
    """Totals of all files; in each record, six bytes are of its header and its ends of lines."""
    return files.fasta_totals(spark, _fasta(spark, d)).agg(F.sum("entries").alias("entries"), F.sum("bytes").alias("bytes"), F.sum("raw_bytes").alias("raw_bytes"))


@query("fasta_subset", f"SELECT id FROM (SELECT id, sum(octet_length(encode(data))) OVER (ORDER BY CAST(id AS BIGINT)) AS b, octet_length(encode(data)) AS n FROM ({_PARTS})) WHERE b <= 900 OR b = n")
def _(spark, d):
    records = files.read_fasta(spark, _fasta(spark, d))
    return files.subset_bytes(records.select(F.lit("part").alias("table"), F.col("id").cast("long").alias("row_id"), "id", "data"), 900).select("id")


_CELLS = " UNION ALL ".join(f"SELECT '{c}' AS name, trim(coalesce({x}, ''), ' ' || chr(9) || chr(10) || chr(13)) AS data FROM {t}" for c, x, t in (("p_name", "p_name", "part"), ("p_type", "p_type || chr(10) || p_brand", "part")))


@query("src_delimited", f"SELECT name, data, count(*) AS n FROM ({_CELLS}) GROUP BY ALL")
def _(spark, d):
    """Fields with newlines in them."""
    kinds = F.concat("p_type", F.lit("\n"), "p_brand").alias("p_type")
    path = written(spark, load(spark, d, "part").select("p_partkey", "p_name", "p_brand", kinds), "csv", header=True, sep="|", escape='"')
    rows = files.read_delimited(spark, path, [("p_name", 1), ("p_type", 3)], "|")
    return rows.groupBy(F.element_at(F.split("table", "[.]"), -1).alias("name"), "data").agg(F.count("*").alias("n"))


@query("src_delimited_cols", "SELECT 'col0' AS name, o_orderpriority AS data, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'col2', o_orderstatus, count(*) FROM orders GROUP BY ALL")
def _(spark, d):
    path = written(spark, load(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_orderstatus"), "csv", sep="|")
    rows = files.read_delimited_selected(spark, path, "|", False, exclude=["*:1"])
    return rows.groupBy(F.element_at(F.split("table", "[.]"), -1).alias("name"), "data").agg(F.count("*").alias("n"))


@query("src_dataset", "SELECT 'fasta' AS kind, count(*) AS n FROM part UNION ALL SELECT 'text', 1")
def _(spark, d):
    """One text file of part names, and their FASTA records."""
    text = written(spark, load(spark, d, "part").select("p_name").coalesce(1), "text")
    both = files.read_dataset(spark, [text]).select(F.lit("text").alias("kind")).unionByName(files.read_fasta(spark, _fasta(spark, d)).select(F.lit("fasta").alias("kind")))
    return both.groupBy("kind").agg(F.count("*").alias("n"))


_FILE = ["# patterns", "%STEEL%\tsteel", "", "  %a_%b%  ", "GATTACA%\t dna \tmore"]


@query("pattern_file", f"SELECT CAST(i AS INTEGER) AS pattern_index, p AS pattern, t AS description FROM {values([(0, '%STEEL%', 'steel'), (1, '%a_%b%', 'Pattern 2'), (2, 'GATTACA%', 'dna ' + chr(9) + 'more')], 'i', 'p', 't')}")
def _(spark, d):
    path = written(spark, spark.createDataFrame([(x,) for x in _FILE], "value string").coalesce(1), "text")
    return files.read_patterns(spark, path)


@query("csv_redelimit", "SELECT CAST(c_custkey AS VARCHAR) AS a, c_name AS b, c_mktsegment AS c FROM customer")
def _(spark, d):
    source = written(spark, load(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "csv", escape='"')
    files.redelimit(spark, source, target := files.scratch(spark))
    return spark.read.csv(target, schema="a string, b string, c string", sep="|", escape='"')
