"""Queries of the analytics and pattern generation, with their SQL. Computed numbers are rounded to six places, so that the order of sums doesn't show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsieve.operators import analytics as A
from glyphsieve.operators import patterngen as G
from glyphsieve.plans.tables import load, results, results_sql, values

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ALGORITHMS = ["bm", "fm", "kmp", "std", "trigram"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.round(c, 6).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in rows.dtypes])


def over_results(name: str, sql: str, f) -> None:
    query(name, f"WITH {results_sql()}, r AS (SELECT * FROM results WHERE NOT skipped) {sql}")(lambda spark, d: rounded(f(results(spark, d))))


_MEAN = "CAST(sum(duration) AS DOUBLE) / count(*)"
_TOTAL = "CAST(sum(duration) AS DOUBLE)"
_P95 = "CAST(quantile_disc(duration, 0.95) AS DOUBLE)"
_RANK = "CAST(row_number() OVER (PARTITION BY {} ORDER BY {}, algorithm) AS INTEGER)"

over_results("rank_overall", f"SELECT *, CAST(row_number() OVER (ORDER BY total, algorithm) AS INTEGER) AS rank FROM (SELECT algorithm, round({_TOTAL}, 6) AS total FROM r GROUP BY algorithm)", lambda r: A.rank_by(r))
over_results("rank_per_pattern", f"SELECT pattern, algorithm, round(total, 6) AS total, {_RANK.format('pattern', 'total')} AS rank FROM (SELECT pattern, algorithm, {_TOTAL} AS total FROM r GROUP BY ALL)", lambda r: A.rank_by(r, "pattern"))
over_results("rank_per_table", f"SELECT \"table\", algorithm, round(total, 6) AS total, {_RANK.format('\"table\"', 'total')} AS rank FROM (SELECT \"table\", algorithm, {_TOTAL} AS total FROM r GROUP BY ALL)", lambda r: A.rank_by(r, "table"))
over_results("summary_by_algorithm", f"SELECT algorithm, count(*) AS n, round({_MEAN}, 6) AS mean, round({_P95}, 6) AS p95, round({_TOTAL}, 6) AS total FROM r GROUP BY algorithm", lambda r: A.summary(r, "algorithm"))
over_results("relative_to_best", f"SELECT algorithm, round(mean, 6) AS mean, round((mean / min(mean) OVER () - 1) * 100, 6) AS percent FROM (SELECT algorithm, {_MEAN} AS mean FROM r GROUP BY algorithm)", A.relative_to_best)
over_results("rank_by_dataset", f"SELECT dataset, algorithm, n, round(mean, 6) AS mean, {_RANK.format('dataset', 'mean')} AS rank FROM (SELECT dataset, algorithm, count(*) AS n, {_MEAN} AS mean FROM r GROUP BY ALL)", lambda r: A.rank_means(r, "dataset"))
_LESS = "(length(pattern) - length(replace(pattern, '{}', '')))"
_KIND = f"CASE WHEN NOT regexp_matches(pattern, '[%_]') THEN 'exact' WHEN starts_with(pattern, '%') AND ends_with(pattern, '%') AND {_LESS.format('%')} = 2 AND NOT contains(pattern, '_') THEN 'contains' ELSE 'wildcard' END"
over_results("rank_by_kind", f"SELECT kind, algorithm, n, round(mean, 6) AS mean, {_RANK.format('kind', 'mean')} AS rank FROM (SELECT {_KIND} AS kind, algorithm, count(*) AS n, {_MEAN} AS mean FROM r GROUP BY ALL)", lambda r: A.rank_means(A.with_kind(r), "kind"))
_SCORE = f"CAST(3 * {_LESS.format('%')} + 2 * {_LESS.format('_')} + length(pattern) AS INTEGER)"
_AT = "(SELECT {0} FROM m ORDER BY {0} LIMIT 1 OFFSET {1})"
_ENDS = ", ".join(f"{_AT.format(c, f'(SELECT {k} * (count(*) - 1) // 3 FROM m)')} AS {n}{k}" for c, n in (("pattern_length", "l"), ("raw", "c"), ("table_avg_len", "d")) for k in (1, 2))
_BUCKET = lambda c, n: f"CASE WHEN {c} <= {n}1 THEN 'low' WHEN {c} <= {n}2 THEN 'medium' ELSE 'high' END"
_ENRICHED = f""", m AS (SELECT *, CAST(length(pattern) AS INTEGER) AS pattern_length, CAST({_SCORE} AS DOUBLE) AS raw FROM r), ends AS (SELECT {_ENDS}, min(raw) AS a, max(raw) AS b FROM m),
b AS (SELECT m.*, (raw - a) / (b - a) AS norm, {_BUCKET('pattern_length', 'l')} AS pattern_len_bucket, {_BUCKET('table_avg_len', 'd')} AS data_len_bucket, {_BUCKET('raw', 'c')} AS complexity_bucket FROM m, ends)"""
_SAID = ("dataset", "algorithm", "pattern_index", "table", "run", "pattern_length", "pattern_complexity_raw", "pattern_complexity_norm", "pattern_len_bucket", "data_len_bucket", "complexity_bucket")
over_results("tercile_buckets", f"{_ENRICHED} SELECT dataset, algorithm, pattern_index, \"table\", run, pattern_length, raw AS pattern_complexity_raw, round(norm, 6) AS pattern_complexity_norm, pattern_len_bucket, data_len_bucket, complexity_bucket FROM b", lambda r: A.enriched(r).select(*_SAID))
_DATA = ", b AS (SELECT *, " + _KIND + " AS kind, CASE WHEN table_avg_len <= (SELECT table_avg_len FROM r ORDER BY 1 LIMIT 1 OFFSET (SELECT count(*) // 3 FROM r)) THEN 'short' WHEN table_avg_len <= (SELECT table_avg_len FROM r ORDER BY 1 LIMIT 1 OFFSET (SELECT 2 * count(*) // 3 FROM r)) THEN 'mid' ELSE 'long' END AS data_bucket FROM r)"
over_results("length_buckets", f"{_DATA} SELECT \"table\", table_avg_len, data_bucket, count(*) AS n FROM b GROUP BY ALL", lambda r: A.with_data_bucket(r).groupBy("table", "table_avg_len", "data_bucket").agg(F.count("*").alias("n")))
over_results("summary_by_buckets", f"{_ENRICHED} SELECT algorithm, pattern_len_bucket, complexity_bucket, data_len_bucket, count(*) AS n, round({_MEAN}, 6) AS mean FROM b GROUP BY ALL", A.summary_by_buckets)
_WINNERS = ", w AS (SELECT dataset, \"table\", pattern_index, run, arg_min(algorithm, (duration, algorithm)) AS algorithm FROM r GROUP BY ALL)"
over_results("win_rate", f"{_WINNERS} SELECT algorithm, count(*) AS wins, round(count(*) / sum(count(*)) OVER (), 6) AS rate FROM w GROUP BY algorithm", lambda r: A.win_rate(r))
over_results("win_rate_by_dataset", f"{_WINNERS} SELECT dataset, algorithm, count(*) AS wins, round(count(*) / sum(count(*)) OVER (PARTITION BY dataset), 6) AS rate FROM w GROUP BY dataset, algorithm", lambda r: A.win_rate(r, "dataset"))
_TWO = "max(CASE WHEN rank = {} THEN {} END)"
over_results("recommendation_matrix", f"""{_DATA}, q AS (SELECT *, row_number() OVER (PARTITION BY dataset, data_bucket, kind ORDER BY mean, algorithm) AS rank FROM (SELECT dataset, data_bucket, kind, algorithm, {_MEAN} AS mean, count(*) AS n FROM b GROUP BY ALL)),
t AS (SELECT dataset, data_bucket, kind, {_TWO.format(1, 'algorithm')} AS best, {_TWO.format(1, 'mean')} AS best_mean, coalesce({_TWO.format(2, 'algorithm')}, '') AS second, coalesce({_TWO.format(2, 'mean')}, {_TWO.format(1, 'mean')}) AS second_mean, {_TWO.format(1, 'n')} AS samples FROM q GROUP BY ALL)
SELECT dataset, data_bucket, kind, best, round(best_mean, 6) AS best_mean, second, round(second_mean, 6) AS second_mean, round(CASE WHEN best_mean = 0 THEN 0 ELSE (second_mean / best_mean - 1) * 100 END, 6) AS gap, samples FROM t""", A.recommendation_matrix)
over_results("best_by_cell", f"""{_ENRICHED}, q AS (SELECT pattern_len_bucket, complexity_bucket, algorithm, count(*) AS n, {_MEAN} AS mean FROM b GROUP BY ALL),
c AS (SELECT pattern_len_bucket, complexity_bucket, CAST(sum(n) AS BIGINT) AS samples, arg_min(algorithm, (mean, algorithm)) AS algorithm, min(mean) AS mean, arg_min(n, (mean, algorithm)) AS n FROM q GROUP BY ALL),
g AS (SELECT x AS pattern_len_bucket, y AS complexity_bucket FROM (SELECT unnest(['low', 'medium', 'high']) AS x), (SELECT unnest(['low', 'medium', 'high']) AS y))
SELECT pattern_len_bucket, complexity_bucket, coalesce(samples, 0) AS samples, coalesce(algorithm, '-') AS algorithm, round(mean, 6) AS mean, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (pattern_len_bucket, complexity_bucket)""", A.best_by_cell)
_LITERAL = f""", l AS (SELECT *, CAST(coalesce(TRY_CAST(nullif(regexp_extract(pattern_desc, 'len=([0-9]+)', 1), '') AS INTEGER), length(pattern) - {_LESS.format('%')} - {_LESS.format('_')}) AS INTEGER) AS literal_len,
CAST({_LESS.format('%')} AS INTEGER) AS percents, CAST({_LESS.format('_')} AS INTEGER) AS underscores, CASE WHEN contains(pattern_desc, 'nomatch') THEN 'nomatch' ELSE 'exists' END AS mode FROM r)"""
_CORE = "algorithm IN (" + ", ".join(f"'{a}'" for a in A.CORE) + ")"
_MEDIAN = "median(CAST(duration AS DOUBLE))"
_STATS = f"count(*) AS n, round({_MEDIAN}, 6) AS median, round({_MEAN}, 6) AS mean, round({_P95}, 6) AS p95"
over_results("curve_by_length", f"{_LITERAL} SELECT algorithm, literal_len, {_STATS} FROM l GROUP BY ALL", lambda r: A.curve_by_length(r))
over_results("curve_by_length_mode", f"{_LITERAL} SELECT mode, algorithm, literal_len, {_STATS} FROM l GROUP BY ALL", lambda r: A.curve_by_length(r, "mode"))
for _name, _where, _core in (("", "true", False), ("_core", _CORE, True)):
    over_results(f"algorithm_ratings{_name}", f"""{_LITERAL}, k AS (SELECT * FROM l WHERE {_where}), s AS (SELECT algorithm, literal_len, {_MEDIAN} AS m FROM k GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY literal_len ORDER BY m, algorithm) AS rank, min(m) OVER (PARTITION BY literal_len) AS best FROM s),
a AS (SELECT algorithm, CAST(sum(rank) AS DOUBLE) / count(*) AS mean_rank, exp(avg(ln(greatest(CASE WHEN best > 0 THEN m / best ELSE 1 END, 1e-12)))) AS slowdown, CAST(sum(CASE WHEN rank = 1 THEN 1 ELSE 0 END) AS BIGINT) AS wins FROM t GROUP BY algorithm),
o AS (SELECT algorithm, {_STATS} FROM k GROUP BY algorithm)
SELECT algorithm, CASE WHEN mean_rank <= 2.5 AND slowdown <= 1.08 THEN 'S' WHEN mean_rank <= 4.5 AND slowdown <= 1.2 THEN 'A' WHEN mean_rank <= 7 AND slowdown <= 1.6 THEN 'B' WHEN mean_rank <= 10 AND slowdown <= 3 THEN 'C' ELSE 'D' END AS tier,
median, mean, p95, round(mean_rank, 6) AS mean_rank, wins, round(slowdown, 6) AS slowdown FROM a JOIN o USING (algorithm)""", lambda r, core=_core: A.algorithm_ratings(r, core))
    _RANGED = f"{_LITERAL}, k AS (SELECT algorithm, len_range, duration FROM l JOIN {values(list(A.RANGES), 'len_range', 'low', 'high')} ON literal_len BETWEEN low AND high WHERE {_where})"
    over_results(f"range_winners{_name}", f"""{_RANGED}, q AS (SELECT *, row_number() OVER (PARTITION BY len_range ORDER BY median, algorithm) AS rank FROM (SELECT len_range, algorithm, {_MEDIAN} AS median FROM k GROUP BY ALL)),
t AS (SELECT len_range, {_TWO.format(1, 'algorithm')} AS winner, {_TWO.format(1, 'median')} AS a, coalesce({_TWO.format(2, 'algorithm')}, {_TWO.format(1, 'algorithm')}) AS second, coalesce({_TWO.format(2, 'median')}, {_TWO.format(1, 'median')}) AS b FROM q GROUP BY len_range)
SELECT len_range, winner, round(a, 6) AS winner_median, second, round(b, 6) AS second_median, round(CASE WHEN a = 0 THEN 0 ELSE (b / a - 1) * 100 END, 6) AS gap FROM t""", lambda r, core=_core: A.range_winners(r, core))
over_results("range_stats", f"{_LITERAL}, k AS (SELECT algorithm, len_range, duration FROM l JOIN {values(list(A.RANGES), 'len_range', 'low', 'high')} ON literal_len BETWEEN low AND high) SELECT algorithm, len_range, {_STATS} FROM k GROUP BY ALL", lambda r: A.range_stats(r))
over_results("pattern_outliers", f"""{_LITERAL}, o AS (SELECT algorithm, pattern_index, any_value(pattern_desc) AS pattern_desc, any_value(pattern) AS pattern, any_value(mode) AS mode, any_value(literal_len) AS literal_len, any_value(percents) AS percents, any_value(underscores) AS underscores, {_MEDIAN} AS median FROM l GROUP BY algorithm, pattern_index),
u AS (SELECT algorithm, literal_len, median(median) AS usual FROM o GROUP BY ALL)
SELECT algorithm, pattern_index, pattern_desc, pattern, mode, literal_len, percents, underscores, round(median, 6) AS median, round(usual, 6) AS usual, round(median / usual, 6) AS ratio FROM o JOIN u USING (algorithm, literal_len) WHERE usual > 0 AND (median / usual >= 1.8 OR median / usual <= 0.55)""", A.pattern_outliers)
over_results("length_correlation", f"""{_LITERAL}, o AS (SELECT algorithm, literal_len, {_MEDIAN} AS m FROM l GROUP BY ALL), p AS (SELECT algorithm, CAST(literal_len AS DOUBLE) AS x, log10(m) AS y FROM o WHERE m > 0)
SELECT algorithm, count(*) AS points, round(coalesce(CASE WHEN count(*) < 2 OR var_pop(x) = 0 OR var_pop(y) = 0 THEN 0 ELSE corr(x, y) END, 0), 6) AS r FROM p GROUP BY algorithm""", A.length_correlation)
_CELLS = ", ".join(f"round(coalesce(ln(1 + min(CASE WHEN algorithm = '{a}' THEN CAST(duration AS DOUBLE) END)), 0), 6) AS {a}" for a in ALGORITHMS)
over_results("scenario_features", f"""SELECT dataset, "table", pattern_index, run, pattern, {_KIND} AS kind, {_CELLS}, CAST(length(pattern) AS DOUBLE) AS pattern_len, CAST({_LESS.format('%')} AS DOUBLE) AS percents, CAST({_LESS.format('_')} AS DOUBLE) AS underscores,
CAST({_SCORE} AS DOUBLE) AS complexity, max(table_avg_len) AS table_avg_len, CAST(max(table_max_len) AS DOUBLE) AS table_max_len, CAST(max(table_rows) AS DOUBLE) AS table_rows,
CASE WHEN {_KIND} = 'exact' THEN 1.0::DOUBLE ELSE 0 END AS is_exact, CASE WHEN {_KIND} = 'contains' THEN 1.0::DOUBLE ELSE 0 END AS is_contains FROM r GROUP BY dataset, "table", pattern_index, run, pattern""", lambda r: A.scenario_features(r, ALGORITHMS))


@query("scenario_clusters")
def _(spark, d):
    """Clusters of embeddings; k-means is no SQL."""
    return A.scenario_clusters(A.scenario_features(results(spark, d), ALGORITHMS), ALGORITHMS).select(*A.SCENARIO, "cluster_profile", "cluster_hybrid")


@query("scenario_embedding")
def _(spark, d):
    from pyspark.ml.functions import vector_to_array

    rows = A.dataset_clusters(A.scenario_features(results(spark, d), ALGORITHMS), ALGORITHMS)
    at = lambda c, *names: [F.get(vector_to_array(c), F.lit(k)).alias(n) for k, n in enumerate(names)]
    return rows.select(*A.SCENARIO, *at("embedding2", "x2", "y2"), *at("embedding3", "x3", "y3", "z3"), "dataset_cluster")


@query("cluster_summary")
def _(spark, d):
    rows = results(spark, d)
    return A.cluster_summary(A.dataset_clusters(A.scenario_features(rows, ALGORITHMS), ALGORITHMS), rows)


_COLUMNS13 = "dataset, algorithm, pattern_index, pattern, pattern_desc, \"table\", file_type, CAST(floor(duration) AS BIGINT) AS duration_micros, found_count, skipped, table_rows, {} AS table_avg_len, table_max_len"


@query("results_schema", f"WITH {results_sql()} SELECT {_COLUMNS13.format('round(table_avg_len, 4)')} FROM results")
def _(spark, d):
    """The results written as CSV of thirteen columns and read back."""
    from glyphsieve.sources import files

    rows = results(spark, d).withColumn("duration_micros", F.floor("duration").cast("long"))
    files.write_results(rows, path := files.scratch(spark))
    # null would be an empty description
    return spark.read.csv(path, header=True, escape='"', schema=rows.select(*files.RESULTS).schema).fillna({"pattern_desc": ""})


_TOKENS = "SELECT {0}, unnest(list_filter(regexp_split_to_array({1}, '[^A-Za-z0-9]+'), lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+'))) AS token FROM {2}"


@query("tokenize", f"SELECT token, count(*) AS n FROM ({_TOKENS.format('doc_id', 'text', 'documents')}) GROUP BY token")
def _(spark, d):
    return G.tokenize(load(spark, d, "documents"), "text")


_HASH = f"md5('{G.SEED}:' || {{}})"
_SAMPLED = """SELECT p, list_filter(regexp_split_to_array(f[CAST('0x' || left({}, 7) AS INTEGER) % 3 + 1], '[^A-Za-z0-9]+'), lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+')) AS w
  FROM (SELECT p_partkey AS p, [p_name, p_brand, p_type] AS f FROM part ORDER BY p LIMIT 20000)""".format(_HASH.format("CAST(p AS VARCHAR)"))


@query("sample_tokens", f"""WITH s AS ({_SAMPLED}), k AS (SELECT *, coalesce(sum(len(w)) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT p AS position, CAST(i - 1 AS INTEGER) AS i, token FROM (SELECT p, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM k WHERE before < 10000)""")
def _(spark, d):
    return G.sample_tokens(load(spark, d, "part"), F.col("p_partkey"), ["p_name", "p_brand", "p_type"])


@query("distinct_tokens", f"""WITH t AS (SELECT p_partkey, regexp_split_to_array(p_name, '[^A-Za-z0-9]+') AS w FROM part), u AS (SELECT p_partkey, list_filter(w, lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+')) AS w FROM t), v AS (SELECT p_partkey, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM u)
SELECT arg_min(token, (p_partkey, i)) AS token, min(p_partkey) AS position FROM v GROUP BY lower(token)""")
def _(spark, d):
    return G.distinct_tokens(load(spark, d, "part"), "p_name", F.col("p_partkey"))


_FIRSTS = "tokens AS (SELECT arg_min(token, (p, i)) AS token FROM (SELECT p, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM (SELECT {0} AS p, list_filter(regexp_split_to_array({1}, '[^A-Za-z0-9]+'), lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+')) AS w FROM {2})) GROUP BY lower(token))"
_CONV = _FIRSTS.format("conv_id * 1000 + turn", "text", "conversations")
_RANKED = "ranked AS (SELECT token, row_number() OVER (ORDER BY " + _HASH.format("token") + " || token) AS rn, count(*) OVER () AS n FROM tokens)"
_CUT = lambda a, b: f"substr(token, {a} + 1, {b} - ({a}))"
_MID, _Q1, _Q3, _END = "length(token) // 2", "length(token) // 4", "3 * length(token) // 4", "length(token)"
_TEMPLATES = [
    ("token", "exact", 0), ("'%' || token || '%'", "contains", 0), ("token || '%'", "prefix", 0), ("'%' || token", "suffix", 0),
    (f"'%' || {_CUT('0', _MID)} || '_' || {_CUT(_MID + ' + 1', _END)} || '%'", "underscore", 5), (f"{_CUT('0', _MID)} || '%' || {_CUT(_MID, _END)}", "split-mid", 5),
    (f"'%' || {_CUT('0', _Q1)} || '%' || {_CUT(_Q3, _END)} || '%'", "two-literal-short", 8), (f"{_CUT('0', _Q1)} || '_' || {_CUT(_Q1 + ' + 1', _Q3)} || '_' || {_CUT(_Q3 + ' + 1', _END)}", "double-underscore", 8),
    ("'%' || left(token, 2) || '_' || right(token, 2) || '%'", "short-gap", 4),
]
_PAIRS = [("'%' || x || '%' || y || '%'", "two-literals"), ("left(x, 3) || '%' || right(y, 3)", "bridge"), ("'%' || left(x, 2) || '_' || right(y, 2) || '%'", "short-bridge")]
_SINGLE = [("'%' || left(token, 1) || '%'", "single-char-contains"), ("'_' || left(token, 1) || '_%'", "underscore-heavy")]
_PART0 = [f"SELECT 0 AS part, rn, {k} AS k, {p} AS pattern, '{name}:' || token AS description FROM ranked WHERE length(token) >= {least}" for k, (p, name, least) in enumerate(_TEMPLATES)]
_PART2 = [f"SELECT 2, rn, {k}, {p}, '{name}:' || token FROM ranked WHERE rn <= 20" for k, (p, name) in enumerate(_SINGLE)]
_PART1 = [f"SELECT 1 AS part, rn, {k} AS k, {p} AS pattern, '{name}:' || x || '+' || y AS description FROM pairs" for k, (p, name) in enumerate(_PAIRS)]
_BOTH = "pairs AS (SELECT a.rn, a.token AS x, b.token AS y FROM ranked a JOIN ranked b ON b.rn = a.n + 1 - a.rn WHERE a.rn <= a.n // 2{})"
_FIRST = "SELECT pattern, arg_min(description, (part, rn, k)) AS description, min((part, rn, k)) AS made FROM ({}) GROUP BY pattern"


def firsts(spark, d):
    rows = load(spark, d, "conversations").withColumn("k", F.expr("conv_id * 1000 + turn"))
    return G.distinct_tokens(rows, "text", F.col("k"))


@query("generate_patterns", f"WITH {_CONV}, {_RANKED} SELECT pattern, description FROM ({_FIRST.format(' UNION ALL '.join(_PART0 + _PART2))})")
def _(spark, d):
    return G.generate_patterns(firsts(spark, d))


@query("generate_pair_patterns", f"WITH {_CONV}, {_RANKED}, {_BOTH.format('')} SELECT pattern, description FROM ({_FIRST.format(' UNION ALL '.join(_PART1))})")
def _(spark, d):
    return G.generate_pair_patterns(firsts(spark, d))


@query("stratified_patterns", f"""WITH {_CONV}, base AS (SELECT token FROM tokens ORDER BY {_HASH.format('token')}, token LIMIT {G.MAX_PATTERNS}), ranked AS (SELECT token, row_number() OVER (ORDER BY {_HASH.format('token')}, token) AS rn, count(*) OVER () AS n FROM base),
{_BOTH.format(f' AND a.rn <= {G.MAX_PATTERNS // 6}')}, made AS ({_FIRST.format(' UNION ALL '.join(_PART0 + _PART1 + _PART2))}),
scored AS (SELECT *, {_SCORE} AS score FROM made), placed AS (SELECT *, row_number() OVER (ORDER BY score, made) AS p, count(*) OVER () AS n FROM scored),
tiered AS (SELECT *, CASE WHEN p <= greatest(1, n // 3) THEN 0 WHEN p <= greatest(greatest(1, n // 3) + 1, 2 * n // 3) THEN 1 ELSE 2 END AS tier FROM placed),
turns AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY {_HASH.format('pattern')}, pattern) AS turn FROM tiered)
SELECT pattern, description, score, CAST(tier AS INTEGER) AS tier FROM (SELECT * FROM turns ORDER BY CASE WHEN n <= {G.MAX_PATTERNS} THEN 0 ELSE turn END, tier LIMIT {G.MAX_PATTERNS})""")
def _(spark, d):
    return G.stratified(G.autogenerated(firsts(spark, d)))


_MANUAL = [("%bolt%", "by hand"), ("blue", "by hand"), ("%never%", "by hand")]


@query("merge_patterns", f"""WITH {_FIRSTS.format('p_partkey', 'p_name', 'part')}, {_RANKED}, g AS (SELECT pattern, description FROM ({_FIRST.format(' UNION ALL '.join(_PART0 + _PART2))})), m AS (SELECT 1 AS k, * FROM {values(_MANUAL, 'pattern', 'description')} UNION ALL SELECT 0, * FROM g)
SELECT pattern, arg_min(description, (k, description)) AS description FROM m GROUP BY pattern""")
def _(spark, d):
    made = G.generate_patterns(G.distinct_tokens(load(spark, d, "part"), "p_name", F.col("p_partkey")))
    return G.merge_patterns(made, spark.createDataFrame(_MANUAL, "pattern string, description string"))


def _fits(n: int) -> str:
    return f"[!-$&-^`-~][ -$&-^`-~]{{{n - 2}}}[!-$&-^`-~]" if n > 1 else "[!-$&-^`-~]"


_EXISTS = "e AS (" + " UNION ALL ".join(f"SELECT {n} AS n, arg_min(nullif(regexp_extract(text, '{_fits(n)}', 0), ''), conv_id * 1000 + turn) FILTER (length(text) >= {n} AND regexp_matches(text, '{_fits(n)}')) AS literal FROM conversations" for n in G.LENGTHS) + ")"


@query("len_sweep_exists", f"WITH {_EXISTS} SELECT CAST(n AS INTEGER) AS n, literal FROM e WHERE literal IS NOT NULL")
def _(spark, d):
    rows = load(spark, d, "conversations").withColumn("k", F.expr("conv_id * 1000 + turn"))
    return G.len_sweep_exists(rows, "k", "text")


_NOMATCH = f"""WITH {_EXISTS}, c AS (SELECT n, literal, k, 'QZXJ' || (k % 10) || 'KQ' AS t, n // 2 - 3 AS m FROM e, (SELECT unnest(range(0, {G.ATTEMPTS})) AS k) WHERE literal IS NOT NULL AND n IN {G.NOMATCH_LENGTHS}),
t AS (SELECT n, k, substr(literal, 1, m) || t || substr(literal, m + 8) AS x FROM c)
SELECT CAST(n AS INTEGER) AS n, arg_min(x, k) AS literal FROM t WHERE NOT EXISTS (SELECT 1 FROM conversations WHERE contains(text, x)) GROUP BY n"""


@query("len_sweep_nomatch", _NOMATCH)
def _(spark, d):
    rows = load(spark, d, "conversations").withColumn("k", F.expr("conv_id * 1000 + turn"))
    return G.len_sweep_nomatch(G.len_sweep_exists(rows, "k", "text"), rows, "text")


@query("len_sweep_patterns", f"SELECT '%' || literal || '%' AS pattern, 'text-len-exists|len=' || n AS description FROM (WITH {_EXISTS} SELECT * FROM e WHERE literal IS NOT NULL) UNION ALL SELECT '%' || literal || '%', 'text-len-nomatch|len=' || n FROM ({_NOMATCH})")
def _(spark, d):
    rows = load(spark, d, "conversations").withColumn("k", F.expr("conv_id * 1000 + turn"))
    exists = G.len_sweep_exists(rows, "k", "text")
    return G.len_sweep_patterns(exists, G.len_sweep_nomatch(exists, rows, "text"))
