"""URL filters by association rules: FP-growth mines which combinations of URL tokens go with bad labels, and an inverted index matches the rules.

A URL becomes the set of its tokens: scheme, host and its parent domains, words of the path, names and values of the query. Rules are combinations of tokens, of
whatever number, whose support, confidence and lift reach their thresholds, and which no smaller rule of at least the same confidence makes needless. Tokens that stand
in the same labelled URLs are mined as one. A rule is indexed under its rarest token only, so that a URL meets the rules that it may satisfy, not all.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsieve.llm._common import materialise, measured_side
from glyphsieve.sources.tables import read_table

BAD = "label:bad"
#: Least share of the labelled URLs that hold a rule's tokens and are bad, and least number of them.
MIN_SUPPORT = 0.0005
MIN_COUNT = 3
MIN_CONFIDENCE = 0.4
MIN_LIFT = 1.2
#: FP-growth lists every subset of tokens that often come together. Where a URL has more than so many tokens left to mine, the same sets are found level by level,
#: without those that say no more than a subset does.
LONG_URL = 16


def tokens(url: Column) -> Column:
    """The sorted distinct tokens of a URL, lower case; none of null or empty ones. Numbers count as one token, wherever they are."""
    rest = F.regexp_replace(F.lower(url), "^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    labels = F.split(F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), ":[0-9]*$", ""), "[.]")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, "^[^?#]*[?]([^#]*)", 1)
    mark = lambda prefix: lambda x: F.concat(F.lit(prefix), F.when(x.rlike("^[0-9]+$"), F.lit("0")).otherwise(x))
    words = lambda c, prefix: F.transform(F.filter(F.split(c, "[^\\p{L}\\p{N}]+"), lambda x: x != ""), mark(prefix))
    scheme = F.filter(F.array(F.concat(F.lit("scheme:"), F.nullif(F.regexp_extract(F.lower(url), "^([a-z][a-z0-9+.-]*)://", 1), F.lit("")))), lambda x: x.isNotNull())
    whole = F.concat(scheme, F.filter(domains, lambda x: x != "host:"), words(path, "path:"), words(query, "query:"))
    return F.when(url.isNull() | (url == ""), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(whole)))


def mine_rules(pages: DataFrame, labels: DataFrame, support: float = MIN_SUPPORT, count: int = MIN_COUNT, confidence: float = MIN_CONFIDENCE, lift: float = MIN_LIFT) -> DataFrame:
    """(terms, n_bad, n, confidence) of the rules, mined from all labelled URLs: pages(page_id, url), labels(doc_id, quality, toxic), where doc_id names a page.

    A URL is bad if it has a label of quality 0 or toxic 1; a page with several labels is bad if one of them says so. Null ids, URLs and labels take no part.
    """
    said = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad")
    )
    rows = pages.where("page_id IS NOT NULL AND url IS NOT NULL AND url <> ''").select(F.col("page_id").cast("long"), "url").distinct().join(said, "page_id")
    rows = materialise(rows.select("bad", tokens(F.col("url")).alias("terms")))
    total, bad = rows.agg(F.count("*"), F.sum("bad")).first()
    schema = "terms array<string>, n_bad long, n long, confidence double"
    if not bad:
        return pages.sparkSession.createDataFrame([], schema)
    least = max(count, int(-(-support * total // 1)))
    short, classes = merged(materialise(rows.withColumn("row", F.monotonically_increasing_id())), least)
    sets = counts_of(short, least)
    rules = sets.withColumn("confidence", F.col("n_bad") / F.col("n")).where((F.col("confidence") >= confidence) & (F.col("confidence") >= lift * bad / total))
    rules = materialise(rules)
    within = matched(rules.select("terms", F.struct("terms", "confidence").alias("row")), rules.select("terms"))
    better = within.join(rules.select(F.col("terms").alias("rule"), F.col("confidence").alias("has")), "rule").where("size(rule) < size(row.terms) AND has >= row.confidence")
    kept = rules.join(better.select("row.terms").distinct(), "terms", "left_anti")
    return expanded(materialise(kept), classes).select("terms", "n_bad", "n", "confidence")


def merged(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """rows(row, bad, terms) with only the terms that at least `least` bad rows hold, one (the first) for all that stand in the same rows; and (term, members) of these.

    Terms stand in the same rows if their numbers of rows and two sums of hashes of the rows agree.
    """
    each = rows.select("row", "bad", F.explode("terms").alias("term"))
    print_ = [F.sum(F.xxhash64("row", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
    terms = each.groupBy("term").agg(F.sum("bad").alias("n_bad"), F.count("*").alias("n"), *print_).where(F.col("n_bad") >= least)
    classes = materialise(terms.groupBy("n_bad", "n", "s1", "s2").agg(F.min("term").alias("term"), F.sort_array(F.collect_list("term")).alias("members")).select("term", "members"))
    few = each.join(measured_side(materialise(classes.select("term"))), "term", "left_semi").groupBy("row", "bad").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    return materialise(few), classes


def expanded(rules: DataFrame, classes: DataFrame) -> DataFrame:
    """rules(terms, ...) with each of their terms in turn replaced by every member of its class."""
    more = [c for c in rules.columns if c != "terms"]
    keyed = materialise(rules.select(F.monotonically_increasing_id().alias("id"), "*"))
    lists = keyed.select("id", F.explode("terms").alias("term")).join(classes, "term").groupBy("id").agg(F.collect_list("members").alias("lists"))
    start = F.array(F.array().cast("array<string>"))
    every = F.aggregate("lists", start, lambda made, members: F.flatten(F.transform(made, lambda m: F.transform(members, lambda x: F.concat(m, F.array(x))))))
    return keyed.join(lists, "id").select(F.explode(every).alias("terms"), *more).withColumn("terms", F.array_sort("terms"))


def counts_of(rows: DataFrame, least: int) -> DataFrame:
    """(terms, n_bad, n) of the sets of terms that at least `least` of the bad rows(row, bad, terms) hold, n counting all rows. Where a row has more than LONG_URL terms,
    sets that stand in just the rows of one of their subsets are left out: they make no rule that the subset doesn't make."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bad = rows.where("bad = 1").select("terms")
    n, longest = bad.agg(F.count("*"), F.max(F.size("terms"))).first()
    if not n:
        return rows.sparkSession.createDataFrame([], "terms array<string>, n_bad long, n long")
    if longest > LONG_URL:
        return levels(rows, least)
    model = FPGrowth(itemsCol="terms", minSupport=min(1.0, (least - 0.5) / n), minConfidence=1.0, numPartitions=partitions).fit(bad)
    sets = materialise(model.freqItemsets.select(F.array_sort("items").alias("terms"), F.col("freq").alias("n_bad")))
    whole = matched(rows.where("bad = 0").select("row", "terms"), sets).groupBy("rule").agg(F.count("*").alias("others"))
    return sets.join(whole.withColumnRenamed("rule", "terms"), "terms", "left").select("terms", "n_bad", (F.col("n_bad") + F.coalesce("others", F.lit(0))).alias("n"))


def levels(rows: DataFrame, least: int) -> DataFrame:
    """counts_of(), a number of terms at a time: sets grow by a later term of a row that holds them, as long as they are frequent and in fewer rows than each of their parts."""
    items = materialise(rows.select("row", "bad", F.explode("terms").alias("term")))
    grown, found, before = items.select("row", "bad", F.array("term").alias("terms")), None, None
    while True:
        now = materialise(grown.groupBy("terms").agg(F.sum("bad").alias("n_bad"), F.count("*").alias("n")).where(F.col("n_bad") >= least))
        if before is not None:
            k = F.sequence(F.lit(1), F.size("terms"))
            part = now.select("terms", "n", F.explode(F.transform(k, lambda i: F.filter("terms", lambda t, j: j != i - 1))).alias("part"))
            less = part.join(before.select(F.col("terms").alias("part"), F.col("n").alias("of")), "part", "left")
            dull = less.where("of IS NULL OR of = n").select("terms").distinct()  # a part that isn't there was left out itself
            now = materialise(now.join(dull, "terms", "left_anti"))
        if not now.limit(1).count():
            return found if found is not None else now
        found, before = now if found is None else materialise(found.unionByName(now)), now
        kept = grown.join(now.select("terms"), "terms", "left_semi")
        grown = kept.join(items.select("row", "term"), "row").where(F.col("term") > F.element_at("terms", -1))
        grown = materialise(grown.select("row", "bad", F.concat("terms", F.array("term")).alias("terms")))


def matched(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(row, rule) for each of rows(row, terms, sorted) and each set of terms that it holds: the inverted index of the sets, each under its rarest term."""
    frequency = sets.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("uses"))
    use = sets.select("terms", F.explode("terms").alias("term")).join(frequency, "term")
    first = use.groupBy("terms").agg(F.min(F.struct("uses", "term")).alias("f"))
    index = materialise(first.select("f.term", F.col("terms").alias("rule")))
    met = rows.select("row", "terms", F.explode("terms").alias("term")).join(measured_side(index), "term")
    return met.where(F.size(F.array_except("rule", "terms")) == 0).select("row", "rule")


def flagged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, url, terms, confidence, n_rules) of every row of pages(page_id, url) that a rule matches: the one of the highest confidence, then support, then
    first in order; and how many match. Repeated rows are flagged each; null or empty URLs never are; a null page_id stays null.
    """
    rows = pages.select("page_id", "url", tokens(F.col("url")).alias("terms"))
    rows = rows.select(F.struct("page_id", "url", F.monotonically_increasing_id().alias("k")).alias("row"), "terms")
    weights = rules.select(F.col("terms").alias("rule"), "confidence", "n_bad")
    hits = matched(rows, rules.select("terms")).join(measured_side(materialise(weights)), "rule")
    best = hits.groupBy("row").agg(F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("n_bad")).alias("n"), "rule")).alias("best"), F.count("*").alias("n_rules"))
    return best.select("row.page_id", "row.url", F.array_join("best.rule", " ").alias("terms"), (-F.col("best.c")).alias("confidence"), "n_rules")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages", "page_id", "url")
    rules = materialise(mine_rules(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return flagged(pages, rules)


def oracle(support: float = MIN_SUPPORT, count: int = MIN_COUNT, confidence: float = MIN_CONFIDENCE, lift: float = MIN_LIFT) -> str:
    """DuckDB SQL for query(): counts all combinations of the tokens that occur in enough bad URLs."""
    words = lambda c, prefix: f"list_transform(list_filter(regexp_split_to_array({c}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), lambda x: '{prefix}' || CASE WHEN regexp_full_match(x, '[0-9]+') THEN '0' ELSE x END)"
    return f"""
WITH RECURSIVE split AS (SELECT page_id, url, row_number() OVER () AS rid, regexp_extract(lower(url), '^([a-z][a-z0-9+.-]*)://', 1) AS scheme, regexp_replace(lower(url), '^[a-z][a-z0-9+.-]*://', '') AS rest FROM pages WHERE url <> ''),
hosts AS (SELECT *, string_split(regexp_replace(regexp_replace(regexp_extract(rest, '^([^/?#]*)', 1), '^[^@]*@', ''), ':[0-9]*$', ''), '.') AS h FROM split),
tokened AS (SELECT rid, page_id, url, list_distinct(list_concat(CASE WHEN scheme = '' THEN [] ELSE ['scheme:' || scheme] END,
  list_filter(list_transform(range(1, len(h) + 1), lambda i: 'host:' || array_to_string(h[i:], '.')), lambda x: x <> 'host:'),
  {words("regexp_extract(rest, '^[^/?#]*([^?#]*)', 1)", "path:")}, {words("regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1)", "query:")})) AS t FROM hosts),
said AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
labelled AS (SELECT row_number() OVER () AS id, bad, t FROM (SELECT DISTINCT page_id, url, t FROM tokened) JOIN said USING (page_id)),
totals AS (SELECT count(*) AS n, sum(bad) AS b FROM labelled),
every AS (SELECT id, bad, unnest(t) AS x FROM labelled),
items AS (SELECT id, bad, x FROM every WHERE x IN (SELECT x FROM every, totals GROUP BY x, totals.n HAVING sum(bad) >= greatest({count}, ceil({support} * totals.n)))),
sets AS (SELECT id, bad, [x] AS s, x AS top FROM items UNION ALL SELECT sets.id, sets.bad, list_append(s, items.x), items.x FROM sets JOIN items ON items.id = sets.id AND items.x > top),
counts AS (SELECT s, sum(bad) AS n_bad, count(*) AS n FROM sets GROUP BY s),
rules AS (SELECT s, n_bad, n_bad / counts.n AS confidence FROM counts, totals WHERE n_bad >= greatest({count}, ceil({support} * totals.n)) AND n_bad / counts.n >= {confidence} AND n_bad / counts.n >= {lift} * b / totals.n),
kept AS (SELECT * FROM rules r WHERE NOT EXISTS (SELECT 1 FROM rules q WHERE len(q.s) < len(r.s) AND list_has_all(r.s, q.s) AND q.confidence >= r.confidence)),
hits AS (SELECT rid, page_id, url, s, confidence, n_bad FROM tokened JOIN kept ON list_has_all(t, s))
SELECT page_id, url, array_to_string(arg_min(s, (-confidence, -n_bad, s)), ' ') AS terms, max(confidence) AS confidence, count(*) AS n_rules FROM hits GROUP BY rid, page_id, url"""
