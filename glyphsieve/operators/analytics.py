"""What a matrix of search timings tells: rankings, summaries, buckets, win rates, curves, ratings, clusters.

results: dataset, algorithm, table, pattern_index, pattern, pattern_desc, run, duration (microseconds, a decimal, so that sums don't depend on their order),
skipped, table_rows, table_avg_len, table_max_len. Skipped rows never count. Ties go to the first name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphsieve.functions.text import complexity, literal_length, pattern_kind
from glyphsieve.sources.files import kept

SCENARIO = ("dataset", "table", "pattern_index", "run")
#: Ranges of literal lengths for which winners are told; they overlap.
RANGES = (("<=8", 0, 8), ("9-16", 9, 16), ("17-32", 17, 32), ("33-63", 33, 63), ("64-95", 64, 95), ("96-127", 96, 127), ("128-150", 128, 150), (">=64", 64, 10_000))
#: The algorithms that scan, of which core ratings and winners are told.
CORE = ("naive-scalar", "naive-vector", "naive-vector-v2", "naive-mixed", "kmp", "bm", "two-way", "std", "lut-short")
#: Most mean rank and mean slowdown of a tier; both must be kept.
TIERS = (("S", 2.5, 1.08), ("A", 4.5, 1.20), ("B", 7.0, 1.60), ("C", 10.0, 3.0))
BUCKETS = ("low", "medium", "high")


def counted(results: DataFrame) -> DataFrame:
    return results.where("NOT skipped")


def mean(c: str = "duration") -> Column:
    return F.sum(c).cast("double") / F.count(c)


def p95(c: str = "duration") -> Column:
    """Nearest rank."""
    return F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {c})").cast("double")


def ranked(rows: DataFrame, by: str, *groups: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(by, "algorithm")))


def rank_by(results: DataFrame, *groups: str) -> DataFrame:
    """(groups, algorithm, total, rank): algorithms by the sum of their durations, within groups."""
    return ranked(counted(results).groupBy(*groups, "algorithm").agg(F.sum("duration").cast("double").alias("total")), "total", *groups)


def summary(results: DataFrame, *groups: str) -> DataFrame:
    """(groups, n, mean, p95, total)."""
    return counted(results).groupBy(*groups).agg(F.count("*").alias("n"), mean().alias("mean"), p95().alias("p95"), F.sum("duration").cast("double").alias("total"))


def relative_to_best(results: DataFrame) -> DataFrame:
    """(algorithm, mean, percent): how much slower than the best mean, in percent."""
    rows = summary(results, "algorithm")
    return rows.select("algorithm", "mean", ((F.col("mean") / F.min("mean").over(Window.partitionBy()) - 1) * 100).alias("percent"))  # a row an algorithm


def rank_means(results: DataFrame, *groups: str) -> DataFrame:
    """(groups, algorithm, n, mean, rank)."""
    return ranked(counted(results).groupBy(*groups, "algorithm").agg(F.count("*").alias("n"), mean().alias("mean")), "mean", *groups)


def with_kind(results: DataFrame) -> DataFrame:
    return results.withColumn("kind", pattern_kind(F.col("pattern")))


def thresholds(rows: DataFrame, column: str, less: int) -> tuple:
    """The values of a column at places (n - less) // 3 and 2 (n - less) // 3 of its order, from 0, where n is the number of rows."""
    seen = rows.groupBy(column).agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(Window.orderBy(column)))  # a row a distinct value
    n = F.max("upto").over(Window.partitionBy())
    at = lambda k: F.min(F.when(F.col("upto") > F.floor(k * (F.col("n") - less) / 3), F.col(column)))
    return tuple(seen.withColumn("n", n).agg(at(1), at(2)).first())


def _bucket(column: str, ends: tuple, names: tuple[str, str, str]) -> Column:
    return F.when(F.col(column) <= ends[0], names[0]).when(F.col(column) <= ends[1], names[1]).otherwise(names[2])


def enriched(results: DataFrame) -> DataFrame:
    """results that count, with pattern_length, pattern_complexity_raw and _norm (0 to 1), and pattern_len_bucket, data_len_bucket and complexity_bucket: low, medium
    or high, by borders at places (n - 1) // 3 and 2 (n - 1) // 3 of the order of all rows, each within the lower bucket."""
    p = F.col("pattern")
    rows = counted(results).withColumns({"pattern_length": F.length(p), "pattern_complexity_raw": complexity(p).cast("double")})
    low, high = rows.agg(F.min("pattern_complexity_raw"), F.max("pattern_complexity_raw")).first()
    span = max(1e-12, (high or 0) - (low or 0))
    rows = rows.withColumn("pattern_complexity_norm", (F.col("pattern_complexity_raw") - F.lit(low or 0.0)) / F.lit(span))
    of = {"pattern_len_bucket": "pattern_length", "data_len_bucket": "table_avg_len", "complexity_bucket": "pattern_complexity_raw"}
    return rows.withColumns({name: _bucket(c, thresholds(rows, c, 1), BUCKETS) for name, c in of.items()})


def with_data_bucket(results: DataFrame) -> DataFrame:
    """results that count, with data_bucket short, mid or long by their tables' mean lengths: borders at places n // 3 and 2 n // 3 of the order of all rows."""
    rows = counted(results)
    return rows.withColumn("data_bucket", _bucket("table_avg_len", thresholds(rows, "table_avg_len", 0), ("short", "mid", "long")))


def summary_by_buckets(results: DataFrame) -> DataFrame:
    """(algorithm, pattern_len_bucket, complexity_bucket, data_len_bucket, n, mean)."""
    keys = ["algorithm", "pattern_len_bucket", "complexity_bucket", "data_len_bucket"]
    return enriched(results).groupBy(*keys).agg(F.count("*").alias("n"), mean().alias("mean"))


def winners(results: DataFrame) -> DataFrame:
    """The fastest row of each scenario."""
    best = F.min(F.struct("duration", "algorithm")).alias("b")
    return counted(results).groupBy(*SCENARIO).agg(best).select(*SCENARIO, "b.algorithm", F.col("b.duration").cast("double").alias("duration"))


def win_rate(results: DataFrame, *groups: str) -> DataFrame:
    """(groups, algorithm, wins, rate)."""
    rows = winners(results).groupBy(*groups, "algorithm").agg(F.count("*").alias("wins"))
    return rows.withColumn("rate", F.col("wins") / F.sum("wins").over(Window.partitionBy(*groups)))


def recommendation_matrix(results: DataFrame) -> DataFrame:
    """(dataset, data_bucket, kind, best, best_mean, second, second_mean, gap, samples): the two best means of each cell, how much slower the second is, in percent, and
    the rows of the best. Where only one algorithm is there, second is empty and second_mean its own."""
    keys = ["dataset", "data_bucket", "kind"]
    rows = rank_means(with_kind(with_data_bucket(results)), *keys).where("rank <= 2")
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    rows = rows.groupBy(*keys).agg(
        at(1, "algorithm").alias("best"), at(1, "mean").alias("best_mean"), F.coalesce(at(2, "algorithm"), F.lit("")).alias("second"),
        F.coalesce(at(2, "mean"), at(1, "mean")).alias("second_mean"), at(1, "n").alias("samples"),
    )
    gap = F.when(F.col("best_mean") == 0, 0.0).otherwise((F.col("second_mean") / F.col("best_mean") - 1) * 100)
    return rows.select(*keys, "best", "best_mean", "second", "second_mean", gap.alias("gap"), "samples")


def best_by_cell(results: DataFrame) -> DataFrame:
    """(pattern_len_bucket, complexity_bucket, samples, algorithm, mean, n) of all nine cells: how many rows a cell has, the algorithm of the best mean, and how many rows
    that has. A cell without rows has the algorithm `-`."""
    keys = ["pattern_len_bucket", "complexity_bucket"]
    rows = enriched(results).groupBy(*keys, "algorithm").agg(F.count("*").alias("n"), mean().alias("mean"))
    cells = rows.groupBy(*keys).agg(F.sum("n").alias("samples"), F.min(F.struct("mean", "algorithm", "n")).alias("b"))
    grid = F.explode(F.array(*[F.struct(F.lit(x).alias(keys[0]), F.lit(y).alias(keys[1])) for x in BUCKETS for y in BUCKETS]))
    every = results.sparkSession.range(1).select(grid.alias("g")).select("g.*")
    joined = every.join(cells, keys, "left")
    return joined.select(*keys, F.coalesce("samples", F.lit(0)).alias("samples"), F.coalesce("b.algorithm", F.lit("-")).alias("algorithm"), "b.mean", F.coalesce("b.n", F.lit(0)).alias("n"))


def with_literals(results: DataFrame) -> DataFrame:
    """results that count, with literal_len (what the description says, else the characters that aren't wildcards), percents, underscores, and mode: nomatch or exists."""
    p, less = F.col("pattern"), lambda ch: F.length("pattern") - F.length(F.replace("pattern", F.lit(ch), F.lit("")))
    mode = F.when(F.col("pattern_desc").contains("nomatch"), "nomatch").otherwise("exists")
    return counted(results).withColumns({"literal_len": literal_length(p, F.col("pattern_desc")), "percents": less("%"), "underscores": less("_"), "mode": mode})


def _median(c: str = "duration") -> Column:
    """Interpolates between the middle two."""
    return F.median(F.col(c).cast("double"))


def curve_by_length(results: DataFrame, *groups: str) -> DataFrame:
    """(groups, algorithm, literal_len, n, median, mean, p95). groups may have mode."""
    rows = with_literals(results).groupBy(*groups, "algorithm", "literal_len")
    return rows.agg(F.count("*").alias("n"), _median().alias("median"), mean().alias("mean"), p95().alias("p95"))


def algorithm_ratings(results: DataFrame, core: bool = False) -> DataFrame:
    """(algorithm, tier, median, mean, p95, mean_rank, wins, slowdown): of medians at each literal length, the mean rank, how often it's the first, and the geometric mean
    of how many times the best median it is. A tier asks for both mean rank and slowdown."""
    rows = with_literals(results)
    if core:
        rows = rows.where(F.col("algorithm").isin(*CORE))
    own = rows.groupBy("algorithm").agg(_median().alias("median"), mean().alias("mean"), p95().alias("p95"))
    w = Window.partitionBy("literal_len")
    at = rows.groupBy("algorithm", "literal_len").agg(_median().alias("m"))
    at = at.select("*", F.row_number().over(w.orderBy("m", "algorithm")).alias("rank"), F.min("m").over(w).alias("best"))
    slower = F.greatest(F.when(F.col("best") > 0, F.col("m") / F.col("best")).otherwise(1.0), F.lit(1e-12))
    rated = at.groupBy("algorithm").agg((F.sum("rank") / F.count("*")).alias("mean_rank"), F.count_if(F.col("rank") == 1).alias("wins"), F.exp(F.avg(F.ln(slower))).alias("slowdown"))
    tier = F.lit("D")
    for name, rank, times in reversed(TIERS):
        tier = F.when((F.col("mean_rank") <= rank) & (F.col("slowdown") <= times), name).otherwise(tier)
    return own.join(rated, "algorithm").select("algorithm", tier.alias("tier"), "median", "mean", "p95", "mean_rank", "wins", "slowdown")


def range_stats(results: DataFrame, core: bool = False) -> DataFrame:
    """(algorithm, len_range, n, median, mean, p95) over the literal lengths of each of RANGES."""
    rows = with_literals(results)
    if core:
        rows = rows.where(F.col("algorithm").isin(*CORE))
    every = F.array(*[F.when(F.col("literal_len").between(low, high), F.lit(name)) for name, low, high in RANGES])
    rows = rows.select("algorithm", "duration", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("len_range"))
    return rows.groupBy("algorithm", "len_range").agg(F.count("*").alias("n"), _median().alias("median"), mean().alias("mean"), p95().alias("p95"))


def range_winners(results: DataFrame, core: bool = False) -> DataFrame:
    """(len_range, winner, winner_median, second, second_median, gap): the two best medians of each range, and how much slower the second is, in percent. The only
    algorithm of a range is its second, too."""
    rows = range_stats(results, core).withColumn("rank", F.row_number().over(Window.partitionBy("len_range").orderBy("median", "algorithm"))).where("rank <= 2")
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    two = rows.groupBy("len_range").agg(
        at(1, "algorithm").alias("winner"), at(1, "median").alias("winner_median"),
        F.coalesce(at(2, "algorithm"), at(1, "algorithm")).alias("second"), F.coalesce(at(2, "median"), at(1, "median")).alias("second_median"),
    )
    gap = F.when(F.col("winner_median") == 0, 0.0).otherwise((F.col("second_median") / F.col("winner_median") - 1) * 100)
    return two.withColumn("gap", gap)


def pattern_outliers(results: DataFrame, high: float = 1.8, low: float = 0.55) -> DataFrame:
    """(algorithm, pattern_index, pattern_desc, pattern, mode, literal_len, percents, underscores, median, usual, ratio) of the patterns whose median is far from the
    usual one of the algorithm: the median of the medians of its patterns of that literal length."""
    keys = ["algorithm", "pattern_index"]
    told = ["pattern_desc", "pattern", "mode", "literal_len", "percents", "underscores"]
    one = with_literals(results).groupBy(*keys).agg(*[F.first(c).alias(c) for c in told], _median().alias("median"))
    usual = one.groupBy("algorithm", "literal_len").agg(F.median("median").alias("usual"))
    rows = one.join(usual, ["algorithm", "literal_len"]).where("usual > 0").withColumn("ratio", F.col("median") / F.col("usual"))
    return rows.where((F.col("ratio") >= high) | (F.col("ratio") <= low)).select(*keys, *told, "median", "usual", "ratio")


def length_correlation(results: DataFrame) -> DataFrame:
    """(algorithm, points, r): Pearson's correlation of a literal length and the logarithm of the median at that length; 0 if it isn't defined."""
    rows = with_literals(results).groupBy("algorithm", "literal_len").agg(_median().alias("m"))
    m = F.when(F.col("m") > 0, F.log10("m"))
    r = F.corr(F.col("literal_len").cast("double"), m)
    return rows.groupBy("algorithm").agg(F.count(m).alias("points"), F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0)).alias("r"))


#: What scenario_features() tells of pattern and table.
META = ["pattern_len", "percents", "underscores", "complexity", "table_avg_len", "table_max_len", "table_rows", "is_exact", "is_contains"]


def scenario_features(results: DataFrame, algorithms: list[str]) -> DataFrame:
    """A row a scenario, with its pattern and kind: log1p of each algorithm's duration (0 if it has none) in a column of its name, and META."""
    cells = [F.coalesce(F.log1p(F.min(F.when(F.col("algorithm") == a, F.col("duration").cast("double")))), F.lit(0.0)).alias(a) for a in algorithms]
    p = F.col("pattern")
    less = lambda ch: (F.length(p) - F.length(F.replace(p, F.lit(ch), F.lit("")))).cast("double")
    own = [F.max(c).cast("double").alias(c) for c in ("table_avg_len", "table_max_len", "table_rows")]
    rows = with_kind(counted(results).groupBy(*SCENARIO, "pattern").agg(*cells, *own))
    is_ = lambda k: (F.col("kind") == k).cast("double")
    made = [F.length(p).cast("double"), less("%"), less("_"), complexity(p).cast("double"), *map(F.col, META[4:7]), is_("exact"), is_("contains")]
    return rows.select(*SCENARIO, "pattern", "kind", *algorithms, *[c.alias(n) for c, n in zip(made, META)])


def scaled(features: DataFrame, columns: list[str], output: str = "scaled") -> DataFrame:
    """features with a vector of the columns, each of mean 0 and deviation 1."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    steps = [VectorAssembler(inputCols=columns, outputCol=f"{output}_raw"), StandardScaler(inputCol=f"{output}_raw", outputCol=output, withMean=True)]
    return Pipeline(stages=steps).fit(features).transform(features).drop(f"{output}_raw")


def embedded(rows: DataFrame, dimensions: int = 2, vector: str = "scaled", output: str = "embedding") -> DataFrame:
    """rows with the principal components of a vector, in place of a neighbour embedding, which Spark lacks."""
    from pyspark.ml.feature import PCA

    return PCA(k=dimensions, inputCol=vector, outputCol=output).fit(rows).transform(rows)


def clustered(rows: DataFrame, k: int = 6, seed: int = 42, vector: str = "embedding", output: str = "cluster") -> DataFrame:
    """rows with a cluster from 0, by k-means over a vector. Scenarios are dealt out and sorted by their keys to be fitted, since the first centres depend on the order."""
    from pyspark.ml.clustering import KMeans

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fitted = rows.select(*SCENARIO, vector).repartition(n, *SCENARIO).sortWithinPartitions(*SCENARIO) if set(SCENARIO) <= set(rows.columns) else rows
    return KMeans(k=k, seed=seed, featuresCol=vector, predictionCol=output).fit(fitted).transform(rows)


def scenario_clusters(features: DataFrame, algorithms: list[str], k: int = 6) -> DataFrame:
    """features with cluster_profile, of the embedded timings, and cluster_hybrid, of the embedded timings and META; and both embeddings, profile and hybrid.

    Every fit reads its rows several times, so features are written once."""
    rows = kept(features)
    for name, columns in (("profile", algorithms), ("hybrid", [*algorithms, *META])):
        rows = embedded(scaled(rows, columns, f"scaled_{name}"), 2, f"scaled_{name}", name)
        rows = clustered(rows, k, vector=name, output=f"cluster_{name}")
    return rows


def dataset_clusters(features: DataFrame, algorithms: list[str], least: int = 20) -> DataFrame:
    """features of the datasets of `least` scenarios or more, with embeddings of two and three dimensions of each dataset's own and dataset_cluster: min(6, max(2, n // 40))
    clusters of the former. Timings and META are scaled over all datasets. Datasets are few: each is fitted by itself, from features that
    are written once. The first two components of three are those of two."""
    from pyspark.ml.feature import VectorSlicer

    features = kept(features)
    rows = scaled(features, [*algorithms, *META])
    out = None
    for r in features.groupBy("dataset").count().where(F.col("count") >= least).orderBy("dataset").collect():
        own = embedded(rows.where(F.col("dataset") == r["dataset"]), 3, output="embedding3")
        own = VectorSlicer(inputCol="embedding3", outputCol="embedding2", indices=[0, 1]).transform(own)
        own = clustered(own, min(6, max(2, r["count"] // 40)), vector="embedding2", output="dataset_cluster")
        out = own if out is None else out.unionByName(own)
    return rows.where("false").withColumns({"embedding2": F.col("scaled"), "embedding3": F.col("scaled"), "dataset_cluster": F.lit(0)}) if out is None else out


def cluster_summary(clusters: DataFrame, results: DataFrame, cluster: str = "dataset_cluster") -> DataFrame:
    """(dataset, cluster, n, winner, winner_rate, kind, kind_rate, tables): what prevails in each cluster of a dataset's scenarios, and its three most frequent tables,
    each with its number of scenarios."""
    keys = ["dataset", "cluster"]
    rows = clusters.select(*SCENARIO, F.col(cluster).alias("cluster"), "kind").join(winners(results), list(SCENARIO))
    rows = kept(rows.select(*keys, "table", "kind", "algorithm"))

    def most(column: str) -> DataFrame:
        n = rows.groupBy(*keys, column).agg(F.count("*").alias("n"))
        return n.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("n"), column)).alias(column), (F.max("n") / F.sum("n")).alias(f"{column}_rate"))

    tables = rows.groupBy(*keys, "table").agg(F.count("*").alias("n"))
    top = tables.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "table"))).where("k <= 3")
    told = F.struct("k", F.concat("table", F.lit(":"), F.col("n").cast("string")).alias("t"))
    top = top.groupBy(*keys).agg(F.sort_array(F.collect_list(told)).alias("t")).select(*keys, F.array_join("t.t", ", ").alias("tables"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    joined = sizes.join(most("algorithm"), keys).join(most("kind"), keys).join(top, keys)
    return joined.select(*keys, "n", F.col("algorithm").alias("winner"), F.col("algorithm_rate").alias("winner_rate"), "kind", "kind_rate", "tables")
