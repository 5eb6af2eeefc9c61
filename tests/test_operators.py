import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphsieve.functions.pattern import like
from glyphsieve.operators import analytics, engine, index, patterngen


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    texts = ["apple", "applet", "pineapple", "application", "banana", "bandana", "", None, "ééapple", "bolt nut", "blue bolt"]
    texts += [" ".join(rng.choice(("blue", "red", "bolt", "nut", "gear", "été")) for _ in range(rng.randint(1, 8))) for _ in range(60)]
    return spark.createDataFrame([(("a", "b")[i % 2], i, t) for i, t in enumerate(texts)], "table string, row_id long, data string").cache()


PATTERNS = ["blue%", "%bolt", "%appl%", "b%t", "%", "", "%e_n%", "%zzz%", "banana", "%blue%bolt%", "%é%t%", "%a%", "__%bolt%e_r%", "%a very long literal that is nowhere to be found%x%"]


def ids(df):
    return sorted(r.row_id for r in df.collect())


@pytest.mark.parametrize("pattern", PATTERNS)
def test_index_paths_equal_the_scan(corpus, pattern):
    expected = ids(engine.execute(corpus, pattern))
    assert ids(index.trigram_like(corpus, index.trigram_index(corpus), pattern)) == expected
    assert ids(index.suffix_like(corpus, index.suffix_index(corpus), pattern)) == expected


def test_trigrams_and_suffixes(corpus):
    grams, suffixes = index.trigram_index(corpus), index.suffix_index(corpus, 8)
    assert ids(index.trigram_candidates(grams, "appl")) == [0, 1, 2, 3, 8] and ids(index.trigram_candidates(grams, "pine")) == [2]
    assert index.trigram_candidates(grams, "ap") is None
    found = sorted((r.row_id, r.position) for r in index.suffix_search(suffixes, "ana").collect())
    assert found == [(4, 1), (4, 3), (5, 4)]
    assert sorted((r.row_id, r.position) for r in index.suffix_search_wildcard(suffixes, "b_n").collect()) == [(4, 0), (5, 0)]
    assert sorted((r.row_id, r.position) for r in index.suffix_search_wildcard(suffixes, "a__lication", corpus, 8).collect()) == [(3, 0)]
    with pytest.raises(ValueError):
        index.suffix_search_wildcard(suffixes, "a__lication", keep=8)
    assert sorted((r.row_id, r.position) for r in index.suffix_search(suffixes, "application", corpus, 8).collect()) == [(3, 0)]
    with pytest.raises(ValueError):
        index.suffix_search(suffixes, "application", keep=8)
    assert (8, 4) in [(r.row_id, r.position) for r in index.suffix_search(suffixes, "apple").collect()]  # bytes, not characters


def test_too_broad_literals_are_not_probed(corpus, monkeypatch):
    monkeypatch.setattr(index, "BROAD", 0)
    assert {r.literal: r.broad for r in index.selectivity(index.suffix_index(corpus), ["e", "zzz"]).collect()} == {"e": True, "zzz": False}
    assert ids(index.suffix_like(corpus, index.suffix_index(corpus), "%blue%bolt%")) == ids(engine.execute(corpus, "%blue%bolt%"))


def test_batches_and_counts(corpus, monkeypatch):
    monkeypatch.setattr(engine, "AT_ONCE", 5)
    every = engine.execute_all(corpus, PATTERNS).collect()
    for i, p in enumerate(PATTERNS):
        assert sorted(r.row_id for r in every if r.pattern_index == i) == ids(engine.execute(corpus, p)), p
    hits = engine.hits_by_pattern_table([("x", corpus, "data"), ("y", corpus, "table")], PATTERNS)
    counted = {(r.pattern_index, r.table): r.hits for r in hits.collect()}
    assert len(counted) == 2 * len(PATTERNS) and counted[7, "x"] == 0
    for i, p in enumerate(PATTERNS):
        assert counted[i, "x"] == len(ids(engine.execute(corpus, p)))
    assert {r.table: r.rows for r in engine.table_stats(corpus).collect()} == {"a": 36, "b": 35}
    changed = hits.withColumn("hits", F.col("hits") + F.when(F.col("pattern_index") == 2, 1).otherwise(0))
    diff = engine.correctness_diff(changed, hits.where("table = 'x'")).where("pattern_index = 2").collect()
    assert {(r.table, r.expected) for r in diff} == {("x", counted[2, "x"]), ("y", 0)}
    assert engine.hits_by_pattern_table([("x", corpus.where("false"), "data")], ["%"]).collect()[0].hits == 0


def test_one_pass_has_no_join(corpus):
    plan = engine.execute_all(corpus, PATTERNS[:4])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Python" not in plan


def test_predicates_work_on_streams(spark, tmp_path):
    from glyphsieve.streaming import matches

    spark.createDataFrame([("blue bolt",), ("red nut",)], "data string").write.parquet(f"{tmp_path}/in")
    stream = matches(spark.readStream.schema("data string").parquet(f"{tmp_path}/in"), ["blue%", "%t"])
    q = stream.writeStream.format("memory").queryName("found").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.pattern_index, r.data) for r in spark.table("found").collect()) == [(0, "blue bolt"), (1, "blue bolt"), (1, "red nut")]


def results(spark):
    patterns = (("abc", "", 10), ("%abcd%", "own-len-nomatch|len=20", 20), ("a_%", "x", 30))
    rows = [("d", a, f"t{t}", k, p, told, 1, d, a == "fm", 7, 2.5 + t, 9) for t in range(2) for k, (p, told, base) in enumerate(patterns) for a, d in (("bm", base + t), ("kmp", base + 2 * t), ("fm", 1))]
    schema = "dataset string, algorithm string, table string, pattern_index int, pattern string, pattern_desc string, run int, duration int, skipped boolean, table_rows long, table_avg_len double, table_max_len long"
    return spark.createDataFrame(rows, schema).withColumn("duration", F.col("duration").cast("decimal(18,4)"))


def test_analytics(spark):
    r = results(spark)
    assert [(x.algorithm, x.total, x.rank) for x in analytics.rank_by(r).orderBy("rank").collect()] == [("bm", 123.0, 1), ("kmp", 126.0, 2)]
    one = {x.algorithm: x for x in analytics.summary(r, "algorithm").collect()}
    assert (one["bm"].n, one["bm"].mean, one["bm"].p95) == (6, 20.5, 31.0)
    assert {(x.algorithm, x.wins) for x in analytics.win_rate(r).collect()} == {("bm", 6)}  # ties go to the first name
    assert {x.algorithm: round(x.percent, 6) for x in analytics.relative_to_best(r).collect()} == {"bm": 0, "kmp": round((21 / 20.5 - 1) * 100, 6)}
    # medians at literal lengths 3, 20 and 1: 10.5, 20.5, 30.5 and 11, 21, 31
    rated = {x.algorithm: x for x in analytics.algorithm_ratings(r).collect()}
    assert (rated["bm"].tier, rated["bm"].mean_rank, rated["bm"].wins, rated["bm"].slowdown) == ("S", 1.0, 3, 1.0)
    assert rated["kmp"].tier == "S" and rated["kmp"].mean_rank == 2.0 and abs(rated["kmp"].slowdown - (11 / 10.5 * 21 / 20.5 * 31 / 30.5) ** (1 / 3)) < 1e-12
    # scores 3, 12 and 7 (twice two each): borders at places 3 and 7 of 12
    assert {x.pattern: x.complexity_bucket for x in analytics.enriched(r).collect()} == {"abc": "low", "a_%": "medium", "%abcd%": "high"}
    assert {x.table: x.data_bucket for x in analytics.with_data_bucket(r).collect()} == {"t0": "short", "t1": "mid"}
    assert {(x.len_range, x.winner, x.winner_median, x.second) for x in analytics.range_winners(r).collect()} == {("<=8", "bm", 20.5, "kmp"), ("17-32", "bm", 20.5, "kmp")}
    assert {x["mode"] for x in analytics.curve_by_length(r, "mode").where("literal_len = 20").collect()} == {"nomatch"}
    cells = analytics.best_by_cell(r).collect()
    assert len(cells) == 9 and sum(x.samples for x in cells) == 12 and {x.algorithm for x in cells} == {"bm", "-"}
    assert analytics.length_correlation(r.where("pattern_index = 0")).select("r").distinct().collect()[0].r == 0.0


def test_embedding_and_clusters(spark):
    rng = random.Random(4)
    schema = "dataset string, table string, pattern_index int, run int, pattern string, kind string, a double, b double, " + ", ".join(f"{m} double" for m in analytics.META)
    rows = [("d" + str(i % 2), f"t{i % 3}", i, 1, "x", ("exact", "contains")[i % 2], rng.random() + 9 * (i % 4 == 0), rng.random(), *[rng.random() for _ in analytics.META]) for i in range(90)]
    df = spark.createDataFrame([*rows, ("small", "t", 999, 1, "x", "exact", 1.0, 1.0, *[0.0] * 9)], schema)
    got = analytics.dataset_clusters(df, ["a", "b"]).collect()
    assert len(got) == 90 and {r.dataset for r in got} == {"d0", "d1"} and max(r.dataset_cluster for r in got) == 1
    x = np.array([r[6:] for r in rows] + [[1.0, 1.0, *[0.0] * 9]])
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    for d in ("d0", "d1"):
        own = x[[i for i, r in enumerate(rows) if r[0] == d]]
        axes = np.linalg.svd(own - own.mean(0))[2][:2]
        mine = np.array([r.embedding2.toArray() for r in sorted(got, key=lambda r: r.pattern_index) if r.dataset == d])
        assert np.allclose(np.abs(mine), np.abs(own @ axes.T), atol=1e-8)
    results = spark.createDataFrame([(r[0], r[1], r[2], 1, a, 1 + (r[2] + k) % 2, False) for r in rows for k, a in enumerate(("a", "b"))], "dataset string, table string, pattern_index int, run int, algorithm string, duration int, skipped boolean")
    told = analytics.cluster_summary(analytics.dataset_clusters(df, ["a", "b"]), results).collect()
    for t in told:
        own = [r for r in got if r.dataset == t.dataset and r.dataset_cluster == t.cluster]
        tables = sorted(((sum(r.table == x for r in own), x) for x in {r.table for r in own}), key=lambda y: (-y[0], y[1]))
        assert t.n == len(own) and t.tables == ", ".join(f"{x}:{n}" for n, x in tables[:3])
        assert t.winner_rate == 1.0 and t.winner == ("a" if t.dataset == "d0" else "b") and t.kind_rate == 1.0
    assert sum(t.n for t in told) == 90


def made_of(tok):
    """What the definition makes of one token."""
    n, mid, q1, q3 = len(tok), len(tok) // 2, len(tok) // 4, 3 * len(tok) // 4
    yield from (tok, f"%{tok}%", f"{tok}%", f"%{tok}")
    if n >= 5:
        yield from (f"%{tok[:mid]}_{tok[mid + 1:]}%", f"{tok[:mid]}%{tok[mid:]}")
    if n >= 8:
        yield from (f"%{tok[:q1]}%{tok[q3:]}%", f"{tok[:q1]}_{tok[q1 + 1:q3]}_{tok[q3 + 1:]}")
    if n >= 4:
        yield f"%{tok[:2]}_{tok[-2:]}%"


def test_generated_patterns_match_their_tokens(spark):
    df = spark.createDataFrame([(1, "Alpha beta-gamma 123 alpha ab x99 delta9delta"), (2, None), (3, "")], "id int, t string")
    assert {r.token: r.n for r in patterngen.tokenize(df, "t").collect()} == {"Alpha": 1, "beta": 1, "gamma": 1, "alpha": 1, "x99": 1, "delta9delta": 1}
    tokens = patterngen.distinct_tokens(df, "t", F.col("id"))
    names = {r.token for r in tokens.collect()}
    assert names == {"Alpha", "beta", "gamma", "x99", "delta9delta"}
    made = {r.pattern: r.description for r in patterngen.generate_patterns(tokens).collect()}
    assert set(made) == {p for t in names for p in made_of(t)} | {x for t in names for x in (f"%{t[0]}%", f"_{t[0]}_%")}
    hits = spark.createDataFrame([(t,) for t in names], "t string").select("t", *[like(F.col("t"), p).alias(f"p{k}") for k, p in enumerate(made)]).collect()
    for k, (p, told) in enumerate(made.items()):
        kind, _, token = told.partition(":")
        if kind not in ("underscore-heavy", "short-gap"):  # these need not match
            assert next(r for r in hits if r.t == token)[f"p{k}"], (p, told)
    pairs = patterngen.generate_pair_patterns(tokens).collect()
    assert len(pairs) == 6 and {p.description.partition(":")[0] for p in pairs} == {"two-literals", "bridge", "short-bridge"}
    few = patterngen.stratified(patterngen.autogenerated(tokens, 12), 12).collect()
    assert len(few) == 12 and [sum(r.tier == t for r in few) for t in range(3)] == [4, 4, 4]
    every = patterngen.autogenerated(tokens, 200)
    assert patterngen.stratified(every, 200).count() == every.count() == len({*made, *[p.pattern for p in pairs]})


def test_sampled_tokens(spark):
    df = spark.createDataFrame([(k, f"one{k} two{k}", f"three{k}", None) for k in range(50)], "id int, a string, b string, c string")
    got = patterngen.sample_tokens(df, F.col("id"), ["a", "b", "c"], 30, 20).collect()
    by = {k: [r.token for r in got if r.position == k] for k in range(50)}
    assert all(x in ([], [f"one{k}", f"two{k}"], [f"three{k}"]) for k, x in by.items()) and 20 <= len(got) <= 21 and max(r.position for r in got) < 30


def test_ranks_over_partitions(spark):
    df = spark.createDataFrame([(f"t{i:04d}",) for i in random.Random(1).sample(range(3000), 700)], "token string")
    got = [(r.rn, r.token) for r in patterngen.rank_all(df, "token").collect()]
    assert sorted(got) == list(enumerate(sorted(t for _, t in got), 1))


def test_ranks_of_more_rows_than_borders_are_sampled_from(spark):
    n = 60_000
    df = spark.range(n).select(F.concat(F.md5(F.col("id").cast("string")), F.lit("-")).alias("h"), "id")
    got = patterngen.rank_all(df, "h").orderBy("rn").collect()
    assert [r.rn for r in got] == list(range(1, n + 1)) and [r.h for r in got] == sorted(r.h for r in got)
    ranked = patterngen.shuffle_ranks(df.select(F.col("h").alias("token"))).agg(F.countDistinct("rn"), F.min("rn"), F.max("rn"), F.min("n")).first()
    assert tuple(ranked) == (n, 1, n, n)


def test_length_sweeps(spark):
    df = spark.createDataFrame([(1, "short é text"), (2, "a%b_c  longer printable text here"), (3, None), (4, "")], "id int, t string")
    exists = patterngen.len_sweep_exists(df, "id", "t", (1, 4, 10, 50))
    got = {r.n: r.literal for r in exists.collect()}
    assert set(got) == {1, 4, 10} and all(len(v) == n and not re.search("[%_]", v) for n, v in got.items())
    assert all(df.where(F.col("t").contains(v)).count() for v in got.values())
    none = {r.n: r.literal for r in patterngen.len_sweep_nomatch(exists, df, "t", lengths=(4, 10)).collect()}
    assert set(none) == {4, 10} and not any(df.where(F.col("t").contains(v)).count() for v in none.values())
    assert patterngen.mutated("ACGTACGT", "dna", 3) == "ACGT3CGT" and patterngen.mutated("ACGT3CGT", "dna", 3) == "ACGT4CGT" and patterngen.mutated("abcdefghijkl", "text", 12) == "abcQZXJ2KQkl"
    with pytest.raises(ValueError, match="don't occur"):
        patterngen.len_sweep_patterns(exists, exists)
    there = spark.createDataFrame([(4, "blue")], "n int, literal string")
    with pytest.raises(ValueError, match="absent"):
        patterngen.len_sweep_nomatch(there, spark.createDataFrame([(" ".join(patterngen.mutated("blue", "text", k) for k in range(10)),)], "t string"), "t", lengths=(4,))


def test_persisted_indexes(spark, corpus, tmp_path):
    first = index.persisted(corpus, "trigram", str(tmp_path))
    again = index.persisted(corpus.where("false"), "trigram", str(tmp_path))  # opened, not built
    assert first.count() == again.count() > 0
    suffixes = index.persisted(corpus, "suffix", str(tmp_path))
    lookup = index.SuffixLookup(suffixes, corpus)
    assert lookup.count("ana") == 3 and not lookup.broad("ana")
    for p in PATTERNS:
        assert ids(index.trigram_like(corpus, again, p)) == ids(index.suffix_like(corpus, lookup, p)) == ids(engine.execute(corpus, p)), p
    plan = index.suffix_search(suffixes, "ana")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith" in plan and "GreaterThanOrEqual" in plan


def test_literal_sweep_judges_texts_once_a_literal(spark, corpus):
    got = engine.literal_sweep(corpus, ["bolt", "ana"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # algorithms are dealt out after the counts are summed
    expected = {(t, p): sum(len(re.findall(f"(?={p})", r.data or "")) for r in corpus.collect() if r.table == t) for t in "ab" for p in ("bolt", "ana")}
    rows = got.collect()
    assert len(rows) == 10 * 2 * 2 and all(r.hits == expected[r.table, r.pattern] for r in rows)


def test_length_sweep_takes_the_first_run_of_the_smallest_id_in_one_pass(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab  %_é\n🙂cd~!") for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["  ", "", None, " x ", "%", "ab cd ef gh  ij kl" * 3, "a" * 30]
    ids_ = rng.sample(range(10_000), len(texts))
    df = spark.createDataFrame(list(zip(ids_, texts)), "id long, t string").repartition(5)
    lengths = (1, 2, 3, 5, 8, 13, 20, 30, 54, 60)
    expected = {}
    for n in lengths:
        run = re.compile("[!-$&-^`-~]" + (f"[ -$&-^`-~]{{{n - 2}}}[!-$&-^`-~]" if n > 1 else ""))
        found = [m[0] for _, t in sorted(zip(ids_, texts)) if (m := run.search(t or ""))]
        expected |= {n: found[0]} if found else {}
    exists = patterngen.len_sweep_exists(df, "id", "t", lengths)
    assert {r.n: r.literal for r in exists.collect()} == expected and 60 not in expected
    assert "Aggregate" not in exists._jdf.queryExecution().optimizedPlan().toString()  # fetched, not computed anew


def test_clusters_read_features_that_are_written_once(spark):
    from pyspark.ml.functions import vector_to_array

    rng = random.Random(4)
    made = [("d", "t", i, 0, "p", "exact", *[rng.random() * 9 for _ in range(3 + len(analytics.META))]) for i in range(90)]
    names = ["dataset", "table", "pattern_index", "run", "pattern", "kind", "x", "y", "z", *analytics.META]
    features = spark.createDataFrame(made, names).repartition(3)
    out = analytics.dataset_clusters(features, ["x", "y", "z"])
    assert "ExistingRDD" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "parquet" in plan.lower()
    assert "ExistingRDD" not in analytics.scenario_clusters(features, ["x", "y", "z"])._jdf.queryExecution().executedPlan().toString()
    two = analytics.embedded(analytics.scaled(features, ["x", "y", "z", *analytics.META]), 2)
    at = lambda df, c: {r.pattern_index: r.v for r in df.select("pattern_index", vector_to_array(c).alias("v")).collect()}
    got, expected = at(out, "embedding2"), at(two, "embedding")
    assert len(got) == 90 and all(np.allclose(np.abs(got[k]), np.abs(expected[k])) for k in got)


def test_indexes_are_parted_by_borders_and_in_order(spark, tmp_path):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdé \nZ🙂\0") for _ in range(rng.randint(0, 90))) for _ in range(3000)] + ["x" * 100_000 + "é" * 9, "ab", "", None]
    df = spark.createDataFrame([(("a", "b")[i % 2], i, t) for i, t in enumerate(texts)], "table string, row_id long, data string").repartition(3)
    raw = {i: (t or "").encode() for i, t in enumerate(texts)}
    grams = sorted((int.from_bytes(g, "big"), ("a", "b")[i % 2], i) for i, b in raw.items() for g in {b[k : k + 3] for k in range(len(b) - 2)})
    suffixes = sorted((b[k : k + 24].decode("latin1"), ("a", "b")[i % 2], i, k) for i, b in raw.items() for k in range(len(b)))
    for kind, expected in (("trigram", grams), ("suffix", suffixes)):
        got = index.persisted(df, kind, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == expected
        key = got.columns[0]
        ends = sorted(tuple(r) for r in got.groupBy(F.col("_metadata.file_path")).agg(F.min(key).alias("x"), F.max(key).alias("y")).select("x", "y").collect())
        assert len(ends) >= 4 and all(y < x for (_, y), (x, _) in zip(ends, ends[1:]))
        for f in [r[0] for r in got.select("_metadata.file_path").distinct().collect()]:
            keys = [r[0] for r in spark.read.parquet(f).coalesce(1).select(key).collect()]
            assert keys == sorted(keys)


def test_suffixes_are_made_a_window_at_a_time():
    import pyarrow as pa

    text = "".join(random.Random(6).choice("abcé") for _ in range(1 << 20))
    batch = pa.RecordBatch.from_arrays([pa.array(["t", "t"]), pa.array([1, 2]), pa.array([text, "end"])], names=["table", "row_id", "data"])
    made = list(index._suffixes(24, np.array([], np.uint64), iter([batch])))
    assert sum(map(len, made)) == len(text.encode()) + 3 and max(map(len, made)) <= index._WINDOW
