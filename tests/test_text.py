import random
import re

import pytest
from pyspark.sql import functions as F

from glyphsieve.functions import text as T

TEXTS = ["ababcabcabababd", "ababa", "", None, "🌍hello🌍hello", "xé💩a_c", "zzabczz", "AAA", "AAAA", "a\nb", "éé", "x" * 50]


def column(spark, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    return [r.v for r in df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def places(text, literal):
    b, x = text.encode(), literal.encode()
    return [i for i in range(len(b) - len(x) + 1) if b[i : i + len(x)] == x]


@pytest.mark.parametrize("literal", ["ababd", "aba", "🌍hello", "é", "", "A", "_", "\\E", "nowhere"])
def test_places_are_bytes(spark, literal):
    every = [None if t is None else places(t, literal) for t in TEXTS]
    assert column(spark, lambda c: T.find_all(c, literal)) == every
    assert column(spark, lambda c: T.find_first(c, literal)) == [x[0] if x else None for x in every]
    assert column(spark, lambda c: T.count_overlapping(c, literal)) == [None if x is None else len(x) for x in every]


@pytest.mark.parametrize("pattern", ["a_c", "_b", "__", "b_", "a_c_"])
def test_wildcards_stand_for_bytes(spark, pattern):
    expression = re.compile(b".".join(re.escape(x.encode()) for x in pattern.split("_")), re.S)
    found = [None if t is None else expression.search(t.encode()) for t in TEXTS]
    assert column(spark, lambda c: T.find_wildcard(c, pattern)) == [m.start() if m else None for m in found]


def test_kmers(spark):
    df = spark.createDataFrame([(1, "__ACGTACGT__"), (2, "ACGTACGT__ACGTACGT"), (3, "ZZZZZZZZZZ"), (4, "AAA"), (5, ""), (6, None)], "id int, t string")
    got = sorted((r.id, r.diagonal) for r in T.kmer_diagonals(df, "id", "t", "ACGTACGT", 3, 6).collect())
    assert got == [(1, 2), (2, 0), (2, 10)]
    assert T.kmer_diagonals(df, "id", "t", "AAAAA", 2, 3).count() == 0
    first = {r.id: r.v for r in df.select("id", T.kmer_find(F.col("t"), "ACGTACGT", 3, 6).alias("v")).collect()}
    assert first == {1: 2, 2: 0, 3: None, 4: None, 5: None, 6: None}
    assert df.select(T.kmer_find(F.col("t"), "ACGT", 8, 3).alias("v")).where("v IS NOT NULL").count() == 0


@pytest.mark.parametrize("limit", [0, 1, 4, 7, 100])
def test_clipping(spark, limit):
    assert column(spark, lambda c: T.clip_bytes(c, limit)) == [None if t is None else t.encode()[:limit].decode("utf-8", "ignore") for t in TEXTS]


def test_rarest_bytes_and_frequencies(spark):
    df = spark.createDataFrame([("aab",), ("é",), (None,), ("",)], "t string")
    assert {r.byte: r.n for r in T.byte_frequency(df, "t").collect()} == {97: 2, 98: 1, 0xC3: 1, 0xA9: 1}
    literals = spark.createDataFrame([("ab",), ("aab",), ("zb",), ("",), ("ba",)], "literal string")
    assert {r.literal: r.rarity for r in T.literal_rarity(T.byte_frequency(df, "t"), literals).collect()} == {"ab": 1, "aab": 1, "zb": 0, "ba": 1}
    assert {r.literal: r.byte for r in T.rarest_byte(literals).collect()} == {"ab": 97, "aab": 98, "zb": 122, "ba": 98}


def test_bytes_equal(spark):
    df = spark.createDataFrame([("abc", "abc"), ("abc", "abd"), (None, "a")], "x string, y string")
    assert [r.v for r in df.select(T.bytes_equal(F.col("x"), F.col("y")).alias("v")).collect()] == [True, False, None]
    with pytest.raises(Exception, match="unequal length"):
        spark.createDataFrame([("ab", "abc")], "x string, y string").select(T.bytes_equal(F.col("x"), F.col("y"))).collect()


def test_random_literals(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    literals = ["".join(rng.choice("ACGTN") for _ in range(rng.randint(1, 4))) for _ in range(12)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", *[T.find_first(F.col("t"), x).alias(f"c{i}") for i, x in enumerate(literals)]).collect():
        assert [None if r[f"c{i}"] is None else r[f"c{i}"] for i in range(12)] == [r.t.find(x) if x in r.t else None for x in literals]
