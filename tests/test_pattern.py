import random
import re

import pytest
from pyspark.sql import functions as F

from glyphsieve.functions import pattern as P

TRUTH = [
    ("hello", ["hello"], ["hello world", ""]), ("h%o", ["hello", "ho", "h_long_string_o"], ["h"]), ("%ell%", ["hello"], []), ("abc%", ["abcXYZ"], ["xabc"]), ("%", ["anything", ""], []),
    ("h_t", ["hat"], ["heat"]), ("%a", ["banana", "pizza"], ["ab"]), ("a%b", ["abb"], ["a"]), ("a_%_b", ["ax_b", "a_long___b"], ["ab"]), ("_%", ["💩", "💩more"], [""]),
    ("a%a", ["aa", "aba"], ["a"]), ("", [""], ["a"]), ("a\\b", ["a\\b"], ["ab"]), ("\\%", ["\\x"], ["%"]), ("a_b", ["a\nb"], []), ("%%%", ["x", ""], []), ("%x%y%x%", ["axbycx", "xyx"], ["xy", "yx"]),
]


def oracle(pattern, text, underscore):
    if underscore == "byte":
        pattern, text = pattern.encode().decode("iso-8859-1"), text.encode().decode("iso-8859-1")
    one = re.escape("_") if underscore == "literal" else "."
    return re.fullmatch("".join(".*" if c == "%" else one if c == "_" else re.escape(c) for c in pattern), text, re.S) is not None


def check(spark, patterns, texts, underscore):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for k in range(0, len(patterns), 40):
        part = patterns[k : k + 40]
        for r in df.select("i", *[P.like(F.col("t"), p, underscore).alias(f"p{j}") for j, p in enumerate(part)]).collect():
            for j, p in enumerate(part):
                assert r[f"p{j}"] == oracle(p, texts[r.i], underscore), (p, texts[r.i], underscore)


@pytest.mark.parametrize("underscore", ["byte", "char", "literal"])
def test_random_patterns_equal_a_regular_expression(spark, underscore):
    rng = random.Random(underscore)
    word = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))
    check(spark, sorted({word("ab%_é", 6) for _ in range(160)}), sorted({word("abé_%", 7) for _ in range(150)} | {""}), underscore)
    check(spark, [word("a%", 30) for _ in range(20)], [word("ab", 20) for _ in range(40)], underscore)


def test_truth_table(spark):
    texts = sorted({t for _, yes, no in TRUTH for t in (*yes, *no)})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern, yes, no in TRUTH:
        got = {r.t for r in df.where(P.like(F.col("t"), pattern, "char")).collect()}
        assert set(yes) <= got and not set(no) & got, pattern


def test_units_of_underscore(spark):
    df = spark.createDataFrame([("💩",), ("a",), ("zza_czz",), ("zzabczz",)], "t string")
    hits = lambda p, u: {r.t for r in df.where(P.like(F.col("t"), p, u)).collect()}
    assert hits("_", "byte") == {"a"} and hits("_", "char") == {"a", "💩"} and hits("____", "byte") == {"💩"} and hits("%a_c%", "literal") == {"zza_czz"}


def test_null_is_the_empty_text(spark):
    df = spark.createDataFrame([(None,), ("x",)], "t string")
    assert [df.where(P.like(F.col("t"), p)).count() for p in ("%", "", "x", "_%", "%x%x%")] == [2, 1, 1, 1, 0]


@pytest.mark.parametrize("pattern,strategy", [("%", "all"), ("", "exact"), ("a", "exact"), ("a%%", "prefix"), ("%a", "suffix"), ("%a%", "contains"), ("a%b", "percent"), ("a_", "general")])
def test_strategies(pattern, strategy):
    assert P.compile_like(pattern).strategy == strategy


@pytest.mark.parametrize("pattern,pushed", [("blue%", "StringStartsWith"), ("%gear", "StringEndsWith"), ("%ol%", "StringContains"), ("blue bolt", "EqualTo")])
def test_plain_strategies_reach_the_scan(spark, pattern, pushed):
    df = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    plan = df.where(P.like(F.col("p_name"), pattern)).select("p_partkey")._jdf.queryExecution().executedPlan().toString()
    assert pushed in plan.split("PushedFilters")[1].split("ReadSchema")[0]
    assert "Python" not in plan


def test_algorithms():
    assert P.plan_family("kmp") == "scan" and P.plan_family("fm") == "suffix" and P.plan_family("bm", ("bm",)) is None
    with pytest.raises(ValueError):
        P.plan_family("unheard-of")
    with pytest.raises(ValueError):
        P.compile_like("a", "word")
