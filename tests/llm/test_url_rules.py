import random

import duckdb
import pytest

from glyphsieve.llm import url_rules as U


def tables(spark, path, seed=1, long=0):
    rng = random.Random(seed)
    pages, labels = [], []
    for i in range(400):
        host = rng.choice(("a.example.com", "b.example.com", "spam.example.org", "x.y.example.net:80", "user@c.example.net"))
        url = f"{rng.choice(('http', 'HTTPS'))}://{host}/{rng.choice(('en', 'de', 'Über', ''))}/{rng.choice(('buy', 'read', '17', 'x-y.html'))}{rng.choice(('', '?page=2', '?ref=x&page=9', '#top'))}"
        pages.append((i, url))
        bad = "spam" in host and rng.random() < 0.9 or "buy" in url and "ref" in url
        labels.append((i, None if i % 50 == 0 else int(not bad), 0 if i % 3 else int(bad)))
    pages += [(400, None), (401, ""), (None, pages[0][1]), (5, pages[5][1]), (6, "http://second.example/"), (403, "//[]?#&%"), (404, "no scheme at all")]
    pages += [(500 + k, "http://z.example/" + "/".join(f"part{j}" for j in range(8)) + f"/{k}") for k in range(long)]
    labels += [(400, 0, 1), (401, 0, 0), (404, 0, 0), (None, 0, 1), (7, 0, 0), (7, None, None), (999, 0, 1)] + [(500 + k, 0, 0) for k in range(long)]
    spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'x' AS terms", "1 AS row").write.mode("overwrite").parquet(f"{path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS bad").write.mode("overwrite").parquet(f"{path}/labels.parquet")


@pytest.mark.parametrize("seed,long,limit", [(1, 0, 16), (2, 6, 16), (3, 6, 2)])
def test_equals_all_combinations(spark, tmp_path, monkeypatch, seed, long, limit):
    monkeypatch.setattr(U, "LONG_URL", limit)  # 2: level by level
    tables(spark, tmp_path, seed, long)
    c = duckdb.connect()
    for t in ("pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    out = U.query(spark, str(tmp_path))
    expected = c.execute(f"SELECT {', '.join(out.columns)} FROM ({U.oracle()})").fetchall()
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr) and len(got) > 50
    assert sum("spam" in r[1] for r in got) > 50 and (not long or sum(r[1].startswith("http://z.") for r in got) == long)


def test_rules_of_many_tokens(spark):
    """Bad only where four words meet, of which any three are harmless; and long bad URLs, whose tokens all stand in the same rows."""
    words = ["one", "two", "three", "four"]
    urls, bad = [], []
    for k in range(160):
        some = [w for b, w in enumerate(words) if k % 16 >> b & 1]
        urls.append(f"http://h{k}.example/{'/'.join(some)}")
        bad.append(int(len(some) == 4))
    for k in range(60):
        urls.append(f"http://g{k}.example/" + "/".join(w for w in words if w != words[k % 4]))
        bad.append(0)
    for k in range(12):
        urls.append("http://long.example/" + "/".join(f"part{chr(97 + j % 26)}{'x' * (j // 26)}" for j in range(200)) + f"?id={k}")
        bad.append(1)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, b) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    rules = U.mine_rules(pages, labels)
    assert ["path:four", "path:one", "path:three", "path:two"] in [r.terms for r in rules.collect()]
    flagged = {r.page_id for r in U.flagged(pages, rules).collect()}
    assert flagged == {i for i, b in enumerate(bad) if b}


def test_very_long_url(spark):
    url = "http://x.example/" + "/".join(f"w{k}" for k in range(2_000))
    pages = spark.createDataFrame([(k, url) for k in range(4)] + [(9, "http://y.example/")], "page_id long, url string")
    labels = spark.createDataFrame([(k, 0, 0) for k in range(4)] + [(9, 1, 0)], "doc_id long, quality int, toxic int")
    some = U.flagged(pages, U.mine_rules(pages, labels)).collect()
    assert {r.page_id for r in some} == {0, 1, 2, 3} and all(r.n_rules > 2_000 for r in some)


def test_tokens(spark):
    df = spark.createDataFrame([("https://u@A.b.example:80/en/17/x-y.html?q=1&page#top",), ("no scheme",), ("",), (None,), ("http://",)], "url string")
    got = [r[0] for r in df.select(U.tokens(df.url)).collect()]
    assert got[0] == sorted(["scheme:https", "host:a.b.example", "host:b.example", "host:example", "path:en", "path:0", "path:x", "path:y", "path:html", "query:q", "query:0", "query:page"])
    assert got[1:] == [["host:no scheme"], [], [], ["scheme:http"]]


def test_rules_are_not_needless(spark, tmp_path):
    tables(spark, tmp_path)
    rules = U.mine_rules(spark.read.parquet(f"{tmp_path}/pages.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    for r in rules:
        assert r.n_bad >= U.MIN_COUNT and r.confidence == r.n_bad / r.n >= U.MIN_CONFIDENCE
        assert not any(set(q.terms) < set(r.terms) and q.confidence >= r.confidence for q in rules)


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path)
    pages, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("pages", "labels"))
    assert U.flagged(pages, U.mine_rules(pages, labels.where("false"))).count() == 0
    assert U.flagged(pages.where("false"), U.mine_rules(pages, labels)).count() == 0
    assert U.mine_rules(pages, labels.where("quality = 1 AND toxic = 0")).count() == 0
