import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from glyphsieve.llm import decontaminate as D
from glyphsieve.llm._words import WORD
from glyphsieve.llm.fm_index import FMIndex, suffix_order

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sequence(rng, n, alphabet, zeros):
    t = [0 if rng.random() < zeros else rng.randrange(1, alphabet) for _ in range(n)]
    return np.array([0, *t, 0], np.int64)


@pytest.mark.parametrize("seed,alphabet,zeros", [(1, 4, 0.1), (2, 3, 0.01), (3, 200, 0.2), (4, 2, 0.02)])
def test_index_equals_brute_force(seed, alphabet, zeros):
    rng = random.Random(seed)
    t = sequence(rng, 700, alphabet, zeros)
    index, s = FMIndex(t, (alphabet - 1).bit_length() or 1), t.tolist()
    for n in (1, 2, 3, 5, 9):
        phrases = [s[i : i + n] for i in range(0, len(s) - n, 7)]
        phrases = np.array([p for p in phrases if 0 not in p] or [[1] * n], np.int64)
        which, low, high = index.search(phrases)
        found = {w: sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which.tolist(), low.tolist(), high.tolist())}
        for k, p in enumerate(phrases.tolist()):
            assert found.get(k, []) == [i for i in range(len(s) - n + 1) if s[i : i + n] == p]


def test_suffix_order_of_long_repeats():
    t = np.array([0, *([1, 2, 3] * 60), 0, *([1, 2, 3] * 60), 0], np.int64)
    segments = [tuple(t[i : i + list(t[i:]).index(0)].tolist()) for i in range(len(t))]
    assert suffix_order(t, 2).tolist() == sorted(range(len(t)), key=lambda i: (segments[i], i + len(segments[i])))


def brute(docs, items, size=D.PHRASE_WORDS, least=D.MIN_WORDS):
    phrases = set()
    for text in items:
        w = re.findall(WORD, (text or "").lower())
        n = min(size, len(w))
        if n >= least:
            phrases |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = []
    for doc_id, text in docs:
        at = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(WORD, text or "")]
        hit = [False] * len(at)
        for n in {len(p) for p in phrases}:
            for i in range(len(at) - n + 1):
                if tuple(x[2] for x in at[i : i + n]) in phrases:
                    hit[i : i + n] = [True] * n
        i = 0
        while i < len(at):
            j = i
            while j < len(at) and hit[j]:
                j += 1
            if j > i:
                out.append((doc_id, at[i][0], at[j - 1][1], j - i))
            i = max(j, i + 1)
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)] + ["über", "ñandú", "日本"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [prose(rng.randint(6, 30)) for _ in range(6)] + ["too few words", None, "", "exactly five words are here"]
    docs = []
    for i in range(80):
        x, y = prose(rng.randint(0, 60)), prose(rng.randint(0, 60))
        docs.append((i, x + (rng.choice((" ", "\n— ")) + (rng.choice(items) or "").upper() + "! " if i % 3 == 0 else " ") + y))
    docs += [(90, None), (91, ""), (92, items[0]), (93, items[0] + " " + items[0]), (None, items[1]), (92, items[0]), (94, prose(20_000) + " " + items[2]), (95, "exactly FIVE words—are here"), (96, "...")]
    return docs, items


def frames(spark):
    docs, items = corpus()
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in docs]
    return docs, items, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")


def test_equals_brute_force_and_sql(spark, monkeypatch):
    docs, items, df, benchmark = frames(spark)
    expected = brute(docs, items)
    assert {r[3] for r in expected} and len(expected) > 20
    got = sorted((tuple(r) for r in D.contaminated_spans(df, benchmark).collect()), key=repr)
    assert got == expected
    c = duckdb.connect()
    documents_table, benchmark_table = df.toPandas(), benchmark.toPandas()  # noqa: F841
    c.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM documents_table")
    c.execute("CREATE TABLE benchmark AS SELECT * FROM benchmark_table")
    assert sorted(c.execute(D.oracle()).fetchall(), key=repr) == expected
    # shards end anywhere between documents
    monkeypatch.setattr(D, "SHARD_BYTES", 500)
    text = pa.array([t for _, t in docs], pa.large_string())
    row, *rest = D.find_spans(text, D.phrases_of(pa.array(items)))
    assert sorted(zip((docs[i][0] for i in row), *(x.tolist() for x in rest)), key=repr) == expected


def test_large_benchmark_in_parts(spark, monkeypatch):
    docs, items, df, benchmark = frames(spark)
    monkeypatch.setattr(D, "BENCHMARK_BYTES", 200)
    covered = lambda rows: {(i, k) for i, a, b, _ in rows for k in range(a, b) if i is not None}
    got, expected = covered(D.contaminated_spans(df, benchmark).collect()), covered(brute(docs, items))
    texts = dict((i, t) for i, t in docs if t)
    assert {x for x in got ^ expected if not re.match(r"\W", texts[x[0]][x[1]])} == set()


def test_removal_keeps_the_rest(spark):
    docs, items, df, benchmark = frames(spark)
    df = df.selectExpr("*", "map('a', 1) AS m", "1 AS span_start", "2 AS item_id")
    out = D.decontaminate(df, benchmark)
    assert out.columns == df.columns and dict(out.dtypes) == dict(df.dtypes)
    rows = {r.doc_id: r for r in out.collect()}
    spans = {}
    for i, a, b, _ in brute(docs, items):
        spans.setdefault(i, []).append((a, b))
    assert 92 not in rows and 93 not in rows and None not in rows and 95 not in rows  # nothing is left of these
    assert rows[90].text is None and rows[91].text == "" and rows[96].text == "..."
    for i, t in docs[:80]:
        if i not in rows:  # all of it stands in the benchmark
            assert not re.search(WORD, "".join(t[k] for k in range(len(t)) if not any(a <= k < b for a, b in spans[i])))
            continue
        for a, b in reversed(spans.get(i, [])):
            t = t[:a] + t[b:]
        assert rows[i].text == t and rows[i].n_chars == len(t)
    assert D.contaminated_spans(df.where("false"), benchmark).count() == 0
    assert D.contaminated_spans(df, benchmark.where("false")).count() == 0
    assert D.decontaminate(df, benchmark.where("false")).count() == len(docs)


def test_parts_find_and_cut_what_one_search_does(spark, monkeypatch):
    docs, items, df, benchmark = frames(spark)
    rows = lambda frame: sorted((tuple(r) for r in frame.collect()), key=repr)
    spans, left = rows(D.contaminated_spans(df, benchmark)), rows(D.decontaminate(df, benchmark))
    monkeypatch.setattr(D, "BENCHMARK_BYTES", 200)
    found = D.parts(benchmark, D.PHRASE_WORDS, D.MIN_WORDS)
    assert len(found) > 2 and all(isinstance(p, str) for p in found)
    assert rows(D.contaminated_spans(df, benchmark)) == spans == brute(docs, items)
    assert rows(D.decontaminate(df, benchmark)) == left


def test_short_items(spark):
    """An item of fewer words than a phrase is one phrase, down to `least` words."""
    docs = spark.createDataFrame([(1, "see the quick brown fox jumps here"), (2, "a quick brown fox"), (3, "fox")], "doc_id long, text string")
    items = spark.createDataFrame([("The quick, brown fox jumps!",), ("Brown fox",), ("fox",), ("",), (None,)], "text string")
    found = lambda least: sorted((r.doc_id, r.span_start, r.span_end, r.span_words) for r in D.contaminated_spans(docs, items, least=least).collect())
    assert found(5) == [(1, 4, 29, 5)] and found(2) == [(1, 4, 29, 5), (2, 8, 17, 2)] and found(1) == [(1, 4, 29, 5), (2, 8, 17, 2), (3, 0, 3, 1)]
    assert {r.doc_id: r.text for r in D.decontaminate(docs, items, least=1).collect()} == {1: "see  here", 2: "a quick "}
