import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from glyphsieve.llm import line_dedup as L

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edited(rng, s, edits, alphabet):
    s = list(s)
    for _ in range(edits):
        i = rng.randrange(len(s) + 1)
        s[i : i + rng.choice((0, 1, 1))] = rng.choice(("", rng.choice(alphabet), rng.choice(alphabet)))
    return "".join(s)


@pytest.mark.parametrize("limit", [1, 2, 3, 5])
def test_distance_equals_brute_force(limit):
    rng = random.Random(limit)
    left = ["".join(rng.choice("abé日") for _ in range(rng.randint(0, 40))) for _ in range(600)]
    right = [edited(rng, s or "a", rng.randint(0, limit + 2), "abé日") for s in left]
    expected = [min(limit + 1, L._plain_distance(x, y)) for x, y in zip(left, right)]
    assert L.bounded_distances(left, right, limit).tolist() == expected


def candidates(lines, threshold, block=1 << 30):
    """The pairs of lines that the join would verify, with keys in blocks of so many lines."""
    data, offsets = L.codes(pa.array(lines))
    key, row = L.segment_keys(data, offsets, threshold)
    bits = L.parities(data, offsets).view(np.int64)[row]
    groups = {}
    for k, h, b in sorted(zip((key >> 1).tolist(), row.tolist(), zip(key.tolist(), bits.tolist()))):
        groups.setdefault(k, []).append((h, *b))
    rows = []
    for g, members in groups.items():
        n = -(-len(members) // block)
        rows += [(g, min(i // block, o), max(i // block, o), k, h, b, i // block) for i, (h, k, b) in enumerate(members) for o in range(n)]
    rows.sort()
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 97])], names=list("gpqkhbo")) for i in range(0, len(rows), 97)]
    return {p for b in L._pairs_of_keys(threshold, iter(batches)) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_no_pair_escapes_the_segments(threshold):
    rng = random.Random(threshold)
    lines = ["".join(rng.choice("ab") for _ in range(rng.randint(8, 14))) for _ in range(250)]
    lines = sorted({*lines, *(edited(rng, s, rng.randint(1, threshold), "ab") for s in lines)} - {""})
    lines = [s for s in lines if len(s) > threshold]
    found = candidates(lines, threshold)
    for i in range(len(lines)):
        for j in range(i + 1, len(lines)):
            if L._plain_distance(lines[i], lines[j]) <= threshold:
                assert (i, j) in found, (lines[i], lines[j])
    assert candidates(lines, threshold, 7) == found


def test_an_edit_changes_few_parities():
    rng = random.Random(3)
    for _ in range(3000):
        a = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 20)))
        b = edited(rng, a, rng.randint(0, 3), "abcdefghij")
        c = edited(rng, b, 1, "xyz")
        x, y, *_ = L.parities(*L.codes(pa.array([a, b, c, "", "x"]))).tolist()
        assert (x ^ y).bit_count() <= L._BITS_AN_EDIT * L._plain_distance(a, b)
        assert [x, y] == [L.parities(*L.codes(pa.array([t]))).tolist()[0] for t in (a, b)]


def test_few_candidates_share_a_segment_only():
    rng = random.Random(8)
    lines = sorted({"a common beginning " + "".join(rng.choice("abcdefghijklmnop") for _ in range(40)) for _ in range(300)})
    assert len(candidates(lines, 2)) < 20


def corpus():
    rng = random.Random(5)
    base = [" ".join(rng.choice(("ström", "über", "the", "of", "line", "corpus", "ñandú", "text", "bird")) for _ in range(rng.randint(4, 12))) for _ in range(60)]
    rows = []
    for d in range(60):
        lines = [edited(rng, rng.choice(base), rng.choice((0, 0, 1, 2, 3)), "abcé ") for _ in range(rng.randint(1, 5))]
        rows.append((d, "\n".join(lines), "en", "s", 0))
    long = " ".join(str(i) for i in range(600))
    return rows + [(100, None, None, None, None), (None, base[0], "x", "y", 1), (101, "", "en", "s", 0), (102, "\n\n \nIt.\nIt.", "en", "s", 0), (103, long, "", "", 0), (104, long[:-1] + "x", "", "", 0), (3, rows[3][1], "en", "s", 0)]


def run_oracle(df, **kw):
    c = duckdb.connect()
    documents_table = df.toPandas()  # noqa: F841
    c.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM documents_table")
    return sorted(c.execute(f"SELECT doc_id, line_no, first_doc_id, first_line_no, distance FROM ({L.oracle(**kw)})").fetchall())


def test_equals_sql_on_awkward_rows(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    got = sorted(tuple(r) for r in L.repeated_lines(df).select("doc_id", "line_no", "first_doc_id", "first_line_no", "distance").collect())
    assert got == run_oracle(df) and {d for *_, d in got} == {0, 1, 2}
    upper = df.withColumnsRenamed({"text": "Text", "doc_id": "Doc_ID"})
    assert sorted(tuple(r) for r in L.repeated_lines(upper).select("doc_id", "line_no", "first_doc_id", "first_line_no", "distance").collect()) == got
    assert (104, 0, 103, 0, 1) in got


def test_drop_keeps_columns_and_first_occurrences(spark):
    rows = [
        (1, "A first line of prose here.\nIt.\nA second line of prose.", "en", "s", 0),
        (2, "A second line of proze.\nIts own line, long enough.\nIt.", "en", "s", 0),
        (3, "A first line of prose here!", "en", "s", 0),
        (4, None, None, None, None),
        (5, "", "en", "s", 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS gs_left", "2 AS line_no", "3 AS h")
    out = {r.doc_id: r for r in L.drop_repeated_lines(df).collect()}
    assert L.drop_repeated_lines(df).columns == df.columns
    assert set(out) == {1, 2, 4, 5}
    assert out[1].text == rows[0][1] and out[2].text == "Its own line, long enough." and out[2].n_chars == 26 and out[5].text == ""
    upper = df.withColumnsRenamed({"text": "Text", "n_chars": "N_Chars", "doc_id": "DOC_ID"})
    assert L.drop_repeated_lines(upper).columns == upper.columns and {r[0]: (r[1], r[4]) for r in L.drop_repeated_lines(upper).collect()} == {k: (r.text, r.n_chars) for k, r in out.items()}
    assert L.drop_repeated_lines(df.where("false")).count() == 0


def test_very_long_lines(spark):
    long = " ".join(str(i) for i in range(30_000))
    df = spark.createDataFrame([(1, long, "", "", 0), (2, long[:-1] + "xy", "", "", 0), (3, long[::-1], "", "", 0)], SCHEMA)
    assert [tuple(r) for r in L.repeated_lines(df).collect()] == [(2, 0, 1, 0, 2)]


def test_an_edit_needs_longer_lines(spark):
    with pytest.raises(ValueError):
        L.repeated_lines(spark.createDataFrame(corpus(), SCHEMA), threshold=3, per_edit=3)


def test_hot_keys_are_compared_in_blocks(spark, monkeypatch):
    """Hundreds of lines under one key, in blocks of 16, found as in one."""
    rng = random.Random(2)
    texts = ["the same beginning of all, " + "".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(300)]
    texts += [edited(rng, t, 1, "xyz") for t in texts[:60]]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], SCHEMA)
    monkeypatch.setattr(L, "BLOCK", 16)
    monkeypatch.setattr(L, "_PAIRS_AT_ONCE", 50)
    got = sorted(tuple(r) for r in L.repeated_lines(df).select("doc_id", "line_no", "first_doc_id", "first_line_no", "distance").collect())
    assert got == run_oracle(df) and len(got) >= 60


def test_short_lines_repeat_too(spark):
    rng = random.Random(9)
    rows = [(d, "\n".join("".join(rng.choice("abcdé.") for _ in range(rng.choice((1, 2, 3, 5, 7, 8, 9, 14, 15, 16)))) for _ in range(6)), "en", "s", 0) for d in range(25)]
    rows += [(40, "Of, edti oner.\nIt\n\n ", "en", "s", 0), (41, "Of, edti oner.\nIt\nAt", "en", "s", 0), (42, "Of, edti ones!\nOf, edti oner!", "en", "s", 0), (43, "It was.\nIt was", "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    lines = [(d, k, x) for d, t, *_ in sorted(rows) for k, x in enumerate(t.split("\n")) if x.strip()]
    expected = []
    for i, (d, k, x) in enumerate(lines):
        near = [(a, b, L._plain_distance(x, y)) for a, b, y in lines[:i] if L._plain_distance(x, y) <= min(L.THRESHOLD, min(len(x), len(y)) // L.CHARS_PER_EDIT)]
        expected += [(d, k, *near[0])] if near else []
    assert sorted(tuple(r) for r in L.repeated_lines(df).select("doc_id", "line_no", "first_doc_id", "first_line_no", "distance").collect()) == expected == run_oracle(df)
    assert {(41, 0, 40, 0, 0), (41, 1, 40, 1, 0), (42, 1, 40, 0, 1)} <= set(expected) and not [x for x in expected if x[:2] == (42, 0) or x[0] == 43]
    left = {r.doc_id: r.text for r in L.drop_repeated_lines(df.where("doc_id >= 40")).collect()}
    assert left == {40: "Of, edti oner.\nIt\n\n ", 41: "At", 42: "Of, edti ones!", 43: "It was.\nIt was"}


def test_many_repeats_in_a_long_document(spark):
    rng = random.Random(6)
    lines = ["".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(30)) for _ in range(20_000)]
    df = spark.createDataFrame([(1, "\n".join(lines), "", "", 0), (2, "\n".join([*lines, "One of its own, and the last one here."]), "", "", 0)], SCHEMA)
    left = {r.doc_id: r.text for r in L.drop_repeated_lines(df.where("doc_id = 2").union(df.where("doc_id = 1"))).collect()}
    assert left[2] == "One of its own, and the last one here."


def test_empty_table(spark):
    assert L.repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0 and L.drop_repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0
