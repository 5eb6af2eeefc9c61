import random
import re

import numpy as np
import pyarrow as pa
import pytest

from glyphsieve.llm import minhash_dedup as M
from glyphsieve.llm._words import WORD, offsets_of, words
from glyphsieve.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = ["", None, "One", "a b", "Ärger über ¿qué? “quoted”—dash… x", "日本語、テキスト", "tab\tnew\nline", "a b", "İstanbul ǅ", "💩 x_y", "  ", "x" * 5000]


def passage(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def corpus(seed=3, n=60):
    rng, rows = random.Random(seed), []
    for g in range(n):
        base = passage(rng, rng.randint(40, 300))
        for _ in range(rng.choice((1, 1, 2, 4))):
            copy = [w if rng.random() > 0.03 else f"e{rng.randrange(9999)}" for w in base]
            rows.append((len(rows), " ".join(copy), "en", f"s{g}", 0))
    return rows


def test_words_equal_the_expression():
    text = pa.array(AWKWARD, pa.large_string())
    h, starts, ends, first, folded = words(text)
    data = b"".join((s or "").encode() for s in folded.to_pylist())
    seen = {}
    for i, s in enumerate(AWKWARD):
        got = [data[starts[k] : ends[k]].decode() for k in range(first[i], first[i + 1])]
        assert got == re.findall(WORD, folded[i].as_py() or ""), s
        for k, w in zip(range(first[i], first[i + 1]), got):
            assert seen.setdefault(w, h[k]) == h[k]
    assert len(set(seen.values())) == len(seen)
    assert offsets_of(text.slice(2, 3))[-1] == 3 + 3 + len(AWKWARD[4].encode())


def test_all_pairs_within_the_distance_are_found(spark):
    sigs = spark.createDataFrame(corpus(), SCHEMA)
    sigs = M.signatures(sigs).toPandas()
    rng = np.random.default_rng(1)
    matrix = np.stack([np.frombuffer(s, np.uint8) for s in sigs.sig])
    extra = []
    for row in matrix[:40]:  # at every distance, about the limit too
        changed = row.copy()
        places = rng.permutation(M.HASHES)[: rng.integers(0, 2 * M.MAX_DISTANCE)]
        changed[places] += rng.integers(1, 256, len(places)).astype(np.uint8)
        extra.append(changed)
    matrix = np.concatenate([matrix, extra])
    frame = spark.createDataFrame([(i, bytearray(m.tobytes())) for i, m in enumerate(matrix)], "id long, sig binary")
    for limit in (0, 5, M.MAX_DISTANCE):
        expected = {(i, j) for i in range(len(matrix)) for j in range(i + 1, len(matrix)) if (matrix[i] != matrix[j]).sum() <= limit}
        assert {tuple(r) for r in M.hamming_join(frame, limit).collect()} == expected
        connecting = {tuple(r) for r in M.hamming_join(frame, limit, every=False).collect()}
        assert connecting <= expected and roots(connecting) == roots(expected)
    with pytest.raises(ValueError):
        M.hamming_join(frame, M.MAX_DISTANCE + 1)


def roots(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent}


def resemblance(x, y):
    x, y = ({*zip(w, w[1:])} for w in (re.findall(WORD, x.lower()), re.findall(WORD, y.lower())))
    return len(x & y) / len(x | y)


def test_recall_against_resemblance_and_clean_documents(spark):
    rows = corpus(8, 80)
    got = {r.doc_id: r.group_id for r in M.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = total = 0
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if rows[i][3] == rows[j][3]:
                if resemblance(rows[i][1], rows[j][1]) >= 0.8:
                    total += 1
                    found += got.get(i) is not None and got.get(i) == got.get(j)
            else:
                assert got.get(i) is None or got.get(i) != got.get(j)
    assert total > 50 and found >= 0.98 * total


def test_awkward_rows_and_columns(spark):
    words_ = " ".join(passage(random.Random(1), 80))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(AWKWARD)] + [(50, words_, None, None, None), (51, words_.upper() + "!", "", "", 1), (51, words_.upper() + "!", "", "", 1), (None, words_, "", "", 1), (52, words_, "", "", 2)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS gs_doc_id", "3 AS sig", "4 AS a")
    assert {tuple(r) for r in M.near_groups(df).collect()} == {(3, 3), (7, 3), (50, 50), (51, 50), (52, 50)}
    out = M.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in out.collect()) == [-1, *(i for i in range(len(AWKWARD)) if i != 7), 50]
    assert M.near_groups(df.where("false")).count() == 0 and M.drop_near_duplicates(df.where("false")).count() == 0


def test_one_id_with_two_texts_joins_their_groups(spark):
    x, y = (" ".join(passage(random.Random(k), 80)) for k in (1, 2))
    rows = [(7, x, "", "", 0), (7, y, "", "", 0), (8, x, "", "", 0), (9, y, "", "", 0)]
    assert {tuple(r) for r in M.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()} == {(7, 7), (8, 7), (9, 7)}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5), (3, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in roots([p for p in pairs if p[0] != p[1]]).items()}


def test_hot_chunks_are_compared_in_blocks(spark, monkeypatch):
    """Hundreds of signatures under the same masked chunks, most of them far from one another, in blocks of 7."""
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 256, (150, M.HASHES), dtype=np.uint8)
    sig[:, : M.CHUNK] = 5
    sig[100:] = sig[:50]
    for r in range(100, 150):
        sig[r, rng.choice(np.arange(M.CHUNK, M.HASHES), 20, replace=False)] ^= 1
    df = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sig)], "id long, sig binary")
    near = {(i, j) for i in range(150) for j in range(i + 1, 150) if (sig[i] != sig[j]).sum() <= M.MAX_DISTANCE}
    monkeypatch.setattr(M, "BLOCK", 7)
    got = [tuple(r) for r in M.hamming_join(df).collect()]
    assert set(got) == near and len(got) == len(near) >= 50
    some = {tuple(r) for r in M.hamming_join(df, every=False).collect()}
    assert some <= near and components_of(some) == components_of(near)


def components_of(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in sorted(edges):
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in root}


def test_very_long_texts(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:150_000], "inserted", *words[150_000:]])), (3, " ".join(reversed(words)))]
    assert {tuple(r) for r in M.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {(1, 1), (2, 1)}
