import random

import numpy as np
import pytest
import tiktoken

from glyphsieve.llm import bpe as B

PATHS = [f"{B.TOKENIZERS}/byte_bpe_50k.tiktoken", f"{B.TOKENIZERS}/byte_bpe_multi_50k.tiktoken"]
AWKWARD = ["", " ", "  x", "a", "<|endoftext|>", "I'm we'll", "٣٤ ²½", "tab\t\tnew\n\n\nline ", "💩 \U0010ffff\x00", "a" * 20_000, "ab" * 3000, " " * 1000 + "x", "word " * 5000]


def reference(path):
    return tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=B.vocabulary(path).ranks, special_tokens={})


def random_texts(seed, n):
    rng = random.Random(seed)
    alphabets = ("ab", " the", "aeiou '", "01 ", "\n\t x", "éàü日本💩 ", "=-_*# ", "abcdefghijklmnopqrstuvwxyz ")
    return ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["".join(rng.choice(a) for _ in range(40)) for a in alphabets for _ in range(100)]


@pytest.mark.parametrize("path", PATHS)
def test_equals_the_public_tokenizer(path):
    texts = AWKWARD + random_texts(1, 3000)
    encoder, known = B.Encoder(path), reference(path)
    for part in (texts[:500], texts[500:]):  # words met before, too
        ids, n = encoder.encode(part)
        at = np.concatenate([[0], np.cumsum(n)])
        for k, t in enumerate(part):
            assert ids[at[k] : at[k + 1]].tolist() == known.encode_ordinary(t), t[:80]


def test_shared_prefixes_are_computed_once(monkeypatch):
    v = B.vocabulary(PATHS[0])
    nodes = set()
    words = sorted({w.encode() for t in random_texts(2, 400) for w in B._words(t)})
    whole = [w for w in words if w not in v.ranks]
    calls = []
    v.encode_words(words)  # from here on, no step goes over links
    steps = v._steps

    class Counted(dict):
        def get(self, key, default=None):
            calls.append(key)
            return steps.get(key, default)

    monkeypatch.setattr(v, "_steps", Counted(steps))
    v.encode_words(words)
    for w in whole:
        nodes |= {w[:k] for k in range(1, len(w) + 1)}
    assert len(calls) == len(nodes)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(B, "_WORDS_KEPT", 50)
    monkeypatch.setattr(B, "_PAIRS_KEPT", 20)
    encoder, known = B.Encoder(PATHS[0]), reference(PATHS[0])
    for t in random_texts(3, 200):
        assert encoder.encode([t])[0].tolist() == known.encode_ordinary(t)


def test_frames_nulls_and_clashing_names(spark):
    known = reference(PATHS[0])
    rows = [(i, t, "x", 1) for i, t in enumerate(AWKWARD)] + [(50, None, None, 2), (None, "twice", "y", 3), (50, "twice", "y", 3), (50, "twice", "y", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, IDS_ long").selectExpr("*", "array(1) AS n_tokens", "1 AS decoded")
    out = B.encode(df)
    assert out.columns == ["doc_id", "text", "IDS_", "decoded", "ids", "n_tokens", "exact"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        if r.text is None:
            assert (r.ids, r.n_tokens, r.exact) == (None, None, None)
        else:
            assert r.ids == known.encode_ordinary(r.text) and r.n_tokens == len(r.ids) and r.exact
    back = B.decode(out)
    assert all(r.decoded == r.text for r in back.collect()) and back.columns[-1] == "decoded"
    assert B.encode(df.where("false")).count() == 0 and B.decode(out.where("false")).count() == 0


def test_decoding_ids_of_no_vocabulary(spark):
    df = spark.createDataFrame([(1, [-1]), (2, [60_000]), (3, [None]), (4, []), (5, None), (6, [0xA8 + 10])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in B.decode(df).collect()}
    assert got[1] is got[2] is got[3] is got[5] is None and got[4] == ""


def test_query_equals_the_public_tokenizer(spark):
    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.001"
    texts = dict(zip(*(pq.read_table(f"{d}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "text"))))
    known = reference(PATHS[0])
    got = B.query(spark, d).collect()
    assert len(got) == len(texts) and all(r.ids == known.encode_ordinary(texts[r.doc_id]) and r.exact for r in got)
