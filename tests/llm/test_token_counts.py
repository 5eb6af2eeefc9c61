import random
import struct

import pytest
from tokenizers import Tokenizer, models, normalizers

from glyphsieve.llm import token_counts as T

AWKWARD = ["", " ", "  x", "a", "▁", "x▁ y", "tab\t\tnew\n\n\nline ", "💩 \U0010ffff\x00", "a" * 20_000, " " * 300 + "x", "word " * 5000, "日本語"]


def reference(vocabulary, fallback, unknown):
    t = Tokenizer(models.Unigram(vocabulary, unk_id=unknown, byte_fallback=fallback))
    t.normalizer = normalizers.Sequence([normalizers.Prepend(T.SPACE), normalizers.Replace(" ", T.SPACE)])
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def whole_vocabulary(path):
    out = []
    with open(path, "rb") as f:
        for number, _, value, _, _ in T.fields(f.read()):
            if number == 1:
                got = {n: v for n, _, v, _, _ in T.fields(value)}
                out.append((got[1].decode(), struct.unpack("<f", got[2])[0] if 2 in got else 0.0))
    return out


def random_texts(seed, n, alphabets=("ab", " the", "aeiou '", "01 ", "\n\t x", "éàü日本💩 ▁", "=-_*# ", "abcdefghijklmnopqrstuvwxyz ")):
    rng = random.Random(seed)
    return ["".join(rng.choice(a) for _ in range(rng.randint(0, 40))) for a in alphabets for _ in range(n)]


def test_equals_the_public_tokenizer():
    known, counter = reference(whole_vocabulary(T.MODEL), True, 0), T.counter_of(T.MODEL)
    for t in AWKWARD + random_texts(1, 300):
        assert counter.count(t) == known(t), t[:80]


@pytest.mark.parametrize("fallback", [False, True])
def test_ties_and_unknown_characters(fallback):
    rng = random.Random(6)
    for _ in range(60):
        pieces = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(8)} - {"c"})
        pieces = [(p, -float(rng.randint(1, 3)) * len(p)) for p in pieces] + [("▁a", -2.0), ("▁▁", -2.0)] + [("▁", -1.0)] * rng.randrange(2)
        every = [("<?>", -1.0)] + [(f"<0x{i:02X}>", -1.0) for i in range(256)] * fallback + pieces
        known, counter = reference(every, fallback, 0), T.Counter(pieces, fallback)
        for t in random_texts(rng.random(), 25, ("ab c", "abcdé ", "c  a")):
            assert counter.count(t) == known(t), (t, pieces)


def test_score_equals_brute_force():
    pieces = {"a": -1.5, "ab": -2.0, "ba": -2.5, "bab": -3.0, "b": -1.0}
    counter = T.Counter(list(pieces.items()), True)

    def best(word):
        return max([pieces[word[:k]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in pieces], default=None) if word else 0.0

    rng = random.Random(1)
    for _ in range(200):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
        assert counter.solve(word)[0] == best(word)


def test_vocabularies_that_do_not_split_at_spaces_are_refused():
    with pytest.raises(ValueError):
        T.Counter([("a", -1.0), ("a▁b", -1.0)], True)


def test_frames_nulls_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(T, "_WORDS_KEPT", 5)
    known = reference(whole_vocabulary(T.MODEL), True, 0)
    rows = [(i, t, "x") for i, t in enumerate(AWKWARD)] + [(50, None, None), (None, "twice", "y"), (50, "twice", "y"), (50, "twice", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS string").selectExpr("*", "array(1) AS ids")
    out = T.count_tokens(df)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens"]
    got = out.collect()
    assert len(got) == len(rows) and all(r.n_tokens == (None if r.text is None else known(r.text)) for r in got)
    assert T.count_tokens(df.where("false")).count() == 0


def test_query_equals_the_public_tokenizer(spark):
    import pyarrow.parquet as pq

    d, known = "/root/testdata/sf0.001", reference(whole_vocabulary(T.MODEL), True, 0)
    texts = dict(zip(*(pq.read_table(f"{d}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "text"))))
    got = T.query(spark, d).collect()
    assert len(got) == len(texts) and all(r.n_tokens == known(texts[r.doc_id]) for r in got)
