import random
import re

import pytest
import tiktoken

import corpus_pipeline as P
from glyphsieve.llm import bpe
from glyphsieve.llm import line_dedup as L
from glyphsieve.llm._words import WORD

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(rng):
    sentence = lambda: " ".join(f"word{rng.randrange(3000)}" for _ in range(rng.randint(6, 14))) + "."
    items = [" ".join(f"item{rng.randrange(300)}" for _ in range(30)) + "." for _ in range(5)]
    shared = [sentence() for _ in range(6)]
    rows = []
    for i in range(60):
        lines = [sentence() for _ in range(rng.randint(3, 9))]
        if i % 4 == 0:
            lines.insert(rng.randrange(len(lines)), rng.choice(shared))
        if i % 7 == 0:
            lines.insert(1, rng.choice(items))
        if i % 5 == 0:
            lines += ["Read more", "All rights reserved."]
        rows.append((i, "\n".join(lines)))
    rows += [(100 + k, rows[k][1].replace(" ", "  ", 1)) for k in range(5)]  # near copies
    rows += [(200, "BUY NOW!! BEST!! PRICE!! EVER!! TODAY!!"), (201, None), (202, ""), (203, items[0])]
    return [(i, t, "en", f"s{i % 3}", len(t) if t is not None else None) for i, t in rows], items


def brute_lines(docs):
    """What line dedup leaves, comparing every two lines."""
    seen, out = [], []
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        left, lines = [], d["text"].split("\n")
        for line in lines:
            if not line.strip() or not any(x == line or abs(len(x) - len(line)) <= L.THRESHOLD and L._plain_distance(x, line) <= min(L.THRESHOLD, min(len(x), len(line)) // L.CHARS_PER_EDIT) for x in seen):
                left.append(line)
            seen.append(line)
        if "".join(left).strip() or left == lines:
            out.append(d | {"text": "\n".join(left), "n_chars": len("\n".join(left)) if left != lines else d["n_chars"]})
    return out


def brute_groups(docs):
    """One of each set of documents whose word pairs agree by 0.9, directly or through others."""
    pairs = {d["doc_id"]: {*zip(w, w[1:])} for d in docs for w in [re.findall(WORD, d["text"].lower())]}
    gone, ids = set(), sorted(pairs)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if pairs[i] and len(pairs[i] & pairs[j]) >= 0.9 * len(pairs[i] | pairs[j]):
                gone.add(j)
    return [d for d in docs if d["doc_id"] not in gone]


def brute_spans(docs, items, n=8):
    phrases = {tuple(w[i : i + n]) for t in items for w in [re.findall(WORD, t.lower())] for i in range(len(w) - n + 1)}
    out = []
    for d in docs:
        at, text = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(WORD, d["text"])], d["text"]
        hit = {k for i in range(len(at) - n + 1) if tuple(x[2] for x in at[i : i + n]) in phrases for k in range(i, i + n)}
        runs = [(i, max(k for k in range(i, len(at)) if all(x in hit for x in range(i, k + 1)))) for i in sorted(hit) if i - 1 not in hit]
        for a, b in reversed(runs):
            text = text[: at[a][0]] + text[at[b][1] :]
        if re.search(WORD, text) or not hit:
            out.append(d | ({"text": text, "n_chars": len(text)} if hit else {}))
    return out


@pytest.fixture()
def tables(spark, tmp_path):
    rows, items = corpus(random.Random(11))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, items


def as_dicts(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda d: d["doc_id"])


def test_stages_equal_brute_force(spark, tables):
    d, rows, items = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    steps = dict(P.STAGES)
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None
    cleaned = steps["quality_rules"](spark, docs, d).cache()
    assert cleaned.columns == docs.columns
    good = as_dicts(cleaned)
    assert {x[0] for x in rows} - {x["doc_id"] for x in good} == {200, 201, 202}
    assert not any("Read more" in x["text"] for x in good)
    expected = brute_lines(good)
    deduped = steps["line_dedup"](spark, cleaned, d)
    assert deduped.columns == docs.columns and as_dicts(deduped) == expected
    near = steps["minhash_dedup"](spark, cleaned, d)  # on its own input: line dedup leaves no copies here
    assert near.columns == docs.columns and as_dicts(near) == brute_groups(good) and len(brute_groups(good)) < len(good)
    left = steps["decontaminate"](spark, cleaned, d)
    assert left.columns == docs.columns and as_dicts(left) == brute_spans(good, items)
    whole = brute_spans(brute_groups(expected), items)
    encoding = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.vocabulary(f"{bpe.TOKENIZERS}/{bpe.RANKS}").ranks, special_tokens={})
    got = as_dicts(P.run(spark, d))
    assert [{k: x[k] for k in docs.columns} for x in got] == whole
    assert all(x["ids"] == encoding.encode_ordinary(x["text"]) and x["exact"] for x in got)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
