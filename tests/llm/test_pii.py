import math
import random
import re

import pytest

from glyphsieve.llm import pii as P

SCHEMA = "doc_id long, text string, n_chars long"
JANE, CARD = "jane.roe@mail3.example.com", "4785 3805 9239 1139"


def prose(rng, n):
    return " ".join(f"common{rng.randrange(40)}" for _ in range(n))


def corpus():
    rng, rows = random.Random(2), []
    for i in range(60):
        rows.append((i, prose(rng, 30)))
    for i in range(60, 66):  # said only beside Jane
        rows.append((i, f"{prose(rng, 12)} Zanzibar common1 {JANE}, {prose(rng, 12)}"))
    for i in range(66, 72):  # said beside the card, and now and then elsewhere
        rows.append((i, f"{prose(rng, 9)} harbour pier9 {CARD} {prose(rng, 9)}"))
    rows += [(72 + k, f"{prose(rng, 5)} the HARBOUR of pier9 {prose(rng, 5)}") for k in range(2)]
    rows += [(80, rows[60][1])] * 3 + [(81, "A zanzibar tale, Zanzibarian though"), (82, None), (83, ""), (None, f"call +1 (386) 555-3733 or 555-123-4567 now"), (84, "from 227.5.221.1 and 10.0.0.300x"), (85, prose(rng, 9000) + " " + JANE)]
    rows += [(90 + k, f"copy of one text beside {CARD.replace(' ', '')} with xylophone") for k in range(5)]  # copies prove nothing
    return rows


def brute(rows):
    """Disclosure of each term that reaches GENERALISE."""
    said = {}
    for _, text in rows:
        at = list(re.finditer(P.ENTITY, text or ""))
        for k, m in enumerate(at):
            low, high = at[k - 1].end() if k else 0, at[k + 1].start() if k + 1 < len(at) else len(text)
            before, after = text[low : m.start()], text[m.end() : high]
            b, a = (re.findall("[^\\W_]+", x.lower()) for x in (before[-P.REACH :], after[: P.REACH]))
            b, a = b[1:] if len(before) > P.REACH else b, a[:-1] if len(after) > P.REACH else a
            words = tuple(b[-P.WINDOW :] + a[: P.WINDOW])
            said.setdefault(re.sub("[^A-Za-z0-9@.]+", "", m.group()).lower(), set()).add(words)
    texts = {t for _, t in rows if t is not None}
    n, out = len(texts) + sum(map(len, said.values())), {}
    for e, passages in said.items():
        for t in {w for p in passages for w in p if len(w) >= P.MIN_CHARS}:
            both = sum(t in p for p in passages)
            if both >= P.MIN_JOINT:
                own = max(both, sum(t in re.findall("[^\\W_]+", x.lower()) for x in texts))
                d = min(1.0, math.log(both * n / (own * len(passages))) / math.log(n / len(passages)))
                if d >= P.GENERALISE:
                    out[t] = max(out.get(t, 0), d)
    return out


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, t, len(t) if t is not None else None) for i, t in corpus()], SCHEMA).selectExpr("*", "1 AS term", "2 AS gs_hard", "3 AS n_removed", "4 AS h")


def test_disclosure_equals_brute_force(df):
    got = {r.term: r.disclosure for r in P.disclosing_terms(df).collect()}
    expected = brute(corpus())
    assert got == pytest.approx(expected) and {"zanzibar", "harbour"} <= set(got)
    assert not any(t.startswith("common") or t == "xylophone" for t in got)
    assert got["zanzibar"] >= P.REMOVE > got["harbour"] >= P.GENERALISE


def test_what_is_sanitised(df):
    out = P.sanitise(df)
    assert out.columns == ["doc_id", "text", "n_chars", "term", "gs_hard", "h", "n_entities", "n_generalised", "n_removed"]
    rows = {}
    for r in out.collect():
        rows.setdefault(r.doc_id, []).append(r)
    known, terms = dict(corpus()), brute(corpus())
    assert set(rows) == {i for i, t in known.items() if t and (re.search(P.ENTITY, t) or set(re.findall("[^\\W_]+", t.lower())) & set(terms))}
    assert set(rows) >= {60, 66, 72, 80, 81, None, 84, 85, 90} and not set(rows) & {*range(60), 82, 83}
    assert len(rows[80]) == 3 and len({r.text for r in rows[80]}) == 1
    for i, got in rows.items():
        for r in got:
            assert not re.search(P.ENTITY, r.text) and r.n_chars == len(r.text)
            assert not set(re.findall("[^\\W_]+", r.text.lower())) & set(terms)
    assert rows[81][0].text == "A  tale, Zanzibarian though" and (rows[81][0].n_entities, rows[81][0].n_removed) == (0, 1)
    assert rows[None][0].text == "call [PHONE] or [PHONE] now" and rows[84][0].text == "from [ADDRESS] and 10.0.0.300x"
    assert "the [WORD] of " in rows[72][0].text and "[WORD] [NUMBER] [CARD]" in rows[66][0].text and rows[66][0].n_generalised == 2
    assert rows[85][0].text.endswith(" [EMAIL]") and len(rows[85][0].text) > 50_000


def test_empty_and_clean_tables(df):
    assert P.sanitise(df.where("false")).count() == 0
    assert P.sanitise(df.where("doc_id < 60")).count() == 0


@pytest.mark.parametrize(
    "text,expected",
    [
        ("a.b+c@x-y.example.org.", "[EMAIL]."), ("DE44 5001 0517 5407 3249 31 x", "[ACCOUNT] x"), ("4785380592391139", "[CARD]"), ("no. 123456789012345678901", "no. 123456789012345678901"),
        ("078-05-1120", "[NUMBER]"), ("(212) 555-0153", "[PHONE]"), ("+44 20 7946 0958", "[PHONE]"), ("1.2.3.4", "[ADDRESS]"), ("@ a@b @c.d", None), ("2024-05-06 12:30", None), ("v1.2.3", None),
    ],
)
def test_kinds(spark, text, expected):
    got = [r.text for r in P.sanitise(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()]
    assert got == ([expected] if expected not in (None, text) else [])


def test_terms_of_whole_texts_disclose(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 30)) for i in range(80)]
    far = " ".join(f"common{k % 40}" for k in range(60))
    rows += [(100 + i, f"{prose(rng, 20)} -- Wilhelmina, +1 (386) 555-3733, {JANE}") for i in range(8)]  # one window in many texts, behind another identifier
    rows += [(110 + i, f"Quixote {prose(rng, 5)} {far} {CARD} {prose(rng, 5)}") for i in range(5)]  # far from the identifier
    rows += [(120 + k, f"copy of one text beside 078-05-1120 with xylophone {far}") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {t for _, t in rows}
    names = lambda t: {re.sub("[^A-Za-z0-9@.]+", "", m.group()).lower() for m in re.finditer(P.ENTITY, t)}
    expected = {}
    for e in set().union(*map(names, texts)):
        held = [set(re.findall("[^\\W_]+", re.sub(P.ENTITY, " ", t).lower())) for t in texts if e in names(t)]
        for w in {w for t in held for w in t if len(w) >= P.MIN_CHARS}:
            both = sum(w in t for t in held)
            if both >= P.MIN_JOINT:
                own = max(both, sum(w in re.findall("[^\\W_]+", t.lower()) for t in texts))
                d = min(1.0, math.log(both * len(texts) / (own * len(held))) / math.log(len(texts) / len(held)))
                if d >= P.GENERALISE:
                    expected[w] = max(expected.get(w, 0), d)
    assert {"wilhelmina", "quixote"} <= set(expected) and "xylophone" not in expected
    assert {r.term: r.disclosure for r in P.disclosing_terms(df, whole=True).collect()} == pytest.approx(expected)
    out = {r.doc_id: r.text for r in P.sanitise(df, whole=True).collect()}
    assert not any(re.search("(?i)wilhelmina|quixote", t) for t in out.values()) and "xylophone" in out[120]
    every = spark.createDataFrame([(k, f"text {k} of {JANE}") for k in range(4)], "doc_id long, text string")  # an entity that all texts hold tells nothing
    assert {r.text for r in P.sanitise(every, whole=True).collect()} == {f"text {k} of [EMAIL]" for k in range(4)}


def test_the_query_removes_and_generalises_terms(spark, tmp_path):
    """A table in which terms reach either threshold: the registered query replaces what the brute-force estimate says, in documents without the entity, too."""
    rng = random.Random(8)
    word = lambda: "w" + "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = [" ".join(word() for _ in range(12)) for _ in range(400)]
    rows += [f"{word()} Zebrafinch wrote from bird.{k % 1}@mail.example to {word()} {word()}" for k in range(6)]
    rows += [f"{word()} Northfield {word()} 555-123-4567 {word()}" for _ in range(4)] + [f"Northfield {word()}" for _ in range(4)]
    rows += ["The ZEBRAFINCH is a bird.", "Nothing of the kind."]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    told = {r.term: r.disclosure for r in P.disclosing_terms(docs).collect()}
    n = len(set(rows)) + 10  # distinct texts and passages
    assert abs(told["zebrafinch"] - math.log(6 * n / (7 * 6)) / math.log(n / 6)) < 1e-12 and told["zebrafinch"] >= P.REMOVE
    assert abs(told["northfield"] - math.log(4 * n / (8 * 4)) / math.log(n / 4)) < 1e-12 and P.GENERALISE <= told["northfield"] < P.REMOVE
    out = {r.doc_id: r for r in P.query(spark, str(tmp_path)).collect()}
    assert set(out) == set(range(400, 415))
    assert not any("zebrafinch" in r.text.lower() or "Northfield" in r.text or "@" in r.text for r in out.values())
    assert all(out[i].n_removed >= 1 for i in (*range(400, 406), 414)) and all(out[i].n_generalised == 1 and "[WORD]" in out[i].text for i in range(406, 414))
    assert out[414].text == "The  is a bird."
