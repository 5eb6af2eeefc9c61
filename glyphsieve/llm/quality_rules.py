"""Line-first cleaning: punctuation, navigation and boilerplate rules judge every line, failing lines go, and a document that loses too much text goes with them.

Everything is one narrow projection of built-in functions: no shuffle, no Python worker. oracle() gives the same rules as SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsieve.llm._common import fresh
from glyphsieve.sources.tables import read_table

#: Runs of symbols that prose doesn't have, runs of shouting, separators of menus, ends of sentences.
SYMBOLS = "[#%&$*~^=_<>{}@+]{3,}"
SHOUTS = "[!?]{2,}"
SEPARATORS = "[|»›•·]+"
ENDS = "[.!?:;…。！？\"”’»)]$"
LETTERS = "[A-Za-zÀ-\U0010ffff]"
NAVIGATION = "(?i)^(home|menu|search|log ?in|log ?out|sign (in|up|out)|register|share|tweet|print|next|previous|back to top|skip to (main )?content|read more|click here|subscribe|contact us|about us)[ .!:>»|]*$"
BOILERPLATE = "(?i)(all rights reserved|licensed under|released under the [a-z0-9 ]*license|copyright (©|[(]c[)]|[0-9]{4})|terms of (use|service)|privacy policy|cookie policy|we use cookies|enable javascript|lorem ipsum)"


@dataclass(frozen=True)
class Rules:
    """Thresholds. A line fails if: more than symbol_share of its words carry SYMBOLS, or SHOUTS; more than caps_share of at least caps_letters ASCII
    letters are capitals; it has no letter; it has fewer than fragment_words words and no end of a sentence; separators reach separator_share of its words
    (menu_separators at least); it is a NAVIGATION phrase; it has BOILERPLATE within boilerplate_words words; it has repeat_words words or more, of which
    more than repeat_share equal the word before; or the same line stood earlier in the document. A document goes if its lines keep less than keep_share of
    their characters."""

    symbol_share: float = 0.3
    caps_share: float = 0.6
    caps_letters: int = 20
    fragment_words: int = 3
    menu_separators: int = 3
    separator_share: float = 0.2
    boilerplate_words: int = 20
    repeat_words: int = 8
    repeat_share: float = 0.3
    keep_share: float = 0.5


def _passes(s: Column, r: Rules) -> Column:
    def runs(pattern: str) -> Column:
        return F.size(F.split(s.t, pattern)) - 1

    n = F.size(s.words)
    same = F.size(F.filter(s.words, lambda x, i: (i > 0) & (x == F.get(s.words, i - 1))))
    letters = F.length(F.regexp_replace(s.t, "[^A-Za-z]+", ""))
    capitals = F.length(F.regexp_replace(s.t, "[^A-Z]+", ""))
    return (
        s.t.rlike(LETTERS)
        & ~((n < r.fragment_words) & ~s.t.rlike(ENDS))
        & ~((n <= r.boilerplate_words) & s.t.rlike(BOILERPLATE))
        & ~((F.length(s.t) <= 40) & s.t.rlike(NAVIGATION))
        & (runs(SYMBOLS) <= r.symbol_share * n)
        & (runs(SHOUTS) <= r.symbol_share * n)
        & ~((runs(SEPARATORS) >= r.menu_separators) & (runs(SEPARATORS) >= r.separator_share * n))
        & ~((letters >= r.caps_letters) & (capitals > r.caps_share * letters))
        & ~((n >= r.repeat_words) & (same > r.repeat_share * n))
    )


def clean_lines(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs that keep enough text: their columns, with text (and n_chars, if there) those of the lines kept, then lines_total and lines_removed.

    Lines are what stands between newlines; those kept stay as they are, joined by newlines. Blank lines go without counting as a loss. A null, empty or
    blank text keeps nothing, and its document is rejected. Equal rows are judged alike, each by itself; an empty table gives an empty result. Columns of
    docs named lines_total or lines_removed are replaced; all others are carried. A very long line is judged whole.
    """
    kept = fresh(docs, "gs_kept")
    lines = F.split("text", "\n")
    parts = F.filter(F.transform(F.array_distinct(lines), lambda x: F.struct(x.alias("l"), F.trim(x).alias("t"))), lambda s: s.t != "")
    parts = F.transform(parts, lambda s: F.struct(s.l.alias("l"), s.t.alias("t"), F.split(s.t, "[ \t]+").alias("words")))
    parts = F.transform(F.filter(parts, lambda s: _passes(s, rules)), lambda s: s.l)
    own = [c for c in docs.columns if c.lower() not in ("lines_total", "lines_removed")]
    # the one-row generator keeps the optimizer from evaluating the rules once for each use of their result
    judged = docs.select(*[F.col(f"`{c}`") for c in own], F.explode(F.array(parts)).alias(kept))
    whole = F.length(F.regexp_replace("text", "\n", ""))
    judged = judged.where((F.size(kept) > 0) & (F.length(F.array_join(kept, "")) >= rules.keep_share * whole))
    new = {"text": F.array_join(kept, "\n"), "n_chars": F.length(F.array_join(kept, "\n")).cast("long")}
    return judged.select(
        *[new.get(c.lower(), F.col(f"`{c}`")).alias(c) for c in own],
        F.size(lines).alias("lines_total"),
        (F.size(lines) - F.size(kept)).alias("lines_removed"),
    )


def oracle(rules: Rules = Rules(), source: str = "documents") -> str:
    """DuckDB SQL for clean_lines(documents).select(doc_id, text, n_chars, lines_total, lines_removed)."""
    r = rules

    def lit(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def runs(pattern: str) -> str:
        return f"(len(regexp_split_to_array(t, {lit(pattern)})) - 1)"

    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM {source}),
raw AS (SELECT rid, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM docs WHERE text IS NOT NULL),
totals AS (SELECT rid, count(*) AS lines_total, sum(length(l)) AS whole FROM raw GROUP BY rid),
firsts AS (SELECT rid, l, min(k) AS k FROM raw GROUP BY rid, l),
trimmed AS (SELECT rid, l, k, trim(l) AS t FROM firsts WHERE trim(l) <> ''),
worded AS (SELECT *, regexp_split_to_array(t, '[ ' || chr(9) || ']+') AS w FROM trimmed),
measured AS (SELECT *, len(w) AS n, length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) AS letters, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS capitals,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS same FROM worded),
passed AS (SELECT * FROM measured WHERE regexp_matches(t, {lit(LETTERS)})
  AND NOT (n < {r.fragment_words} AND NOT regexp_matches(t, {lit(ENDS)}))
  AND NOT (n <= {r.boilerplate_words} AND regexp_matches(t, {lit(BOILERPLATE)}))
  AND NOT (length(t) <= 40 AND regexp_matches(t, {lit(NAVIGATION)}))
  AND {runs(SYMBOLS)} <= {r.symbol_share} * n
  AND {runs(SHOUTS)} <= {r.symbol_share} * n
  AND NOT ({runs(SEPARATORS)} >= {r.menu_separators} AND {runs(SEPARATORS)} >= {r.separator_share} * n)
  AND NOT (letters >= {r.caps_letters} AND capitals > {r.caps_share} * letters)
  AND NOT (n >= {r.repeat_words} AND same > {r.repeat_share} * n)),
joined AS (SELECT rid, string_agg(l, chr(10) ORDER BY k) AS text, sum(length(l)) AS keeps, count(*) AS n_kept FROM passed GROUP BY rid)
SELECT d.doc_id, j.text, CAST(length(j.text) AS BIGINT) AS n_chars, CAST(t.lines_total AS INTEGER) AS lines_total,
  CAST(t.lines_total - j.n_kept AS INTEGER) AS lines_removed
FROM joined j JOIN totals t USING (rid) JOIN docs d USING (rid) WHERE j.keeps >= {r.keep_share} * t.whole"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    return clean_lines(docs).select("doc_id", "text", "n_chars", "lines_total", "lines_removed")
