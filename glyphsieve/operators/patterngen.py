"""Patterns made from data: tokens, templates, stratified choice, literals of given lengths that occur, and that don't.

Where the order must be a shuffled one, it is that of an MD5 of the seed and the value: the same on any number of executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphsieve.functions.text import complexity
from glyphsieve.operators.index import slices
from glyphsieve.sources.files import kept

MAX_PATTERNS = 200
SEED = 13


def words(c: Column) -> Column:
    """Runs of letters and digits of three or more, not digits alone."""
    return F.filter(F.split(c, "[^A-Za-z0-9]+"), lambda x: (F.length(x) >= 3) & ~x.rlike("^[0-9]+$"))


def shuffled(c: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), c))


def tokenize(rows: DataFrame, text_column: str) -> DataFrame:
    """(token, n): words and how often each occurs."""
    return rows.select(F.explode(words(F.col(text_column))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def sample_tokens(rows: DataFrame, position: Column, fields: list[str], max_lines: int = 20_000, max_tokens: int = 10_000, seed: int = SEED) -> DataFrame:
    """(position, i, token): the words of one field, chosen by a hash, of each of the first max_lines rows, up to the row with which max_tokens are reached."""
    pick = F.pmod(F.conv(F.left(shuffled(F.col("p").cast("string"), seed), F.lit(7)), 16, 10).cast("int"), F.lit(len(fields)))
    first = rows.select(position.alias("p"), F.array(*[F.col(c).cast("string") for c in fields]).alias("fields")).orderBy("p").limit(max_lines)
    lines = first.select("p", words(F.coalesce(F.get("fields", pick), F.lit(""))).alias("words"))
    before = F.coalesce(F.sum(F.size("words")).over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # max_lines rows at most
    kept = lines.withColumn("before", before).where(F.col("before") < max_tokens)
    return kept.select(F.col("p").alias("position"), F.posexplode("words").alias("i", "token"))


def distinct_tokens(rows: DataFrame, text_column: str, position: Column) -> DataFrame:
    """(token, position): of tokens that differ in case only, the first."""
    at = rows.select(position.alias("p"), F.posexplode(words(F.col(text_column))).alias("i", "token"))
    return first_of_each(at).select("token", F.col("p").alias("position"))


def first_of_each(at: DataFrame) -> DataFrame:
    """at(p, i, token): of tokens that differ in case only, the first."""
    return at.groupBy(F.lower("token").alias("k")).agg(F.min(F.struct("p", "i", "token")).alias("f")).select("f.*")


def shuffle_ranks(tokens: DataFrame, seed: int = SEED) -> DataFrame:
    """(token, rn, n): distinct tokens(token) with their rank from 1 in shuffled order, and how many there are."""
    ranked = rank_all(tokens.select("token", F.concat(shuffled(F.col("token"), seed), "token").alias("_h")), "_h")
    return ranked.select("token", "rn", F.lit(ranked.count()).cast("long").alias("n"))


def _templates(t: Column) -> list[Column]:
    """What becomes of one token, in order; null where it's too short."""
    n = F.length(t)
    half, q1, q3 = (F.floor(n * k / d).cast("int") for k, d in ((1, 2), (1, 4), (3, 4)))
    cut = lambda a, b: F.substring(t, a + 1, b - a)
    a = F.lit("%")
    made = [
        (0, "exact", t), (0, "contains", F.concat(a, t, a)), (0, "prefix", F.concat(t, a)), (0, "suffix", F.concat(a, t)),
        (5, "underscore", F.concat(a, F.left(t, half), F.lit("_"), cut(half + 1, n), a)), (5, "split-mid", F.concat(F.left(t, half), a, cut(half, n))),
        (8, "two-literal-short", F.concat(a, F.left(t, q1), a, cut(q3, n), a)), (8, "double-underscore", F.concat(F.left(t, q1), F.lit("_"), cut(q1 + 1, q3), F.lit("_"), cut(q3 + 1, n))),
        (4, "short-gap", F.concat(a, F.left(t, F.lit(2)), F.lit("_"), F.right(t, F.lit(2)), a)),
    ]
    return [F.when(n >= least, F.struct(F.lit(0).alias("part"), F.col("rn"), F.lit(k).alias("k"), p.alias("pattern"), F.concat(F.lit(f"{name}:"), t).alias("description"))) for k, (least, name, p) in enumerate(made)]


def _first_patterns(cells: DataFrame) -> DataFrame:
    """(pattern, description, part, rn, k): of equal patterns the one made first."""
    return cells.groupBy("pattern").agg(F.min(F.struct("part", "rn", "k", "description")).alias("f")).select("pattern", "f.description", "f.part", "f.rn", "f.k")


def template_patterns(ranked: DataFrame, single: int = 20) -> DataFrame:
    """All templates of tokens(token, rn), then those of the first letters of the first `single`."""
    t = F.col("token")
    whole = ranked.select(F.explode(F.filter(F.array(*_templates(t)), lambda x: x.isNotNull())).alias("c")).select("c.*")
    first = F.left(t, F.lit(1))
    two = [("single-char-contains", F.concat(F.lit("%"), first, F.lit("%"))), ("underscore-heavy", F.concat(F.lit("_"), first, F.lit("_%")))]
    cells = F.array(*[F.struct(F.lit(2).alias("part"), F.col("rn"), F.lit(k).alias("k"), p.alias("pattern"), F.concat(F.lit(f"{name}:"), t).alias("description")) for k, (name, p) in enumerate(two)])
    return whole.unionByName(ranked.where(F.col("rn") <= single).select(F.explode(cells).alias("c")).select("c.*"))


def pair_patterns(ranked: DataFrame, pairs: int | None = None) -> DataFrame:
    """Templates of pairs of tokens(token, rn, n), the first with the last and so on: n // 2 of them, or `pairs` at most."""
    x, y = ranked.select(F.col("token").alias("x"), "rn", "n"), ranked.select(F.col("token").alias("y"), (F.col("n") + 1 - F.col("rn")).alias("rn"))
    both = x.where(F.col("rn") <= F.floor(F.col("n") / 2)).join(y, "rn")
    both = both if pairs is None else both.where(F.col("rn") <= pairs)
    a, b, any_ = F.col("x"), F.col("y"), F.lit("%")
    made = [
        ("two-literals", F.concat(any_, a, any_, b, any_)), ("bridge", F.concat(F.left(a, F.lit(3)), any_, F.right(b, F.lit(3)))),
        ("short-bridge", F.concat(any_, F.left(a, F.lit(2)), F.lit("_"), F.right(b, F.lit(2)), any_)),
    ]
    cells = [F.struct(F.lit(1).alias("part"), F.col("rn"), F.lit(k).alias("k"), p.alias("pattern"), F.concat(F.lit(f"{name}:"), a, F.lit("+"), b).alias("description")) for k, (name, p) in enumerate(made)]
    return both.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def generate_patterns(tokens: DataFrame, seed: int = SEED) -> DataFrame:
    """(pattern, description) of the templates of all tokens(token), and of the first letters of the first twenty in shuffled order; of equal patterns the first."""
    return _first_patterns(template_patterns(shuffle_ranks(tokens, seed))).select("pattern", "description")


def generate_pair_patterns(tokens: DataFrame, seed: int = SEED) -> DataFrame:
    """(pattern, description) of mirrored pairs of all tokens(token) in shuffled order; of equal patterns the first.

    Ranks come from a sort of distinct tokens by range and counts of the partitions, not from one partition.
    """
    return _first_patterns(pair_patterns(shuffle_ranks(tokens, seed))).select("pattern", "description")


def rank_all(rows: DataFrame, column: str) -> DataFrame:
    """rows with rn, their rank from 1 by a column of distinct values, without bringing them into one partition.

    Borders of ranges come from samples that differ from run to run, so the sorted rows are written once, and both the counts and the ranks are of what was written.
    """
    parts = kept(rows.repartitionByRange(column).sortWithinPartitions(column).select("*", F.monotonically_increasing_id().alias("_m")))
    parts = parts.select(*rows.columns, F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("_k"))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    return parts.join(F.broadcast(sizes.select("_p", before.alias("_before"))), "_p").select(*rows.columns, (F.col("_before") + F.col("_k") + 1).alias("rn"))


def autogenerated(tokens: DataFrame, max_patterns: int = MAX_PATTERNS, seed: int = SEED) -> DataFrame:
    """(pattern, description, part, rn, k): templates, pairs and single letters of a base of max_patterns tokens(token), 20 at least, in shuffled order."""
    base = tokens.select("token").orderBy(shuffled(F.col("token"), seed), "token").limit(max(20, max_patterns))
    w = Window.orderBy(shuffled(F.col("token"), seed), "token")  # as many rows as the base has
    base = base.select("token", F.row_number().over(w).cast("long").alias("rn"), F.count("*").over(Window.partitionBy()).alias("n"))
    return _first_patterns(template_patterns(base).unionByName(pair_patterns(base, max_patterns // 6)))


def stratified(patterns: DataFrame, max_patterns: int = MAX_PATTERNS, seed: int = SEED) -> DataFrame:
    """(pattern, description, score, tier) of max_patterns of patterns(pattern, description, part, rn, k), in turn from the simplest third, the middle and the most complex,
    each in shuffled order; all of them, if they are no more. Thirds are by place in the order of the score, then of making: n // 3 and 2 n // 3."""
    scored = patterns.withColumn("score", complexity(F.col("pattern")))
    placed = rank_all(scored.withColumn("_o", F.struct("score", "part", "rn", "k")).withColumnRenamed("rn", "_rn"), "_o")
    n = patterns.count()
    one = max(1, n // 3)
    two = max(one + 1, 2 * n // 3)
    tier = F.when(F.col("rn") <= one, 0).when(F.col("rn") <= two, 1).otherwise(2)
    h = shuffled(F.col("pattern"), seed)
    turn = F.row_number().over(Window.partitionBy("tier").orderBy("h", "pattern"))
    rows = placed.select("pattern", "description", "score", tier.alias("tier"), h.alias("h"))
    if n > max_patterns:
        rows = rows.withColumn("turn", turn).where(F.col("turn") <= max_patterns).orderBy("turn", "tier").limit(max_patterns)
    return rows.select("pattern", "description", "score", "tier")


def merge_patterns(*sets: DataFrame) -> DataFrame:
    """(pattern, description) of several sets, earlier ones first; of equal patterns the first."""
    rows = None
    for k, s in enumerate(sets):
        part = s.select("pattern", "description", F.lit(k).alias("k"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("pattern").agg(F.min_by("description", F.struct("k", "description")).alias("description"))


#: Lengths of a sweep, those of them for which a literal that doesn't occur is made, and the share of these that a sweep stays below.
LENGTHS = (8, 12, 16, 20, 24, 28, *range(32, 145, 8), 150, *range(160, 200, 10), *range(200, 501, 20))
NOMATCH_LENGTHS = (120, 260, 400, 500)
NOMATCH_SHARE = 0.10
#: Texts of letters of these kinds are changed by a digit, others by a token.
SEQUENCES = ("dna", "protein")
ATTEMPTS = 25


#: Printable ASCII without wildcards, by byte.
_PRINTABLE = np.array([32 <= b < 127 and chr(b) not in "%_" for b in range(256)])


def _runs(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each longest run of printable ASCII without wildcards or outer space, in order; and which bytes may stand at the ends of a literal."""
    fits = _PRINTABLE[raw]
    begins = np.zeros(len(raw) + 1, bool)
    begins[at] = True  # a run doesn't reach into the next text
    after = np.concatenate((fits[:-1], [False])) & ~begins[1:]  # whether the run goes on behind a byte
    after[:-1] &= fits[1:]
    first = np.flatnonzero(fits & ~np.concatenate(([False], after[:-1])))
    last = np.flatnonzero(fits & ~after)
    solid = fits & (raw != 32)
    place = np.flatnonzero(solid)
    i, j = np.searchsorted(place, first), np.searchsorted(place, last, side="right") - 1
    some = i <= j
    return place[i[some]], place[j[some]] + 1, solid


def _first_runs(lengths: tuple[int, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, id, literal): of batches(id, text), for each length the first fitting run of the smallest id. Texts behind the best ones so far are passed over."""
    best: dict[int, tuple] = {}
    kind = None

    def sorted_batches():
        for b in batches:
            b = b.filter(b.column(0).is_valid())
            yield b.take(pc.sort_indices(b.column(0)))

    for batch, raw, at in slices(sorted_batches()):
        kind, ids = batch.schema.field(0).type, batch.column(0)
        if not len(raw) or len(best) == len(lengths) and ids[0].as_py() >= max(x for x, _ in best.values()):
            continue
        begin, end, solid = _runs(raw, at)
        size, row = end - begin, np.searchsorted(at, begin, side="right") - 1
        for n in lengths:
            for k in np.flatnonzero(size >= n):
                own = ids[int(row[k])].as_py()
                if n in best and own >= best[n][0]:
                    break
                a, b = begin[k], end[k]
                where = np.flatnonzero(solid[a : b - n + 1] & solid[a + n - 1 : b])
                if len(where):
                    best[n] = own, raw[a + where[0] : a + where[0] + n].tobytes().decode()
                    break
    if best:
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array([x for x, _ in best.values()], kind), pa.array([x for _, x in best.values()])], names=["n", "id", "literal"])


def len_sweep_exists(rows: DataFrame, id_column: str, text_column: str, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """(n, literal): for each length a literal that occurs: the first run of printable ASCII without wildcards or outer space, of the row of the smallest id that has one.
    A length that no row has is left out.

    Texts are read once; the result, a row a length, is fetched, so that what is made of it doesn't read them again."""
    texts = rows.select(F.col(id_column).alias("id"), F.col(text_column).alias("data"))
    schema = rows.select(F.lit(0).alias("n"), F.col(id_column).alias("id"), F.lit("").alias("literal")).schema
    found = texts.mapInArrow(partial(_first_runs, tuple(lengths)), schema).groupBy("n").agg(F.min_by("literal", "id").alias("literal")).collect()
    return rows.sparkSession.createDataFrame(sorted(tuple(r) for r in found), "n int, literal string")


def mutated(literal: str, kind: str, attempt: int) -> str:
    """A literal with another middle: a digit in a sequence, else the token QZXJ, a digit, KQ, as far as it fits."""
    n = len(literal)
    if kind in SEQUENCES:
        at, digit = n // 2, attempt % 10
        return literal[:at] + str(digit if literal[at] != str(digit) else (attempt + 1) % 10) + literal[at + 1 :]
    token = f"QZXJ{attempt % 10}KQ"
    at = max(0, n // 2 - len(token) // 2)
    return literal[:at] + token[: n - at] + literal[at + len(token) :]


def len_sweep_nomatch(literals: DataFrame, rows: DataFrame, text_column: str, kind: str = "text", lengths: tuple[int, ...] = NOMATCH_LENGTHS) -> DataFrame:
    """(n, literal): each of literals(n, literal) of the given lengths, changed by the first of ATTEMPTS that makes it occur in no text. An error, if none does.

    Literals are few, a row a length: they become one projection over the texts, which are read once, and again only if a first attempt occurs.
    """
    known = literals.where(F.col("n").isin(*lengths)).orderBy("n").collect()
    chosen: dict[int, str] = {}
    for attempts in (range(1), range(1, ATTEMPTS)):
        tries = [(r.n, mutated(r.literal, kind, k)) for r in known if r.n not in chosen for k in attempts]
        distinct = list(dict.fromkeys(t for _, t in tries))
        if distinct:
            seen = rows.agg(*[F.coalesce(F.max(F.col(text_column).contains(t)), F.lit(False)).alias(f"t{j}") for j, t in enumerate(distinct)]).first()
            there = {t for j, t in enumerate(distinct) if seen[f"t{j}"]}
            for n, t in tries:
                if t not in there:
                    chosen.setdefault(n, t)
    if lost := {r.n for r in known} - set(chosen):
        raise ValueError(f"no literal of length {min(lost)} is absent from all texts")
    return literals.sparkSession.createDataFrame(sorted(chosen.items()), "n int, literal string")


def len_sweep_patterns(exists: DataFrame, nomatch: DataFrame, kind: str = "text") -> DataFrame:
    """(pattern, description) of a sweep's literals(n, literal): those that occur and those that don't, which must stay below NOMATCH_SHARE."""
    a, b = exists.count(), nomatch.count()
    if b and b / (a + b) >= NOMATCH_SHARE:
        raise ValueError(f"{b} of {a + b} literals don't occur: {NOMATCH_SHARE:.0%} or more")
    told = lambda rows, mode: rows.select(F.concat(F.lit("%"), "literal", F.lit("%")).alias("pattern"), F.concat(F.lit(f"{kind}-len-{mode}|len="), F.col("n").cast("string")).alias("description"))
    return told(exists, "exists").unionByName(told(nomatch, "nomatch"))
