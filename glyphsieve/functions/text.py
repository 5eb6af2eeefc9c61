"""Literal search and byte functions over text columns. Positions are bytes from 0."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphsieve.functions.pattern import byte_view, latin1


def find_first(c: Column, literal: str) -> Column:
    """The first place of a literal; null if there is none. The empty literal stands at 0."""
    if not literal:
        return F.when(c.isNotNull(), F.lit(0))
    at = F.nullif(F.locate(literal, c), F.lit(0))
    return F.octet_length(F.left(c, at - 1))


def find_all(c: Column, literal: str) -> Column:
    """All places of a literal, overlapping ones too, in order. The empty literal stands everywhere, the end included."""
    if not literal:
        return F.sequence(F.lit(0), F.octet_length(c))
    chars, m = F.split(byte_view(c), ""), len(literal.encode())
    at = F.sequence(F.lit(1), F.greatest(F.octet_length(c) - m + 1, F.lit(1)))
    # a variable of a function is computed once; what stands inside would be computed for each place
    hit = F.get(F.transform(F.array(chars), lambda b: F.filter(at, lambda i: F.array_join(F.slice(b, i, F.lit(m)), "") == latin1(literal))), F.lit(0))
    hit = F.transform(hit, lambda i: i - 1)
    return F.when(c.contains(literal), hit).when(c.isNotNull(), F.array().cast("array<int>"))


def count_overlapping(c: Column, literal: str) -> Column:
    """How many places find_all() has, in one pass of a regular expression over the text."""
    if not literal:
        return F.octet_length(c) + 1
    return F.when(c.contains(literal), F.regexp_count(c, F.lit(f"(?=\\Q{literal}\\E)"))).when(c.isNotNull(), F.lit(0))


def find_wildcard(c: Column, pattern: str, wildcard: str = "_") -> Column:
    """The first place of a pattern whose wildcard stands for any one byte; null if there is none."""
    if not pattern:
        return F.when(c.isNotNull(), F.lit(0))
    expression = "(?s)" + ".".join("\\Q" + latin1(x) + "\\E" if x else "" for x in pattern.split(wildcard))
    return F.nullif(F.regexp_instr(byte_view(c), F.lit(expression)), F.lit(0)) - 1


def kmer_find(c: Column, pattern: str, k: int = 8, min_hits: int = 3) -> Column:
    """The first place of a pattern, if it has min_hits k-mers at least; null otherwise: seeds that are fewer never make a candidate."""
    m = len(pattern.encode())
    if k <= 0 or m < k or m - k + 1 < min_hits:
        return F.lit(None).cast("int")
    return find_first(c, pattern)


def kmer_diagonals(rows: DataFrame, id_column: str, text_column: str, pattern: str, k: int, min_hits: int) -> DataFrame:
    """(id, diagonal, hits): how many k-mers of the pattern each text has at places that agree on where the pattern would begin; min_hits at least, no negative begin."""
    p = latin1(pattern)
    places: dict[str, list[int]] = {}
    for j in range(len(p) - k + 1):
        places.setdefault(p[j : j + k], []).append(j)
    schema = rows.select(F.col(id_column).alias("id"), F.lit(0).alias("diagonal"), F.lit(0).cast("long").alias("hits")).schema
    if k <= 0 or not places:
        return rows.sparkSession.createDataFrame([], schema)
    chars = F.split(byte_view(F.col(text_column)), "")
    table = F.create_map(*[x for s, at in places.items() for x in (F.lit(s), F.array(*map(F.lit, at)))])
    at = F.sequence(F.lit(1), F.octet_length(text_column) - k + 1)
    grams = F.get(F.transform(F.array(chars), lambda b: F.transform(at, lambda i: F.struct(i.alias("i"), F.array_join(F.slice(b, i, F.lit(k)), "").alias("g")))), F.lit(0))
    known = F.filter(F.transform(grams, lambda s: F.struct(s.i.alias("i"), F.try_element_at(table, s.g).alias("at"))), lambda s: s["at"].isNotNull())
    seeds = rows.where(F.octet_length(text_column) >= k).select(F.col(id_column).alias("id"), F.explode(known).alias("s"))
    hits = seeds.select("id", (F.col("s.i") - 1).alias("i"), F.explode("s.at").alias("j")).select("id", (F.col("i") - F.col("j")).alias("diagonal"))
    return hits.where("diagonal >= 0").groupBy("id", "diagonal").agg(F.count("*").alias("hits")).where(F.col("hits") >= min_hits)


def clip_bytes(c: Column, limit: int) -> Column:
    """The longest beginning of a text that takes `limit` bytes at most."""
    short = F.left(c, F.lit(limit))
    best = F.aggregate(F.sequence(F.lit(0), F.length(short)), F.lit(0), lambda a, k: F.when(F.octet_length(F.left(short, k)) <= limit, k).otherwise(a))
    return F.when(F.octet_length(short) <= limit, short).otherwise(F.left(short, best))


def bytes_of(c: Column) -> Column:
    """The bytes of a text, as numbers from 0 to 255."""
    pairs = F.filter(F.split(F.hex(c), "(?<=\\G..)"), lambda x: x != "")
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


def byte_frequency(rows: DataFrame, text_column: str) -> DataFrame:
    """(byte, n): how often each byte occurs in all texts."""
    return rows.select(F.explode(bytes_of(F.col(text_column))).alias("byte")).groupBy("byte").agg(F.count("*").alias("n"))


def literal_rarity(frequency: DataFrame, literals: DataFrame) -> DataFrame:
    """(literal, rarity): the occurrences of each literal's rarest byte."""
    asked = literals.where("literal <> ''").select("literal", F.explode(bytes_of(F.col("literal"))).alias("byte")).distinct()
    return asked.join(frequency, "byte", "left").groupBy("literal").agg(F.min(F.coalesce("n", F.lit(0))).cast("long").alias("rarity"))


def rarest_byte(literals: DataFrame) -> DataFrame:
    """(literal, byte): the byte that occurs least within each literal, the first of equals."""
    at = literals.where("literal <> ''").select("literal", F.posexplode(bytes_of(F.col("literal"))).alias("i", "byte"))
    counts = at.groupBy("literal", "byte").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    return counts.groupBy("literal").agg(F.min_by("byte", F.struct("n", "first")).alias("byte"))


def bytes_equal(x: Column, y: Column) -> Column:
    """Whether two texts of the same number of bytes are equal; an error if the numbers differ."""
    same = F.octet_length(x) == F.octet_length(y)
    return F.when(same | x.isNull() | y.isNull(), F.encode(x, "utf-8") == F.encode(y, "utf-8")).otherwise(F.raise_error(F.lit("texts of unequal length")).cast("boolean"))


def pattern_literals(p: Column) -> Column:
    """The runs of a pattern without wildcards."""
    return F.filter(F.split(p, "[%_]+"), lambda x: x != "")


def pattern_kind(p: Column) -> Column:
    """exact; contains, which begins and ends with % and has no other wildcard (nor need it have a literal); or wildcard."""
    percents = F.length(p) - F.length(F.replace(p, F.lit("%"), F.lit("")))
    return F.when(~p.rlike("[%_]"), F.lit("exact")).when(p.startswith("%") & p.endswith("%") & (percents == 2) & ~p.contains("_"), F.lit("contains")).otherwise(F.lit("wildcard"))


def pattern_strategy(p: Column) -> Column:
    """How compile_like(p, "byte") decides a pattern."""
    s = F.regexp_replace(p, "%+", "%")
    return (
        F.when(s == "%", F.lit("all")).when(~s.rlike("[%_]"), F.lit("exact")).when(s.contains("_"), F.lit("general")).when(s.rlike("^[^%]+%$"), F.lit("prefix"))
        .when(s.rlike("^%[^%]+$"), F.lit("suffix")).when(s.rlike("^%[^%]+%$"), F.lit("contains")).otherwise(F.lit("percent"))
    )


def complexity(p: Column) -> Column:
    """3 for each %, 2 for each _, 1 for each character."""
    less = lambda ch: F.length(p) - F.length(F.replace(p, F.lit(ch), F.lit("")))
    return 3 * less("%") + 2 * less("_") + F.length(p)


def literal_length(pattern: Column, description: Column) -> Column:
    """What a description's len= says, else the pattern's characters without wildcards."""
    said = F.nullif(F.regexp_extract(description, "len=([0-9]+)", 1), F.lit("")).cast("int")
    return F.coalesce(said, F.length(F.regexp_replace(pattern, "[%_]", "")))


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def regex_quote(text: str) -> str:
    return re.escape(text)
