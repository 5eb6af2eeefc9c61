"""LIKE patterns as Catalyst expressions.

A pattern becomes tokens, the tokens a strategy, and the strategy the cheapest expression that decides it: equality, startswith, endswith and contains reach the
Parquet scan; literals with only % between them are sought one after the other without a regular expression; what has _ falls back on LIKE behind cheap conjuncts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Literals in a row that are sought by nested locate; beyond, LIKE takes over.
CHAIN = 8
#: Names of the search algorithms that a caller may ask for, and the plan family that answers in their place.
ALGORITHMS = dict.fromkeys(
    ("std", "naive-scalar", "naive-vector", "naive-vector-v2", "naive-mixed", "kmp", "bm", "two-way", "lut-short"), "scan"
) | {"fftstr0": "wildcard", "fftstr1": "wildcard", "fm": "suffix", "trigram": "trigram"}


def plan_family(algorithm: str, skip: tuple[str, ...] = ()) -> str | None:
    """scan, wildcard, suffix or trigram; None if the name is among those to skip."""
    for name in (algorithm, *skip):
        if name not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {name!r}; there are {', '.join(ALGORITHMS)}")
    return None if algorithm in skip else ALGORITHMS[algorithm]


@dataclass(frozen=True)
class Pattern:
    """tokens: a str for a literal, an int for so many units of any kind, None for any sequence. min_bytes: no shorter text matches."""

    source: str
    underscore: str
    tokens: tuple[str | int | None, ...]
    min_bytes: int
    strategy: str

    @property
    def literals(self) -> list[str]:
        return [t for t in self.tokens if isinstance(t, str)]

    def matches(self, c: Column) -> Column:
        """Whether the text in c matches. Null counts as the empty text; where that doesn't match, the answer for null is null, so that the plain strategies reach the scan."""
        lits = self.literals
        if self.strategy == "all":
            return F.lit(True)
        if self.strategy == "exact":
            return c == F.lit(lits[0]) if lits else F.coalesce(c, F.lit("")) == F.lit("")
        if self.strategy == "prefix":
            return c.startswith(lits[0])
        if self.strategy == "suffix":
            return c.endswith(lits[0])
        if self.strategy == "contains":
            return c.contains(lits[0])
        guard = self._guard(c)
        if self.strategy == "percent":
            return guard & self._chain(c) if len(lits) <= CHAIN else guard & c.like(escaped(self.tokens))
        if self.underscore == "char":
            return guard & c.like(escaped(self.tokens))
        view = tuple(latin1(t) if isinstance(t, str) else t for t in self.tokens)
        return guard & byte_view(c).like(escaped(view))

    def _guard(self, c: Column) -> Column:
        """What any match has: its length, the literals at its ends, those within."""
        out = F.octet_length(c) >= self.min_bytes
        first, last = self.tokens[0], self.tokens[-1]
        if isinstance(first, str):
            out &= c.startswith(first)
        if isinstance(last, str):
            out &= c.endswith(last)
        if self.strategy == "general":
            middle = self.tokens[1 if isinstance(first, str) else 0 : -1 if isinstance(last, str) else None]
            for t in sorted((t for t in middle if isinstance(t, str)), key=len, reverse=True):
                out &= c.contains(t)
        return out

    def _chain(self, c: Column) -> Column:
        tokens, at, end = list(self.tokens), F.lit(1), F.length(c)
        if isinstance(tokens[0], str):
            at = F.lit(len(tokens.pop(0)) + 1)
        if isinstance(tokens[-1], str):
            end = end - len(tokens.pop())
        for t in tokens:
            if isinstance(t, str):
                at = F.nullif(F.position(F.lit(t), c, at), F.lit(0)) + len(t)
        return F.coalesce(at - 1 <= end, F.lit(False))


def tokenise(pattern: str, underscore: str) -> tuple[str | int | None, ...]:
    out: list[str | int | None] = []
    for ch in pattern:
        if ch == "%":
            if not out or out[-1] is not None:
                out.append(None)
        elif ch == "_" and underscore != "literal":
            if out and isinstance(out[-1], int):
                out[-1] += 1
            else:
                out.append(1)
        elif out and isinstance(out[-1], str):
            out[-1] += ch
        else:
            out.append(ch)
    return tuple(out)


def compile_like(pattern: str, underscore: str = "byte") -> Pattern:
    """underscore: what _ stands for: one byte, one char(acter), or itself (literal). There is no escape character, and a newline is like any other character."""
    if underscore not in ("byte", "char", "literal"):
        raise ValueError("underscore must be byte, char or literal")
    tokens = tokenise(pattern, underscore)
    least = sum(len(t.encode()) if isinstance(t, str) else t or 0 for t in tokens)
    shape = tuple("l" if isinstance(t, str) else "_" if isinstance(t, int) else "%" for t in tokens)
    named = {(): "exact", ("l",): "exact", ("%",): "all", ("l", "%"): "prefix", ("%", "l"): "suffix", ("%", "l", "%"): "contains"}
    return Pattern(pattern, underscore, tokens, least, named.get(shape) or ("general" if "_" in shape else "percent"))


def escaped(tokens: tuple[str | int | None, ...]) -> str:
    """The pattern as Spark's LIKE reads it, where a backslash escapes."""
    literal = lambda t: t.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return "".join(literal(t) if isinstance(t, str) else "_" * t if isinstance(t, int) else "%" for t in tokens)


def latin1(text: str) -> str:
    return text.encode().decode("iso-8859-1")


def byte_view(c: Column) -> Column:
    """A text with one character for each byte of c."""
    return F.decode(F.encode(c, "utf-8"), "iso-8859-1")


def like(c: Column, pattern: str, underscore: str = "byte") -> Column:
    return compile_like(pattern, underscore).matches(c)
