"""Searches over streams. Predicates keep no state, so the plans of the batch engine serve as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsieve.functions.pattern import compile_like


def matches(stream: DataFrame, patterns: list[str], text_column: str = "data", underscore: str = "byte") -> DataFrame:
    """stream's columns and pattern_index, a row for each match of each pattern, in one projection."""
    hits = [F.when(compile_like(p, underscore).matches(F.col(text_column)), F.lit(i)) for i, p in enumerate(patterns)]
    return stream.select("*", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("pattern_index"))
