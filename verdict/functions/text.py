"""Text expressions: tokenisation and character n-grams (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a token is a maximal run of Unicode letters / digits.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased tokens of the whole text, empty ones dropped."""
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: t != "")


def distinct_tokens(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """All overlapping character n-grams (code points) of the whole text,
    in one linear regex pass (a capturing look-ahead at every position);
    empty when the text is shorter than n. (Indexing with ``substring`` per
    position would rescan the UTF-8 string and be quadratic.)"""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1)
