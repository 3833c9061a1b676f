"""How text becomes terms, at index time and in queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a maximal run of alphabetic characters (vowel points included) and numbers.
TOKEN = r"[\p{IsAlphabetic}\p{N}]+"
#: Tokens of so many UTF-8 bytes or more are left out; their position stays empty.
LONGEST = 40
#: Points and accents that queries don't mind; the range holds the maqaf too.
MARKS = r"[֑-ׇ]"


def raw_tokens(text: Column) -> Column:
    """All tokens of ``text`` in order, as stored; null gives an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def strip_marks(text: Column) -> Column:
    return F.regexp_replace(text, MARKS, "")


def normalise(text: Column) -> Column:
    """Without marks, lower-cased."""
    return F.lower(strip_marks(text))


def unmarked(text: str) -> str:
    """``strip_marks`` for a query string."""
    return "".join(c for c in text if not "֑" <= c <= "ׇ")


def query_terms(query: str) -> list[str]:
    """The terms of a query string: marks stripped, then tokenised as text is."""
    import regex

    found = regex.findall(r"[\p{Alphabetic}\p{N}]+", unmarked(query))
    return [t.lower() for t in found if len(t.encode()) < LONGEST]
