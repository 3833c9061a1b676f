"""Shared pieces of the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A term is a maximal run of letters, marks and digits; longer ones than MAX_TERM_BYTES - 1 in UTF-8 are dropped.
TERM = r"[\p{L}\p{M}\p{N}]+"
MAX_TERM_BYTES = 40


def term_array(text: Column) -> Column:
    """Tokens of ``text`` as stored, over-long ones dropped; null gives an empty array."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), F.lit(0))
    return F.filter(found, lambda w: F.octet_length(w) < MAX_TERM_BYTES)


def terms_of(findall: Callable[[str], list[str]], text: str | None) -> list[str]:
    """Lower-cased terms, for Arrow stages. A term under ten characters has under 40 bytes."""
    if not text:
        return []
    return [w.lower() for w in findall(text) if len(w) < 10 or len(w.encode()) < MAX_TERM_BYTES]


def arrow_stage(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with the columns of ``df`` as they are."""
    return df.mapInArrow(fn, schema)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under our own names, so that further columns of the input can't clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])
