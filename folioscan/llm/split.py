"""Cutting oversized texts into pieces at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import arrow_stage, pick

LIMIT = 3000
OVERLAP = 200
#: Boundary kinds, strongest first; a cut comes after the match. The last resort is a forced cut.
KINDS = ("paragraph", "line", "sentence", "clause", "space", "forced")
_PARAGRAPH = r"\r?\n[^\S\n]*\r?\n\s*"
_LINE = r"\r?\n"
_SENTENCE = r"[.!?׃]['\"״)\]]*\s+"
_CLAUSE = r"[,;:]\s+"


def boundaries(text: str) -> dict[int, int]:
    """Places where ``text`` may be cut, with the rank of the boundary (0 is strongest)."""
    import re

    places: dict[int, int] = {}
    for m in re.finditer(r"\s+", text):
        for p in range(m.start(), m.end() + 1):
            places[p] = 4
    for rank, pattern in ((3, _CLAUSE), (2, _SENTENCE), (1, _LINE), (0, _PARAGRAPH)):
        for m in re.finditer(pattern, text):
            places[m.end()] = min(rank, places.get(m.end(), rank))
    places.pop(0, None)
    places.pop(len(text), None)
    return places


def _forced_at(text: str, mid: int, lo: int, hi: int) -> int:
    """A cut near ``mid`` that doesn't part a letter from its marks, where there is one."""
    import unicodedata

    for p in range(mid, max(lo, mid - 64), -1):
        if lo < p < hi and not unicodedata.combining(text[p]):
            return p
    return mid


def bisect_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Pieces ``(start, end, kept_overlap, rank of the boundary at the end)`` of ``text`` without overlaps attached.

    A piece that exceeds ``limit - overlap`` is cut at the strongest boundary in its middle half, the one next to
    the midpoint on ties, or else at the best one anywhere in it. A stretch without boundary that still fits in
    ``limit`` stays whole and its overlap shrinks; a longer one is cut by force.
    """
    from bisect import bisect_left, bisect_right

    places = boundaries(text)
    keys = sorted(places)
    core = limit - overlap
    out: list[tuple[int, int, int]] = []
    todo = [(0, len(text), 5)]  # last on top; ranks belong to the end of a span
    while todo:
        lo, hi, rank = todo.pop()
        size = hi - lo
        if size <= core or (lo == 0 and size <= limit):
            out.append((lo, hi, rank))
            continue
        mid = lo + size // 2
        a, b = bisect_left(keys, lo + size // 4), bisect_right(keys, hi - size // 4)
        found = keys[max(a, bisect_right(keys, lo)) : min(b, bisect_left(keys, hi))] or keys[bisect_right(keys, lo) : bisect_left(keys, hi)]
        if found:
            at = min(found, key=lambda p: (places[p], abs(p - mid), p))
            todo += [(at, hi, rank), (lo, at, places[at])]
        elif size <= limit:
            out.append((lo, hi, rank))
        else:
            at = _forced_at(text, mid, lo, hi)
            todo += [(at, hi, rank), (lo, at, 5)]
    last = len(out) - 1
    return [(lo, hi, 0 if not i else min(overlap, limit - (hi - lo), lo), -1 if i == last else rank) for i, (lo, hi, rank) in enumerate(out)]


def split_oversized(
    df: DataFrame, row_id: str = "row_id", text: str = "text", segment: str = "segment", limit: int = LIMIT, overlap: int = OVERLAP
) -> DataFrame:
    """Pieces of the texts over ``limit`` characters: ``(row_id, piece, segment, start, end, overlap, boundary, text)``.

    ``start``/``end``: place of the piece's own part in the text; ``text`` is the ``overlap`` characters before it
    plus that part, at most ``limit`` characters. The parts without overlaps, joined, are the text. ``segment``
    numbers on from the record's (null counts as 0). ``boundary``: kind of the piece's end, ``end`` for the last.
    Texts that fit and null texts give no rows; repeated rows give their pieces again; further columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    names = ["row_id", "piece", "segment", "start", "end", "overlap", "boundary", "text"]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for i, t, s in zip(*(c.to_pylist() for c in batch.columns)):
                for k, (lo, hi, back, rank) in enumerate(bisect_text(t, limit, overlap)):
                    for col, v in zip(cols, (i, k, (s or 0) + k, lo, hi, back, "end" if rank < 0 else KINDS[rank], t[lo - back : hi])):
                        col.append(v)
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    large = pick(df, i=row_id, t=text, s=segment).where(F.char_length("t") > limit)
    return arrow_stage(large, stage, "row_id long, piece long, segment long, start long, `end` long, overlap long, boundary string, text string")


def cut_kinds(pieces: DataFrame) -> DataFrame:
    """``(row_id, cut)``: ``forced`` for records with a forced cut among their pieces, else ``boundary``."""
    forced = F.max((F.col("boundary") == "forced").cast("int")) == 1
    return pieces.groupBy("row_id").agg(F.when(forced, "forced").otherwise("boundary").alias("cut"))
