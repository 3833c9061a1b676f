"""Which records match a query, and how well: lazy frames ``(row_id, score)``.

Patterns and misspellings are resolved on the vocabulary first; the postings are then filtered by whole terms, which
the Parquet scan prunes on, and each record's positions are compared within one row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import topics as T
from folioscan.functions.analysis import query_terms
from folioscan.operators.index import Index
from folioscan.schema import ExpansionError

K1, B = 1.2, 0.75
#: Term sets up to this size become a literal list for the scan; larger ones are joined.
LITERAL_TERMS = 5000


@dataclass(frozen=True)
class Matches:
    """``rows``: ``(row_id, score)``; ``slots``: for each place of the query the terms that stand for it, or a frame of
    them where they are many."""

    rows: DataFrame
    slots: list = field(default_factory=list)

    @property
    def empty(self) -> bool:
        return not self.slots


def nothing(index: Index) -> Matches:
    return Matches(index.lengths.select("row_id", F.lit(0.0).alias("score")).where(F.lit(False)))


_ANCHOR = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|([\^$])", re.S)


def whole_term(pattern: str) -> str:
    """A pattern over whole terms for Java's regular expressions. Anchors have no place in it."""
    if any(m.group(1) for m in _ANCHOR.finditer(pattern)):
        raise ValueError(f"patterns have no anchors: {pattern!r}")
    return f"^(?:{pattern})$"


def literal_start(pattern: str) -> str:
    """Letters that every term begins with which ``pattern`` matches whole."""
    if "|" in pattern:
        return ""
    start = re.match(r"(?:\w)*", pattern).group()
    return start[:-1] if pattern[len(start) : len(start) + 1] in ("*", "?", "{") and start else start


def _span(pattern: str) -> Column:
    """The range of terms that begin with the letters ``pattern`` begins with."""
    start = literal_start(pattern)
    return (F.col("term") >= start) & (F.col("term") < start + "\U0010ffff") if start else F.lit(True)


def _whole(frame: DataFrame, pattern: str) -> DataFrame:
    """Rows with a term that ``pattern`` matches whole. Vocabulary and postings are in order of terms, so the letters that a
    pattern begins with leave out most of their row groups."""
    return frame.where(_span(pattern)).where(F.col("term").rlike(whole_term(pattern)))


def _matching(index: Index, pattern: str) -> DataFrame:
    """The terms that ``pattern`` matches whole."""
    return _whole(index.vocabulary, pattern).select("term")


def expand_all(index: Index, patterns: Sequence[str], cap: int) -> list[list[str]]:
    """For each pattern the terms of the vocabulary that it matches whole, ``cap`` + 1 of them at most, found in one job."""
    if not patterns:
        return []
    parts = [_matching(index, p).select(F.lit(i).alias("i"), "term").limit(cap + 1) for i, p in enumerate(patterns)]
    found: list[list[str]] = [[] for _ in patterns]
    for r in reduce(DataFrame.unionByName, parts).collect():
        found[r.i].append(r.term)
    return [sorted(f) for f in found]


def expand(index: Index, pattern: str, cap: int) -> list[str]:
    """The terms of the vocabulary that ``pattern`` matches whole; raises ``ExpansionError`` beyond ``cap``."""
    return _within(pattern, expand_all(index, [pattern], cap)[0], cap)


def _within(pattern: str, found: list[str], cap: int) -> list[str]:
    if len(found) > cap:
        raise ExpansionError(f"{pattern!r} stands for more than {cap} terms")
    return found


def _exchanged(term: Column, word: str, distance: int) -> Column:
    """Whether ``term`` is within ``distance`` edits of ``word`` of which at least one is an exchange of neighbours.

    No edit touches what another has changed: beside an exchange a further edit lies in what is before or behind it.
    """
    swap = lambda w, i: w[:i] + w[i + 1] + w[i] + w[i + 2 :]
    places = [i for i in range(len(word) - 1) if word[i] != word[i + 1]]
    whole = {swap(word, i) for i in places}
    if distance < 2:
        return term.isin(sorted(whole))
    whole |= {swap(swap(word, i), j) for i in places for j in places if j > i + 1}
    found = term.isin(sorted(whole))
    for i in places:
        for at in range(max(0, i - 1), i + 2):
            beside = F.levenshtein(F.substring(term, 1, at), F.lit(word[:i])) + F.levenshtein(F.substring(term, at + 3, 1 << 20), F.lit(word[i + 2 :]))
            found |= (F.substring(term, at + 1, 2) == word[i + 1] + word[i]) & (beside <= 1)
    return found


def misspelt(index: Index, word: str, distance: int) -> DataFrame:
    """Terms within ``distance`` edits of ``word``, an exchange of neighbours being one.

    Plain edit distance accepts most; the rest have an exchange, which counts twice there, and are looked at as such.
    """
    if not 0 <= distance <= 2:
        raise ValueError("the distance is 0, 1 or 2")
    if distance == 0:
        return index.vocabulary.where(F.col("term") == word).select("term")
    near = F.levenshtein("term", F.lit(word), 2 * distance)
    candidates = index.vocabulary.where(F.char_length("term").between(len(word) - distance, len(word) + distance)).withColumn("d", near).where("d >= 0")
    return candidates.where((F.col("d") <= distance) | _exchanged(F.col("term"), word, distance)).select("term")


def _facets(index: Index, matches: DataFrame, facets: Sequence[str]) -> DataFrame:
    """Records under any of ``facets``, one point more for being so; an empty list filters nothing."""
    if not facets:
        return matches
    chosen = index.docs.where(T.under_any(F.col("topics"), list(facets))).select("row_id")
    return matches.join(chosen, "row_id", "left_semi").withColumn("score", F.col("score") + 1.0)


def _of_terms(index: Index, terms: Sequence[str] | DataFrame) -> DataFrame:
    if isinstance(terms, DataFrame):
        return index.postings.join(terms, "term", "left_semi")
    return index.postings.where(F.col("term").isin(list(terms)))


def _literal(terms: DataFrame) -> list[str] | DataFrame:
    """The terms as a sorted list if they are few, else the frame."""
    found = terms.limit(LITERAL_TERMS + 1).collect()
    return sorted(r.term for r in found) if len(found) <= LITERAL_TERMS else terms


def _idf(records: float, holding: float) -> float:
    return math.log(1 + (records - holding + 0.5) / (holding + 0.5))


def _bm25(index: Index, counted: DataFrame, idf: float) -> DataFrame:
    """``(row_id, tf)`` with its BM25 score; lengths aren't rounded."""
    mean = index.lengths.agg(F.avg("dl").alias("a")).first().a or 1.0
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(mean))))
    return counted.join(index.lengths, "row_id").select("row_id", (F.lit(idf) * weight).alias("score"))


def _listed(slots: Sequence[Sequence[str] | str]) -> list[str]:
    """The terms of all slots that have a list of them."""
    return sorted({t for s in slots if not isinstance(s, str) for t in s})


def _dfs(index: Index, slots: Sequence[Sequence[str] | str]) -> list[int]:
    """For each slot the records that hold its terms, summed over the terms."""
    df = {r.term: r.df for r in index.vocabulary.where(F.col("term").isin(_listed(slots))).collect()}
    summed = lambda p: _whole(index.vocabulary, p).agg(F.sum("df").alias("n")).first().n or 0
    return [summed(s) if isinstance(s, str) else sum(df.get(t, 0) for t in s) for s in slots]


def _slot_positions(index: Index, slots: Sequence[Sequence[str] | str]) -> DataFrame:
    """``(row_id, p0, p1, ...)``: sorted positions of each slot's terms in the records that hold all slots. A slot is a list
    of terms, or a pattern that every posting is held against.

    One scan for all terms and one shuffle of their postings; a record's lists are bounded by its text.
    """
    tests = [F.col("term").rlike(whole_term(s)) if isinstance(s, str) else F.col("term").isin(list(s)) for s in slots]
    lists = [F.array_sort(F.flatten(F.collect_list(F.when(t, F.col("positions"))))).alias(f"p{i}") for i, t in enumerate(tests)]
    patterns = [s for s in slots if isinstance(s, str)]
    if patterns:
        spans = [*map(_span, patterns), F.col("term").isin(_listed(slots))]
        held = index.postings.where(reduce(lambda a, b: a | b, spans)).where(reduce(lambda a, b: a | b, tests))
    else:
        held = _of_terms(index, _listed(slots))
    found = held.groupBy("row_id").agg(*lists)
    return found.where(reduce(lambda a, b: a & b, [F.size(f"p{i}") > 0 for i in range(len(slots))]))


def _shifted(positions: Column, slot: int) -> Column:
    """Where a phrase begins if its word number ``slot`` stands at each of ``positions``."""
    return F.transform(positions, lambda p: p - F.lit(slot))


def _moved(before: Column) -> Callable[[Column], Column]:
    """A placement of the next slot with the least moves that lead to it from the placements ``before``."""

    def step(at: Column) -> Column:
        moves = F.array_min(F.transform(before, lambda s: s["moves"] + F.abs(s["at"] - at)))
        return F.struct(at.alias("at"), moves.cast("long").alias("moves"))

    return step


def placements(slots: Sequence[Column], slop: int) -> Column:
    """How many ends of placements of all slots are within ``slop`` moves ``sum |(pos_i - i) - (pos_(i-1) - (i-1))|``.

    Without slop the starts are intersected. Else one pass over the slots keeps for each position the least moves that
    lead to it.
    """
    starts = [_shifted(p, i) for i, p in enumerate(slots)]
    if slop == 0:
        return F.size(reduce(F.array_intersect, starts))
    state = F.transform(starts[0], lambda at: F.struct(at.alias("at"), F.lit(0).cast("long").alias("moves")))
    for s in starts[1:]:
        state = F.filter(F.transform(s, _moved(state)), lambda x: x["moves"] <= F.lit(slop))
    return F.size(state)


def _placed(slots: Sequence, slop: int) -> Column:
    return placements([F.col(f"p{i}") for i in range(len(slots))], slop)


def exact(index: Index, query: str, facets: Sequence[str] = (), scored: bool = True) -> Matches:
    """Records that hold the words of ``query`` side by side; no words match nothing.

    A single word scores BM25 with a term frequency of 1, a phrase with its occurrences and the sum of its words' idf.
    """
    terms = query_terms(query)
    for f in facets:
        T.checked(f)
    if not terms:
        return nothing(index)
    slots = [[t] for t in terms]
    if len(terms) == 1:
        counted = _of_terms(index, terms).select("row_id", F.lit(1).alias("tf"))
    else:
        counted = _slot_positions(index, slots).select("row_id", _placed(slots, 0).alias("tf")).where("tf > 0")
    return Matches(_facets(index, _scored(index, counted, slots, scored), facets), slots)


def _scored(index: Index, counted: DataFrame, slots: list[list[str] | str], scored: bool) -> DataFrame:
    if not scored:
        return counted.select("row_id", F.lit(0.0).alias("score"))
    records = index.lengths.count()
    return _bm25(index, counted, sum(_idf(records, min(n, records)) for n in _dfs(index, slots)))


def regex(index: Index, patterns: Sequence[str], slop: int = 0, max_expansions: int = 50, facets: Sequence[str] = (), scored: bool = True, refuse: bool = True) -> Matches:
    """Records whose terms match ``patterns`` in order, within ``slop`` moves.

    One pattern matches any of its terms and scores 1. Several are a phrase: their terms together may be
    ``max_expansions``; a pattern without terms ends the search before the others are counted. Without ``refuse`` there may
    be more: a pattern that stands for more than that or ``LITERAL_TERMS`` is held against the postings, its terms aren't listed.
    """
    for f in facets:
        T.checked(f)
    slots: list[list[str] | str] = []
    left = max_expansions if refuse else min(max_expansions, LITERAL_TERMS)
    for p, found in zip(patterns, expand_all(index, patterns, left)):
        if not refuse and len(found) > left:
            slots.append(p)
            continue
        if not _within(p, found, left):
            return nothing(index)
        slots.append(found)
        left -= len(found) if len(patterns) > 1 else 0
    if not slots:
        return nothing(index)
    if len(slots) == 1:
        held = _whole(index.postings, slots[0]) if isinstance(slots[0], str) else _of_terms(index, slots[0])
        rows = held.select("row_id").distinct().withColumn("score", F.lit(1.0))
    else:
        counted = _slot_positions(index, slots).select("row_id", _placed(slots, slop).alias("tf")).where("tf > 0")
        rows = _scored(index, counted, slots, scored)
    return Matches(_facets(index, rows, facets), [_matching(index, s) if isinstance(s, str) else s for s in slots])


def fuzzy_terms(index: Index, terms: Sequence[str], distance: int, facets: Sequence[str] = ()) -> Matches:
    """Records that hold, anywhere, a term within ``distance`` edits of each of ``terms`` as given; one point for each."""
    if not 0 <= distance <= 2:
        raise ValueError("the distance is 0, 1 or 2")
    for f in facets:
        T.checked(f)
    if not terms:
        return nothing(index)
    slots = [[t] if distance == 0 else _literal(misspelt(index, t, distance)) for t in terms]
    parts = [_of_terms(index, s).select("row_id", F.lit(i).alias("slot")) for i, s in enumerate(slots)]
    held = reduce(DataFrame.unionByName, parts).groupBy("row_id").agg(F.count_distinct("slot").alias("n"))
    rows = held.where(F.col("n") == len(slots)).select("row_id", F.lit(float(len(slots))).alias("score"))
    return Matches(_facets(index, rows, facets), slots)


def fuzzy(index: Index, query: str, distance: int, facets: Sequence[str] = ()) -> Matches:
    """``fuzzy_terms`` for the words of a query string."""
    return fuzzy_terms(index, query_terms(query), distance, facets)

