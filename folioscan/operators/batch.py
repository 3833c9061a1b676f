"""Many stored searches over one index in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import topics as T
from folioscan.operators.index import Index
from folioscan.operators.match import placements, whole_term

#: Terms of all searches together that are broadcast to the postings; more are joined.
BROADCAST_TERMS = 100_000
MATCHED, NO_TERMS, TOO_MANY = "matched", "no terms", "too many terms"


def _state(sizes: list[int], cap: int) -> str:
    """What becomes of a search whose patterns stand for so many terms each, in order."""
    left = cap
    for n in sizes:
        if n == 0:
            return NO_TERMS
        if n > left:
            return TOO_MANY
        left -= n if len(sizes) > 1 else 0
    return MATCHED if sizes else NO_TERMS


def case_hits(index: Index, cases: DataFrame) -> DataFrame:
    """``(query_name, status, total_count)`` for each stored search ``(query_name, regex_terms, facets, slop, max_expansions)``.

    The searches are a stated set and are read to the driver. All their patterns are resolved in one scan of the vocabulary and all their
    terms, of which the searches allow a bounded number, in one scan of the postings; a record's positions are brought
    together once and held against every search. A search that allows too few terms has no count.
    """
    spark = index.spark
    rows = cases.select("query_name", "regex_terms", "facets", "slop", "max_expansions").collect()
    patterns = sorted({p for r in rows for p in r.regex_terms or ()})
    number = {p: n for n, p in enumerate(patterns)}
    if not patterns:
        return spark.createDataFrame([(r.query_name, NO_TERMS, 0) for r in rows], "query_name string, status string, total_count long")
    tests = F.array_compact(F.array(*[F.when(F.col("term").rlike(whole_term(p)), F.lit(n)) for p, n in number.items()]))
    matched = index.vocabulary.select("term", F.explode(tests).alias("pattern"))
    sizes = {r.pattern: r.n for r in matched.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    states = [_state([sizes.get(number[p], 0) for p in r.regex_terms or ()], r.max_expansions) for r in rows]
    live = [r for r, s in zip(rows, states) if s == MATCHED]
    counts: dict[str, int] = {}
    if live:
        wanted = sorted({number[p] for r in live for p in r.regex_terms})
        terms = matched.where(F.col("pattern").isin(wanted))
        if sum(sizes[n] for n in wanted) <= BROADCAST_TERMS:
            terms = F.broadcast(terms)
        placed = index.postings.join(terms, "term").groupBy("row_id", "pattern").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
        per_row = placed.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("pattern", "positions"))).alias("at"))
        held = per_row.join(index.docs.select("row_id", "topics"), "row_id")
        hits = []
        for r in live:
            slots = [F.col("at")[F.lit(number[p])] for p in r.regex_terms]
            found = reduce(lambda a, b: a & b, [s.isNotNull() for s in slots])
            if len(slots) > 1:
                found &= placements(slots, r.slop) > 0
            if r.facets:
                found &= T.under_any(F.col("topics"), list(r.facets))
            hits.append(F.when(found, F.lit(r.query_name)))
        counted = held.select(F.explode(F.array_compact(F.array(*hits))).alias("query_name")).groupBy("query_name").agg(F.count("*").alias("n"))
        counts = {r.query_name: r.n for r in counted.collect()}
    told = [(r.query_name, s, None if s == TOO_MANY else counts.get(r.query_name, 0)) for r, s in zip(rows, states)]
    return spark.createDataFrame(told, "query_name string, status string, total_count long")
