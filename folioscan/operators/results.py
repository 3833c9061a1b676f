"""What a search returns: pages, counts, counts by file or topic, chunks, highlighted snippets."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from folioscan.functions import topics as T
from folioscan.functions.analysis import LONGEST
from folioscan.operators.index import Index
from folioscan.operators.match import Matches
from folioscan.schema import DEFAULTS, HIGHLIGHT_TERMS, RESULT_COLUMNS, HighlightConfig, ResultsOrder


def count(matches: Matches) -> int:
    return matches.rows.count()


def count_frame(matches: Matches) -> DataFrame:
    return matches.rows.agg(F.count("*").alias("total_count"))


def count_by_book(index: Index, matches: Matches) -> DataFrame:
    """``(file_path, count)`` of the matching records."""
    return matches.rows.join(index.docs.select("row_id", "file_path"), "row_id").groupBy("file_path").agg(F.count("*").alias("count"))


def facet_counts(index: Index, matches: Matches, prefix: str) -> DataFrame:
    """``(path, count)`` for each child of ``prefix`` that holds matching records; records at ``prefix`` itself don't count."""
    found = matches.rows.join(index.docs.select("row_id", "topics"), "row_id").select(T.child(F.col("topics"), prefix).alias("path"))
    return found.where("path is not null").groupBy("path").agg(F.count("*").alias("count"))


def ranked(index: Index, matches: Matches, order: ResultsOrder, limit: int, offset: int = 0) -> DataFrame:
    """``(row_id, id, score)`` of a page. Equal ids or scores come in order of ``row_id``. A limit of 0 gives no rows."""
    rows = matches.rows
    if order is ResultsOrder.RELEVANCE:
        top = rows.orderBy(F.desc("score"), "row_id").offset(offset).limit(limit)
        return top.join(index.docs.select("row_id", "id"), "row_id").select("row_id", "id", "score")
    return rows.join(index.docs.select("row_id", "id"), "row_id").orderBy("id", "row_id").offset(offset).limit(limit).select("row_id", "id", "score")


def _snippet(text: str, weights: dict[str, float], config: HighlightConfig) -> str:
    """The fragment of ``text`` with the highest sum of weights, its terms wrapped; empty if it has none."""
    import regex

    best: tuple[float, int, int, list[tuple[int, int]]] = (0.0, 0, 0, [])
    start, end, sum_, marks = None, 0, 0.0, []
    octets = lambda a, b: len(text[a:b].encode())
    for m in regex.finditer(r"[\p{Alphabetic}\p{N}]+", text):
        if start is not None and octets(start, m.end()) > config.max_chars:
            if sum_ > best[0]:
                best = (sum_, start, end, marks)
            start, sum_, marks = None, 0.0, []
        if start is None:
            start = m.start()
        end = m.end()
        if len(m.group().encode()) < LONGEST and (w := weights.get(m.group().lower())):
            sum_ += w
            marks = [*marks, m.span()]
    if start is not None and sum_ > best[0]:
        best = (sum_, start, end, marks)
    if not best[3]:
        return ""
    out, at = [], best[1]
    for a, b in best[3]:
        out += [html.escape(text[at:a], quote=True), config.highlight_prefix, html.escape(text[a:b], quote=True), config.highlight_postfix]
        at = b
    return "".join([*out, html.escape(text[at : best[2]], quote=True)])


def highlight_weights(index: Index, matches: Matches) -> dict[str, float]:
    """Terms to mark with their weights ``1 / (1 + df)``: at most ``HIGHLIGHT_TERMS``, shared evenly by the slots.

    Terms of an earlier slot don't count against a later one.
    """
    budget = max(HIGHLIGHT_TERMS // max(len(matches.slots), 1), 1)
    chosen: dict[str, None] = {}
    for slot in matches.slots:
        terms = [r.term for r in slot.orderBy("term").limit(budget + len(chosen)).collect()] if isinstance(slot, DataFrame) else slot
        fresh = [t for t in terms if t not in chosen][:budget]
        chosen.update(dict.fromkeys(fresh))
    if not chosen:
        return {}
    return {r.term: 1 / (1 + r.df) for r in index.vocabulary.where(F.col("term").isin(list(chosen))).collect()}


def _weights(index: Index, matches: Matches) -> dict[str, float]:
    """``highlight_weights``, or none where they can't be told: a page without marks is better than none."""
    try:
        return highlight_weights(index, matches)
    except Exception:  # noqa: BLE001  marks are an extra; whatever is wrong with the records themselves shows when they are read
        return {}


def page(
    index: Index,
    matches: Matches,
    limit: int,
    offset: int = 0,
    order: ResultsOrder = ResultsOrder.CATALOGUE,
    highlight: HighlightConfig | None = None,
    marked: bool = True,
    numbered: bool = False,
    top: DataFrame | None = None,
) -> DataFrame:
    """A page of results in order (that of ``top`` if it is known already). Only the page's records are fetched; ``text`` is a snippet, or the whole text where
    nothing is to be marked. ``numbered`` keeps the row's place in column ``n``.
    """
    config = highlight or HighlightConfig()
    top = ranked(index, matches, order, limit, offset) if top is None else top
    by = [F.desc("score"), F.asc("row_id")] if order is ResultsOrder.RELEVANCE else [F.asc("id"), F.asc("row_id")]
    fetched = index.docs.drop("id").join(top, "row_id").fillna(DEFAULTS)
    weights = _weights(index, matches) if marked and not matches.empty else {}
    if weights:

        @F.pandas_udf("string")
        def snippet(texts: pd.Series) -> pd.Series:
            return pd.Series([_snippet(t, weights, config) or t for t in texts], dtype=object)

        fetched = fetched.withColumn("text", snippet("text"))
    return fetched.orderBy(*by).select(*RESULT_COLUMNS, *(["row_id"] if numbered else []))


def page_and_count(index: Index, matches: Matches, limit: int, offset: int = 0, order: ResultsOrder = ResultsOrder.CATALOGUE, **options) -> tuple[int, DataFrame]:
    """How many records match, and a page of them; the search itself runs once. ``options`` are those of ``page``."""
    rows = matches.rows.persist()
    try:
        total = rows.count()
        found = ranked(index, Matches(rows, matches.slots), order, limit, offset).collect() if total and limit else []  # a page
    finally:
        rows.unpersist()
    top = index.spark.createDataFrame(found, "row_id long, id long, score double")
    return total, page(index, matches, limit, offset, order, top=top, **options)


def chunks(frame: DataFrame, size: int) -> Iterator[list[Row]]:
    """The rows of a page in lists of ``size`` (at least 1), fetched partition by partition as they are wanted."""
    held: list[Row] = []
    for row in frame.toLocalIterator():
        held.append(row)
        if len(held) == max(size, 1):
            yield held
            held = []
    if held:
        yield held

