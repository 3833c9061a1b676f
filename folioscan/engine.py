"""The search engine: an index on disk with its writes and searches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from folioscan.functions.morph import AdvancedQuery, prepare_advanced_query
from folioscan.operators import match, results
from folioscan.operators.index import Index
from folioscan.operators.match import Matches
from folioscan.schema import RESULT_COLUMNS, DocumentInput, HighlightConfig, ResultsOrder, SearchPage
from folioscan.sources.store import Store


class Searcher:
    """Searches of one index: each way of asking gives pages, page and count, chunks, a count, counts by book and by topic."""

    def __init__(self, index: Index):
        self._index = index

    @property
    def index(self) -> Index:
        return self._index

    def _page(self, found: Matches, limit: int, offset: int, order: ResultsOrder, highlight: HighlightConfig | None, marked: bool = True) -> DataFrame:
        return results.page(self.index, found, limit, offset, order, highlight, marked)

    def _page_and_count(self, found: Matches, limit: int, offset: int, order: ResultsOrder, highlight: HighlightConfig | None, marked: bool = True) -> SearchPage:
        return SearchPage(*results.page_and_count(self.index, found, limit, offset, order, highlight=highlight, marked=marked))

    def _chunks(self, found: Matches, limit: int, order: ResultsOrder, size: int, highlight: HighlightConfig | None, marked: bool = True) -> Iterator[list[Row]]:
        return results.chunks(self._page(found, limit, 0, order, highlight, marked), size)

    # patterns ------------------------------------------------------------------------------------------------

    def _regex(self, terms: Sequence[str], facets: Sequence[str], slop: int, max_expansions: int, scored: bool) -> Matches:
        return match.regex(self.index, terms, slop, max_expansions, facets, scored)

    def search(self, regex_terms: Sequence[str], facets: Sequence[str] = (), limit: int = 100, slop: int = 0, max_expansions: int = 50, order: ResultsOrder = ResultsOrder.CATALOGUE, offset: int = 0, highlight: HighlightConfig | None = None) -> DataFrame:
        """Patterns as given. A phrase of several patterns has no fixed terms to mark, so whole texts come back."""
        found = self._regex(regex_terms, facets, slop, max_expansions, order is ResultsOrder.RELEVANCE)
        return self._page(found, limit, offset, order, highlight, len(regex_terms) == 1)

    def search_and_count(self, regex_terms: Sequence[str], facets: Sequence[str] = (), limit: int = 100, slop: int = 0, max_expansions: int = 50, order: ResultsOrder = ResultsOrder.CATALOGUE, offset: int = 0, highlight: HighlightConfig | None = None) -> SearchPage:
        found = self._regex(regex_terms, facets, slop, max_expansions, order is ResultsOrder.RELEVANCE)
        return self._page_and_count(found, limit, offset, order, highlight, len(regex_terms) == 1)

    def search_stream(self, regex_terms: Sequence[str], facets: Sequence[str] = (), limit: int = 100, slop: int = 0, max_expansions: int = 50, order: ResultsOrder = ResultsOrder.CATALOGUE, chunk_size: int = 50, highlight: HighlightConfig | None = None) -> Iterator[list[Row]]:
        found = self._regex(regex_terms, facets, slop, max_expansions, order is ResultsOrder.RELEVANCE)
        return self._chunks(found, limit, order, chunk_size, highlight, len(regex_terms) == 1)

    def count(self, regex_terms: Sequence[str], facets: Sequence[str] = (), slop: int = 0, max_expansions: int = 50) -> int:
        return results.count(self._regex(regex_terms, facets, slop, max_expansions, False))

    def count_by_book(self, regex_terms: Sequence[str], facets: Sequence[str] = (), slop: int = 0, max_expansions: int = 50) -> DataFrame:
        return results.count_by_book(self.index, self._regex(regex_terms, facets, slop, max_expansions, False))

    def get_facet_counts(self, regex_terms: Sequence[str], facet_prefix: str, facets: Sequence[str] = (), slop: int = 0, max_expansions: int = 50) -> DataFrame:
        return results.facet_counts(self.index, self._regex(regex_terms, facets, slop, max_expansions, False), facet_prefix)

    # exact words and phrases ---------------------------------------------------------------------------------

    def search_exact(self, query: str, facets: Sequence[str] = (), limit: int = 100, order: ResultsOrder = ResultsOrder.CATALOGUE, offset: int = 0, highlight: HighlightConfig | None = None) -> DataFrame:
        return self._page(match.exact(self.index, query, facets, order is ResultsOrder.RELEVANCE), limit, offset, order, highlight)

    def search_and_count_exact(self, query: str, facets: Sequence[str] = (), limit: int = 100, order: ResultsOrder = ResultsOrder.CATALOGUE, offset: int = 0, highlight: HighlightConfig | None = None) -> SearchPage:
        return self._page_and_count(match.exact(self.index, query, facets, order is ResultsOrder.RELEVANCE), limit, offset, order, highlight)

    def search_exact_stream(self, query: str, facets: Sequence[str] = (), limit: int = 100, order: ResultsOrder = ResultsOrder.CATALOGUE, chunk_size: int = 50, highlight: HighlightConfig | None = None) -> Iterator[list[Row]]:
        return self._chunks(match.exact(self.index, query, facets, order is ResultsOrder.RELEVANCE), limit, order, chunk_size, highlight)

    def count_exact(self, query: str, facets: Sequence[str] = ()) -> int:
        return results.count(match.exact(self.index, query, facets, False))

    def count_by_book_exact(self, query: str, facets: Sequence[str] = ()) -> DataFrame:
        return results.count_by_book(self.index, match.exact(self.index, query, facets, False))

    def get_facet_counts_exact(self, query: str, facet_prefix: str, facets: Sequence[str] = ()) -> DataFrame:
        return results.facet_counts(self.index, match.exact(self.index, query, facets, False), facet_prefix)

    # advanced queries ----------------------------------------------------------------------------------------

    def _advanced(self, query: str, facets: Sequence[str], options: dict, scored: bool) -> Matches:
        compiled: AdvancedQuery = prepare_advanced_query(query, **options)
        return match.regex(self.index, compiled.regex_terms, compiled.slop, compiled.max_expansions, facets, scored)

    def search_advanced(self, query: str, facets: Sequence[str] = (), limit: int = 100, order: ResultsOrder = ResultsOrder.CATALOGUE, offset: int = 0, highlight: HighlightConfig | None = None, **options) -> DataFrame:
        """``options``: ``distance``, ``custom_spacing``, ``alternative_words``, ``search_options`` of the query compiler."""
        return self._page(self._advanced(query, facets, options, order is ResultsOrder.RELEVANCE), limit, offset, order, highlight)

    def search_and_count_advanced(self, query: str, facets: Sequence[str] = (), limit: int = 100, order: ResultsOrder = ResultsOrder.CATALOGUE, offset: int = 0, highlight: HighlightConfig | None = None, **options) -> SearchPage:
        return self._page_and_count(self._advanced(query, facets, options, order is ResultsOrder.RELEVANCE), limit, offset, order, highlight)

    def search_advanced_stream(self, query: str, facets: Sequence[str] = (), limit: int = 100, order: ResultsOrder = ResultsOrder.CATALOGUE, chunk_size: int = 50, highlight: HighlightConfig | None = None, **options) -> Iterator[list[Row]]:
        return self._chunks(self._advanced(query, facets, options, order is ResultsOrder.RELEVANCE), limit, order, chunk_size, highlight)

    def count_advanced(self, query: str, facets: Sequence[str] = (), **options) -> int:
        return results.count(self._advanced(query, facets, options, False))

    def count_by_book_advanced(self, query: str, facets: Sequence[str] = (), **options) -> DataFrame:
        return results.count_by_book(self.index, self._advanced(query, facets, options, False))

    def get_facet_counts_advanced(self, query: str, facet_prefix: str, facets: Sequence[str] = (), **options) -> DataFrame:
        return results.facet_counts(self.index, self._advanced(query, facets, options, False), facet_prefix)

    # misspelt words ------------------------------------------------------------------------------------------

    def search_fuzzy_terms(self, terms: Sequence[str], facets: Sequence[str] = (), limit: int = 100, max_distance: int = 1, order: ResultsOrder = ResultsOrder.CATALOGUE, offset: int = 0, highlight: HighlightConfig | None = None) -> DataFrame:
        """Terms used as given, without normalising."""
        return self._page(match.fuzzy_terms(self.index, terms, max_distance, facets), limit, offset, order, highlight)

    def search_fuzzy(self, query: str, facets: Sequence[str] = (), limit: int = 100, max_distance: int = 1, order: ResultsOrder = ResultsOrder.CATALOGUE, offset: int = 0, highlight: HighlightConfig | None = None) -> DataFrame:
        return self._page(match.fuzzy(self.index, query, max_distance, facets), limit, offset, order, highlight)

    def search_and_count_fuzzy(self, query: str, facets: Sequence[str] = (), limit: int = 100, max_distance: int = 1, order: ResultsOrder = ResultsOrder.CATALOGUE, offset: int = 0, highlight: HighlightConfig | None = None) -> SearchPage:
        return self._page_and_count(match.fuzzy(self.index, query, max_distance, facets), limit, offset, order, highlight)

    def search_fuzzy_stream(self, query: str, facets: Sequence[str] = (), limit: int = 100, max_distance: int = 1, order: ResultsOrder = ResultsOrder.CATALOGUE, chunk_size: int = 50, highlight: HighlightConfig | None = None) -> Iterator[list[Row]]:
        return self._chunks(match.fuzzy(self.index, query, max_distance, facets), limit, order, chunk_size, highlight)

    def count_fuzzy(self, query: str, facets: Sequence[str] = (), max_distance: int = 1) -> int:
        return results.count(match.fuzzy(self.index, query, max_distance, facets))

    def count_by_book_fuzzy(self, query: str, facets: Sequence[str] = (), max_distance: int = 1) -> DataFrame:
        return results.count_by_book(self.index, match.fuzzy(self.index, query, max_distance, facets))

    def get_facet_counts_fuzzy(self, query: str, facet_prefix: str, facets: Sequence[str] = (), max_distance: int = 1) -> DataFrame:
        return results.facet_counts(self.index, match.fuzzy(self.index, query, max_distance, facets), facet_prefix)

    # all records ---------------------------------------------------------------------------------------------

    def get_document_count(self) -> int:
        return self.index.docs.count()

    def count_documents_by_file_path(self) -> DataFrame:
        return self.index.docs.groupBy("file_path").agg(F.count("*").alias("count"))

    def get_indexed_file_paths(self) -> DataFrame:
        return self.index.docs.select("file_path").distinct()

    def get_document_by_id(self, id: int) -> Row | None:
        """The first record with ``id``, with its whole text, or none."""
        found = self.index.docs.where(F.col("id") == id).orderBy("row_id").limit(1).select(*RESULT_COLUMNS).collect()
        return found[0] if found else None


class SearchEngine(Searcher):
    """An index at ``path``: searches see what was last committed, writes wait until ``commit``."""

    def __init__(self, spark: SparkSession, path: str, **options):
        self._store = Store(spark, path, **options)

    @property
    def index(self) -> Index:
        return self._store.index()

    def add_document(self, doc: DocumentInput) -> None:
        self._store.add([doc])

    def add_documents_batch(self, docs: Sequence[DocumentInput] | DataFrame) -> None:
        self._store.add(docs)

    def upsert_document(self, doc: DocumentInput) -> None:
        self._store.upsert([doc])

    def upsert_documents_batch(self, docs: Sequence[DocumentInput] | DataFrame, order: Sequence[str] = ()) -> None:
        """Records replace all that have their id; the last of a batch with the same id holds, a frame's in the order of the columns ``order``."""
        self._store.upsert(docs, order)

    def delete_document_by_id(self, id: int) -> None:
        self._store.delete(id=[id])

    def remove_documents_by_title(self, title: str) -> None:
        self._store.delete(title=[title])

    def clear(self) -> None:
        self._store.clear()

    def commit(self) -> None:
        self._store.commit()

    def rollback(self) -> None:
        self._store.rollback()

    def optimize(self) -> None:
        self._store.optimize()

    def get_segment_count(self) -> int:
        return self._store.segments()

    def close(self) -> None:
        self._store.close()
