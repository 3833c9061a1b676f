"""The queries of the search engine, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan import bench
from folioscan.engine import Searcher
from folioscan.functions import topics as T
from folioscan.functions.morph import GRAM_PREFIX, GRAM_SUFFIX, PARTIAL, PREFIX, SPELLING, SUFFIX, TYPO, prepare_advanced_query
from folioscan.operators import batch, match, results, updates
from folioscan.operators.index import Index, build_index
from folioscan.plans.oracle import oracle_sql as oracle_sql
from folioscan.plans.shared import materialise
from folioscan.schema import DEFAULTS, STORED, ResultsOrder
from folioscan.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_indexes: dict[tuple[str, str], Index] = {}
_queries: dict[str, Query] = {}


def corpus(spark: SparkSession, directory: str) -> DataFrame:
    """The committed records, topics as paths, missing values as their defaults."""
    rows = table(spark, directory, "document_input").where("committed_at is not null")
    return rows.withColumn("topics", T.tidy(F.col("topics"))).fillna(DEFAULTS).select(*STORED.fieldNames())


def open_index(spark: SparkSession, directory: str) -> Index:
    """The index of a directory's corpus, built once for a session and read from the shared folder afterwards."""
    key = (spark.sparkContext.applicationId, directory)
    if key not in _indexes:
        _indexes[key] = build_index(corpus(spark, directory)).kept(materialise)
    return _indexes[key]


def query(f: Callable[[Index], DataFrame]) -> Callable[[Index], DataFrame]:
    """Register a query on the index of the corpus."""
    _queries[f.__name__] = lambda spark, d: f(open_index(spark, d))
    return f


def on_tables(f: Query) -> Query:
    """Register a query on the tables themselves."""
    _queries[f.__name__] = f
    return f


def flagship(spark: SparkSession, directory: str) -> DataFrame:
    ix = build_index(corpus(spark, directory))
    return results.page(ix, match.exact(ix, "of the", ["/english"], False), 10).select("id", "title", "reference", "file_path", "text")


def queries() -> dict[str, Query]:
    return dict(_queries)


def _page(ix: Index, found: match.Matches, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page without snippets, with the place of each row."""
    rows = results.page(ix, found, limit, offset, marked=False, numbered=True)
    return rows.select("row_id", "id", "title", "reference", "segment", "is_pdf", "file_path")


def _ranked(ix: Index, found: match.Matches, limit: int = 20) -> DataFrame:
    return results.ranked(ix, found, ResultsOrder.RELEVANCE, limit).select("row_id", "id", F.round("score", 6).alias("score"))


# exact ----------------------------------------------------------------------------------------------------------


@query
def exact_term_count(ix: Index) -> DataFrame:
    return results.count_frame(match.exact(ix, "סוחר", scored=False))


@query
def exact_term_page_catalogue(ix: Index) -> DataFrame:
    return _page(ix, match.exact(ix, "court", scored=False))


@query
def exact_term_page_offset(ix: Index) -> DataFrame:
    return _page(ix, match.exact(ix, "the", scored=False), 15, 30)


@query
def exact_phrase2_count(ix: Index) -> DataFrame:
    return results.count_frame(match.exact(ix, "of the", scored=False))


@query
def exact_phrase3_page(ix: Index) -> DataFrame:
    return _page(ix, match.exact(ix, "in the long", scored=False), 50)


@query
def exact_pointed_query(ix: Index) -> DataFrame:
    return results.count_frame(match.exact(ix, "סֵפֶר", scored=False))


@query
def exact_facet_filter(ix: Index) -> DataFrame:
    return results.count_frame(match.exact(ix, "את", ["/עברית/trade"], False))


@query
def exact_multi_facet(ix: Index) -> DataFrame:
    return _page(ix, match.exact(ix, "the", ["/english/law/early", "/english/ethics"], False), 40)


@query
def exact_count_by_book(ix: Index) -> DataFrame:
    return results.count_by_book(ix, match.exact(ix, "the", scored=False))


@query
def exact_facet_counts(ix: Index) -> DataFrame:
    return results.facet_counts(ix, match.exact(ix, "הוא", scored=False), "/עברית")


@query
def exact_facet_counts_root(ix: Index) -> DataFrame:
    return results.facet_counts(ix, match.exact(ix, "הוא", scored=False), "/")


@query
def exact_search_and_count(ix: Index) -> DataFrame:
    total, rows = results.page_and_count(ix, match.exact(ix, "witness", scored=False), 5, marked=False, numbered=True)
    return rows.select("row_id", "id", F.lit(total).cast("long").alias("total_count"))


@query
def exact_relevance_bm25(ix: Index) -> DataFrame:
    return _ranked(ix, match.exact(ix, "court"))


@query
def exact_phrase_relevance_bm25(ix: Index) -> DataFrame:
    return _ranked(ix, match.exact(ix, "of the"))


# patterns -------------------------------------------------------------------------------------------------------


@query
def regex_single_count(ix: Index) -> DataFrame:
    return results.count_frame(match.regex(ix, ["contract.*"], 0, 1000))


@query
def regex_single_page(ix: Index) -> DataFrame:
    return _page(ix, match.regex(ix, [".{0,2}מולד"], 0, 1000), 30)


@query
def regex_alternation(ix: Index) -> DataFrame:
    return results.count_frame(match.regex(ix, ["(?:מותר|אסור|חייב|פטור|דין)"], 0, 50))


@query
def regex_class_quantifier(ix: Index) -> DataFrame:
    return results.count_frame(match.regex(ix, ["[bc]o[a-z]{2,4}t+"], 0, 2000))


@query
def regex_phrase_slop0(ix: Index) -> DataFrame:
    return results.count_frame(match.regex(ix, ["th.{1,2}", "co.*"], 0, 5000, scored=False))


@query
def regex_phrase_slop2(ix: Index) -> DataFrame:
    return results.count_frame(match.regex(ix, ["of", "the"], 2, 100, scored=False))


@query
def regex_phrase3_slop(ix: Index) -> DataFrame:
    return _page(ix, match.regex(ix, ["in", "th.", "l.{3}"], 3, 5000, scored=False), 60)


@query
def regex_phrase4_slop(ix: Index) -> DataFrame:
    return results.count_frame(match.regex(ix, ["of", "the", "in", "and"], 5, 100, scored=False))


@query
def regex_phrase_facet(ix: Index) -> DataFrame:
    return results.count_frame(match.regex(ix, ["את", "ה.*"], 1, 5000, ["/עברית/law", "/עברית/ethics/late"], False, refuse=False))


@query
def regex_count_by_book(ix: Index) -> DataFrame:
    return results.count_by_book(ix, match.regex(ix, ["[וב]?סוחר"], 0, 100))


@query
def regex_facet_counts(ix: Index) -> DataFrame:
    return results.facet_counts(ix, match.regex(ix, ["judge.*"], 0, 100), "/english")


@query
def regex_expansion_terms(ix: Index) -> DataFrame:
    terms = match.expand(ix, "pri[a-z]+", 1000)
    return ix.vocabulary.where(F.col("term").isin(terms)).select("term", "df")


# misspelt -------------------------------------------------------------------------------------------------------


@query
def fuzzy_d0(ix: Index) -> DataFrame:
    return results.count_frame(match.fuzzy(ix, "court", 0))


@query
def fuzzy_d1_count(ix: Index) -> DataFrame:
    return results.count_frame(match.fuzzy(ix, "court", 1))


@query
def fuzzy_d1_terms(ix: Index) -> DataFrame:
    return match.misspelt(ix, "סוחר", 1)


@query
def fuzzy_d2_terms(ix: Index) -> DataFrame:
    return match.misspelt(ix, "witness", 2)


@query
def fuzzy_d1_multi_and(ix: Index) -> DataFrame:
    return results.count_frame(match.fuzzy(ix, "court judge", 1))


@query
def fuzzy_d2_page(ix: Index) -> DataFrame:
    return _page(ix, match.fuzzy(ix, "lawsuit", 2), 40)


@query
def fuzzy_facets(ix: Index) -> DataFrame:
    return results.count_frame(match.fuzzy(ix, "lawsuit", 1, ["/english/law"]))


@query
def fuzzy_count_by_book(ix: Index) -> DataFrame:
    return results.count_by_book(ix, match.fuzzy(ix, "חודש", 1))


@query
def fuzzy_facet_counts(ix: Index) -> DataFrame:
    return results.facet_counts(ix, match.fuzzy(ix, "month", 1), "/english")


@query
def fuzzy_given_terms(ix: Index) -> DataFrame:
    return results.count_frame(match.fuzzy_terms(ix, ["Court", "judge"], 1))


# advanced -------------------------------------------------------------------------------------------------------


def _advanced(ix: Index, text: str, facets: tuple[str, ...] = (), **options) -> match.Matches:
    q = prepare_advanced_query(text, **options)
    return match.regex(ix, q.regex_terms, q.slop, q.max_expansions, facets, False)


@query
def advanced_plain_phrase(ix: Index) -> DataFrame:
    return results.count_frame(_advanced(ix, "Of, the!", distance=1))


@query
def advanced_prefix(ix: Index) -> DataFrame:
    return results.count_frame(_advanced(ix, "לוח", search_options={"לוח_0": {PREFIX: True}}))


@query
def advanced_suffix(ix: Index) -> DataFrame:
    return results.count_frame(_advanced(ix, "judge", search_options={"judge_0": {SUFFIX: True}}))


@query
def advanced_partial(ix: Index) -> DataFrame:
    return _page(ix, _advanced(ix, "מולד", search_options={"מולד_0": {PARTIAL: True}}), 40)


@query
def advanced_grammatical_prefix(ix: Index) -> DataFrame:
    return results.count_frame(_advanced(ix, "ספר", search_options={"ספר_0": {GRAM_PREFIX: True}}))


@query
def advanced_grammatical_suffix(ix: Index) -> DataFrame:
    return results.count_frame(_advanced(ix, "חוד", search_options={"חוד_0": {GRAM_SUFFIX: True}}))


@query
def advanced_full_morphology(ix: Index) -> DataFrame:
    return results.count_frame(_advanced(ix, "דין", search_options={"דין_0": {GRAM_PREFIX: True, GRAM_SUFFIX: True}}))


@query
def advanced_spelling(ix: Index) -> DataFrame:
    return results.count_frame(_advanced(ix, "סידור", search_options={"סידור_0": {SPELLING: True}}))


@query
def advanced_typo(ix: Index) -> DataFrame:
    return results.count_frame(_advanced(ix, "כתב", search_options={"כתב_0": {TYPO: True}}))


@query
def advanced_alternatives(ix: Index) -> DataFrame:
    return results.count_frame(_advanced(ix, "court", alternative_words={0: ["Tribunal", "judge"]}))


@query
def advanced_custom_spacing(ix: Index) -> DataFrame:
    return results.count_frame(_advanced(ix, "of the", custom_spacing={"0-1": "3"}, distance=9))


@query
def advanced_count_by_book(ix: Index) -> DataFrame:
    return results.count_by_book(ix, _advanced(ix, "לוח", search_options={"לוח_0": {GRAM_PREFIX: True}}))


@query
def advanced_facet_counts(ix: Index) -> DataFrame:
    return results.facet_counts(ix, _advanced(ix, "judge", search_options={"judge_0": {SUFFIX: True}}), "/english/law")


# all records ----------------------------------------------------------------------------------------------------


@query
def empty_query(ix: Index) -> DataFrame:
    return _page(ix, match.exact(ix, "?!", ["/english"]))


@query
def docs_by_file_path(ix: Index) -> DataFrame:
    return Searcher(ix).count_documents_by_file_path()


@query
def indexed_file_paths(ix: Index) -> DataFrame:
    return Searcher(ix).get_indexed_file_paths()


@query
def document_count(ix: Index) -> DataFrame:
    return ix.docs.agg(F.count("*").alias("documents"))


@query
def get_document_by_id(ix: Index) -> DataFrame:
    """The record with the least id in the corpus, whole."""
    least = ix.docs.agg(F.min("id").alias("id")).first().id
    return ix.docs.where(F.col("id") == least).orderBy("row_id").limit(1).select("id", "title", "reference", "text", "segment", "is_pdf", "file_path")


@query
def vocabulary_frequencies(ix: Index) -> DataFrame:
    return ix.vocabulary


@query
def document_lengths(ix: Index) -> DataFrame:
    return ix.lengths


@query
def topic_tree(ix: Index) -> DataFrame:
    """Records at and under every topic path."""
    return ix.docs.select(F.explode(T.ancestors(F.col("topics"))).alias("path")).groupBy("path").agg(F.count("*").alias("documents"))


@query
def snippet_page(ix: Index) -> DataFrame:
    return results.page(ix, match.exact(ix, "of the"), 20, order=ResultsOrder.RELEVANCE)


@query
def stream_chunks(ix: Index) -> DataFrame:
    """A page of 45 in chunks of 20: rows in each."""
    got = results.chunks(results.page(ix, match.exact(ix, "the", scored=False), 45, marked=False), 20)
    return ix.spark.createDataFrame([(n, len(rows)) for n, rows in enumerate(got)], "chunk long, n_rows long")


# writes ---------------------------------------------------------------------------------------------------------


@on_tables
def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "document_input").select("row_id", "id", "title", "segment", "added_at")
    return updates.last_of_each(rows, "id", "added_at", "row_id").select("id", "row_id", "title", "segment")


@on_tables
def delete_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Records by file once those that were ever returned by a search are deleted."""
    return updates.without(corpus(spark, d), table(spark, d, "search_result"), "id").groupBy("file_path").agg(F.count("*").alias("count"))


@on_tables
def delete_by_title(spark: SparkSession, d: str) -> DataFrame:
    """Records by file once those with a title in the list of scanned books are deleted."""
    return updates.without(corpus(spark, d), table(spark, d, "book_list").where("is_pdf"), "title").groupBy("file_path").agg(F.count("*").alias("count"))


@on_tables
def uncommitted_by_file(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "document_input").where("committed_at is null")
    return rows.groupBy("file_path").agg(F.count("*").alias("count"))


# compatibility and timings --------------------------------------------------------------------------------------


@on_tables
def checks_by_status(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "index_check")
    return rows.groupBy("status").agg(F.count("*").alias("checks"), F.sum(F.col("compatible").cast("long")).alias("compatible"), F.count("found_schema_version").alias("with_version"))


@on_tables
def latest_check(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "index_check").select("metadata_path", "check_id", "status", "checked_at")
    return updates.last_of_each(rows, "metadata_path", "checked_at", "check_id").select("metadata_path", "check_id", "status")


def _timings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark_result").join(table(spark, d, "benchmark_case").select("query_name", "regex_terms"), "query_name")


@on_tables
def bench_summary(spark: SparkSession, d: str) -> DataFrame:
    return bench.summary(_timings(spark, d))


@on_tables
def bench_speeds(spark: SparkSession, d: str) -> DataFrame:
    return bench.speeds(_timings(spark, d))


@on_tables
def bench_patterns(spark: SparkSession, d: str) -> DataFrame:
    return bench.patterns(_timings(spark, d))


@on_tables
def bench_by_complexity(spark: SparkSession, d: str) -> DataFrame:
    return bench.by_complexity(_timings(spark, d))


@on_tables
def bench_by_keyword(spark: SparkSession, d: str) -> DataFrame:
    return bench.by_keyword(_timings(spark, d))


@on_tables
def bench_slow_runs(spark: SparkSession, d: str) -> DataFrame:
    return bench.slow_runs(_timings(spark, d))


@on_tables
def bench_by_group(spark: SparkSession, d: str) -> DataFrame:
    return bench.by_group(_timings(spark, d))


@on_tables
def bench_hebrew_slow(spark: SparkSession, d: str) -> DataFrame:
    return bench.hebrew_slow(_timings(spark, d))


@on_tables
def bench_impacts(spark: SparkSession, d: str) -> DataFrame:
    return bench.impacts(_timings(spark, d))


@on_tables
def bench_diagnostic(spark: SparkSession, d: str) -> DataFrame:
    """The built-in diagnostic cases; a case that stands for too many terms has no count."""
    told = bench.RegexBenchmarker(spark, Searcher(open_index(spark, d))).run_diagnostic()
    return told.select("query_name", F.col("result_count").cast("long").alias("result_count"), F.col("error").isNotNull().alias("failed"))


@on_tables
def bench_memory(spark: SparkSession, d: str) -> DataFrame:
    memory = bench.estimated_memory_column(F.col("regex_terms"), F.col("max_expansions"))
    return table(spark, d, "benchmark_case").select("query_name", F.round(memory, 6).alias("memory_usage_mb"))


@on_tables
def case_hits(spark: SparkSession, d: str) -> DataFrame:
    """All stored cases in one pass."""
    return batch.case_hits(open_index(spark, d), table(spark, d, "benchmark_case"))


@on_tables
def bench_suite(spark: SparkSession, d: str) -> DataFrame:
    """The built-in cases, each run once."""
    return bench.RegexBenchmarker(spark, Searcher(open_index(spark, d))).run_comprehensive_benchmark(["the", "court", "judge", "witness"], 0, 1)


@on_tables
def results_by_query(spark: SparkSession, d: str) -> DataFrame:
    """Returned pages by query: rows, distinct rows, searches, and rows with a marked term."""
    rows = table(spark, d, "search_result")
    marked = F.sum(F.coalesce(F.col("text").contains("<font color=red>"), F.lit(False)).cast("long"))
    distinct = F.count_distinct(F.struct("search_id", "hit_no", "id"))
    return rows.groupBy("query_name").agg(F.count("*").alias("n_rows"), distinct.alias("distinct_rows"), F.count_distinct("search_id").alias("searches"), marked.alias("marked"))
