"""Queries that go through the engine itself: its writes, scores, snippets, limits and checks, with their SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.engine import SearchEngine
from folioscan.functions import topics as T
from folioscan.functions.morph import GRAM_PREFIX, PARTIAL, SUFFIX, TYPO, prepare_advanced_query
from folioscan.operators import match, results
from folioscan.operators.index import Index
from folioscan.plans.catalogue import Query, open_index
from folioscan.plans.oracle import _DOCS, _POSTINGS, _RICH, _TOKEN, _close, _like, _page, _phrase, _term, _under
from folioscan.plans.shared import materialise, shared_dir
from folioscan.schema import DEFAULTS, DOCUMENT, META_FILE, SCHEMA_VERSION, DocumentInput, ExpansionError, HighlightConfig, ResultsOrder
from folioscan.sources.files import files_at
from folioscan.sources.store import MANIFEST, WriterLocked, check_index_compatibility
from folioscan.sources.tables import table

_queries: dict[str, Query] = {}
_told: dict[tuple[str, str], dict[str, DataFrame]] = {}
_SHORT = 800


def _engine_story(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """What an engine tells after each step of a life on the corpus: records added, upserted, deleted, rolled back, merged, cleared."""
    key = (spark.sparkContext.applicationId, d)
    if key in _told:
        return _told[key]
    rows = table(spark, d, "document_input").where("committed_at is not null").withColumn("topics", T.tidy(F.col("topics"))).fillna(DEFAULTS)
    path = f"{shared_dir(spark)}/folioscan-engine-{uuid.uuid4().hex}"
    engine = SearchEngine(spark, path)
    told: dict[str, DataFrame] = {}
    segments: list[tuple[str, int]] = []
    singles: list[tuple[str, int]] = []
    by_file = lambda: materialise(engine.count_documents_by_file_path())
    segments.append(("empty", engine.get_segment_count()))
    engine.add_documents_batch(rows.where("not is_pdf").select(*DOCUMENT.fieldNames()))
    engine.commit()
    told["engine_add_batch"] = by_file()
    segments.append(("added", engine.get_segment_count()))
    engine.upsert_documents_batch(rows.where("is_pdf"), order=["added_at", "row_id"])
    singles.append(("before commit", engine.get_document_count()))
    engine.commit()
    docs = engine.index.docs
    told["engine_upsert_batch"] = materialise(docs.select("id", "title", "reference", "segment", "is_pdf", "file_path", F.md5("text").alias("text_md5")))
    segments.append(("upserted", engine.get_segment_count()))
    for r in docs.select("id").distinct().orderBy("id").limit(5).collect():
        engine.delete_document_by_id(r.id)
    engine.commit()
    told["engine_delete_by_id"] = by_file()
    for r in table(spark, d, "book_list").select("title").orderBy("title").limit(3).collect():
        engine.remove_documents_by_title(r.title)
    engine.commit()
    told["engine_delete_by_title"] = by_file()
    told["engine_vocabulary"] = materialise(engine.index.vocabulary)
    other = SearchEngine(spark, path)
    told["engine_reopened"] = materialise(other.count_by_book_exact("the"))
    try:
        other.add_document(_single("locked out"))
        lock = "open"
    except WriterLocked:
        lock = "locked"
    engine.add_document(_single("zyxw"))
    engine.commit()
    singles.append(("added", other.count_exact("zyxw")))
    engine.upsert_document(_single("wxyz"))
    engine.commit()
    singles += [("replaced", other.count_exact("zyxw")), ("upserted", other.count_exact("wxyz"))]
    engine.add_document(_single("zyxw"))
    engine.rollback()
    engine.commit()
    singles.append(("rolled back", other.count_exact("zyxw")))
    engine.delete_document_by_id(-1)
    engine.commit()
    segments.append(("singles", engine.get_segment_count()))
    engine.optimize()
    segments.append(("merged", engine.get_segment_count()))
    told["engine_optimized"] = by_file()
    engine.clear()
    engine.commit()
    singles.append(("cleared", engine.get_document_count()))
    segments.append(("cleared", engine.get_segment_count()))
    engine.close()
    other.add_document(_single("at last"))
    told["engine_lock"] = spark.createDataFrame([("while another writes", lock), ("afterwards", "open")], "moment string, lock string")
    other.close()
    told["engine_segments"] = spark.createDataFrame(segments, "step string, segments long")
    told["engine_singles"] = spark.createDataFrame(singles, "step string, hits long")
    files_at(path, spark).delete("")
    _told[key] = told
    return told


def _single(text: str) -> DocumentInput:
    return DocumentInput(-1, "single", "", "/single", text, 0, False, "single")


_STORY = ["engine_add_batch", "engine_upsert_batch", "engine_delete_by_id", "engine_delete_by_title", "engine_vocabulary", "engine_reopened", "engine_lock", "engine_optimized", "engine_segments", "engine_singles"]
_queries |= {name: (lambda spark, d, name=name: _engine_story(spark, d)[name]) for name in _STORY}


def _on_index(f):
    _queries[f.__name__] = lambda spark, d: f(open_index(spark, d))
    return f


def _on_tables(f):
    _queries[f.__name__] = f
    return f


def _scores(ix: Index, found: match.Matches) -> DataFrame:
    return results.ranked(ix, found, ResultsOrder.RELEVANCE, 30).select("row_id", "id", F.round("score", 6).alias("score"))


@_on_index
def score_regex_constant(ix: Index) -> DataFrame:
    return _scores(ix, match.regex(ix, ["judge.*"], 0, 100))


@_on_index
def score_regex_phrase(ix: Index) -> DataFrame:
    return _scores(ix, match.regex(ix, ["th.", "co.*t"], 0, 5000))


@_on_index
def score_fuzzy_clauses(ix: Index) -> DataFrame:
    return _scores(ix, match.fuzzy(ix, "court judge", 1, ["/english"]))


@_on_index
def score_facet_clause(ix: Index) -> DataFrame:
    return _scores(ix, match.exact(ix, "court", ["/english/law"]))


@_on_index
def limit_zero(ix: Index) -> DataFrame:
    return results.page(ix, match.exact(ix, "the", scored=False), 0, marked=False).select("id", "title", "file_path")


@_on_index
def refused_queries(ix: Index) -> DataFrame:
    """What the engine refuses, by name of the check."""
    tries = {
        "distance over 2": lambda: match.fuzzy(ix, "court", 3),
        "negative distance": lambda: match.fuzzy_terms(ix, ["court"], -1),
        "topic without slash": lambda: match.exact(ix, "court", ["english"]),
        "pattern with an anchor": lambda: match.regex(ix, ["^court"], 0, 10),
        "anchor at the end": lambda: match.regex(ix, ["court$"], 0, 10),
        "too many terms": lambda: match.regex(ix, [".*"], 0, 10),
        "no anchor in a class": lambda: match.regex(ix, ["[^x]ourt"], 0, 10),
    }
    rows = []
    for name, ask in tries.items():
        try:
            ask()
            rows.append((name, "accepted"))
        except ExpansionError:
            rows.append((name, "too many terms"))
        except ValueError:
            rows.append((name, "refused"))
    return ix.spark.createDataFrame(rows, "check string, outcome string")


@_on_tables
def expansion_limits(spark: SparkSession, d: str) -> DataFrame:
    """How many terms advanced queries may stand for."""
    asked = {
        "one word": ("court", {}), "two words": ("court judge", {}), "typing errors": ("court", {"court_0": {TYPO: True}}), "two words, typing errors": ("court judge", {"court_0": {TYPO: True}}),
        "one letter": ("a", {"a_0": {SUFFIX: True}}), "two letters": ("ab", {"ab_0": {SUFFIX: True}}), "three letters": ("abc", {"abc_0": {PARTIAL: True}}), "long word": ("courtyard", {"courtyard_0": {GRAM_PREFIX: True}}),
        "shorter of two": ("ab courtyard", {"ab_0": {SUFFIX: True}, "courtyard_1": {SUFFIX: True}}),
    }
    return spark.createDataFrame([(k, prepare_advanced_query(q, search_options=o).max_expansions) for k, (q, o) in asked.items()], "query string, max_expansions long")


def _marked(ix: Index, found: match.Matches, config: HighlightConfig | None = None, marked: bool = True) -> DataFrame:
    """Snippets of all hits whose text is short enough to be one fragment."""
    short = ix.docs.where(F.octet_length("text") <= _SHORT).select("row_id")
    few = match.Matches(found.rows.join(short, "row_id", "left_semi"), found.slots)
    return results.page(ix, few, 100_000, highlight=config, marked=marked, numbered=True).select("row_id", "text")


@_on_index
def snippet_exact(ix: Index) -> DataFrame:
    return _marked(ix, match.exact(ix, "of the", scored=False))


@_on_index
def snippet_own_marks(ix: Index) -> DataFrame:
    return _marked(ix, match.exact(ix, "ספר", scored=False), HighlightConfig("<<", ">>", _SHORT))


@_on_index
def snippet_regex(ix: Index) -> DataFrame:
    return _marked(ix, match.regex(ix, ["judge.*"], 0, 100, scored=False))


@_on_index
def snippet_advanced(ix: Index) -> DataFrame:
    q = prepare_advanced_query("ספר", search_options={"ספר_0": {GRAM_PREFIX: True}})
    return _marked(ix, match.regex(ix, q.regex_terms, q.slop, q.max_expansions, scored=False))


@_on_index
def snippet_fuzzy(ix: Index) -> DataFrame:
    return _marked(ix, match.fuzzy(ix, "court", 1))


@_on_index
def snippet_of_phrases_is_the_text(ix: Index) -> DataFrame:
    """Patterns of a phrase mark nothing: the texts come back whole."""
    return _marked(ix, match.regex(ix, ["of", "the"], 0, 100, scored=False), marked=False)


@_on_index
def highlight_budget(ix: Index) -> DataFrame:
    """Terms that are marked of a pattern that stands for many, and of two that share the budget."""
    many = match.regex(ix, [".*"], 0, 1_000_000, scored=False, refuse=False)
    two = match.Matches(many.rows, [many.slots[0], ["court"]])
    return ix.spark.createDataFrame([("one", len(results.highlight_weights(ix, many))), ("two", len(results.highlight_weights(ix, two)))], "slots string, marked long")


@_on_tables
def compatibility_states(spark: SparkSession, d: str) -> DataFrame:
    """What is told of folders in all states that an index can be in."""
    base = f"{shared_dir(spark)}/folioscan-states-{uuid.uuid4().hex}"
    told = []

    def state(name: str, path: str) -> None:
        s = check_index_compatibility(path, spark)
        told.append((name, s.compatible, s.status, s.found_schema_version))

    SearchEngine(spark, f"{base}/index").close()
    files = files_at(f"{base}/index", spark)
    meta, manifest = json.loads(files.read(META_FILE)), json.loads(files.read(MANIFEST))
    state("fresh", f"{base}/index")
    state("absent", f"{base}/none")
    state("a file", f"{base}/index/{META_FILE}")
    for name, change in (("older", {"schema_version": SCHEMA_VERSION - 1}), ("newer", {"schema_version": SCHEMA_VERSION + 1}), ("another format", {"format": "other"})):
        files.replace(META_FILE, json.dumps(meta | change))
        state(name, f"{base}/index")
    files.replace(META_FILE, "{")
    state("broken", f"{base}/index")
    files.delete(META_FILE)
    state("without metadata", f"{base}/index")
    files.replace(MANIFEST, json.dumps(manifest | {"schema": [f | {"indexed": False} if f["name"] == "id" else f for f in manifest["schema"]]}))
    state("id not indexed", f"{base}/index")
    files.delete(MANIFEST)
    state("nothing in it", f"{base}/index")
    files_at(base, spark).delete("")
    return spark.createDataFrame(told, "folder string, compatible boolean, status string, found_schema_version int")


def queries() -> dict[str, Query]:
    return dict(_queries)


_COLUMNS = "id, title, reference, segment, is_pdf, file_path, text"
_LIVE = f"""{_DOCS},
  pdf AS (SELECT docs.*, row_number() OVER (PARTITION BY docs.id ORDER BY added_at DESC, row_id DESC) AS n FROM docs JOIN (SELECT row_id, added_at FROM document_input) USING (row_id) WHERE is_pdf),
  upserted AS (SELECT {_COLUMNS} FROM docs WHERE NOT is_pdf AND id NOT IN (SELECT id FROM pdf) UNION ALL SELECT {_COLUMNS} FROM pdf WHERE n = 1),
  without_ids AS (SELECT * FROM upserted WHERE id NOT IN (SELECT DISTINCT id FROM upserted ORDER BY id LIMIT 5)),
  live AS (SELECT * FROM without_ids WHERE title NOT IN (SELECT title FROM book_list ORDER BY title LIMIT 3))"""
_LIVE_TERMS = f"(SELECT id, n, lower(unnest(a)) AS term FROM (SELECT id, row_number() OVER () AS n, list_filter(regexp_extract_all(text, '{_TOKEN}'), lambda x: strlen(x) < 40) AS a FROM live))"


def _values(columns: str, rows: list[str]) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) AS t({columns})"


def _wrapped(hits: str, test: str, before: str = "<font color=red>", after: str = "</font>") -> str:
    """Short texts of hits from the first token to the last, signs escaped, tokens that pass ``test`` (on ``term``) between marks."""
    escaped = "replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
    outer = _TOKEN[1:-2]
    return f"""{hits}, parts AS (SELECT row_id, unnest(p) AS x, unnest(range(len(p))) AS k FROM (SELECT row_id, regexp_extract_all(regexp_replace(regexp_replace(text, '^[^{outer}]+', ''), '[^{outer}]+$', ''),
      '[{outer}]+|[^{outer}]+') AS p FROM hits JOIN docs USING (row_id) WHERE strlen(text) <= {_SHORT}))
      SELECT row_id, string_agg(CASE WHEN {test.replace("term", "lower(x)")} AND strlen(x) < 40 THEN '{before}' || x || '{after}' ELSE {escaped} END, '' ORDER BY k) AS text FROM parts GROUP BY row_id"""


def oracle_sql() -> dict[str, str]:
    by_file = "SELECT file_path, count(*) AS count FROM {} GROUP BY file_path"
    counted = f"""WITH {_POSTINGS}, total AS (SELECT count(*) AS n, avg(dl) AS mean FROM lengths)"""
    bm25 = "tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))"
    return {
        "engine_add_batch": f"WITH {_DOCS} {by_file.format('docs')} HAVING count(*) > 0".replace("FROM docs GROUP", "FROM docs WHERE NOT is_pdf GROUP"),
        "engine_upsert_batch": f"WITH {_LIVE} SELECT id, title, reference, segment, is_pdf, file_path, md5(text) AS text_md5 FROM upserted",
        "engine_delete_by_id": f"WITH {_LIVE} {by_file.format('without_ids')}",
        "engine_delete_by_title": f"WITH {_LIVE} {by_file.format('live')}",
        "engine_optimized": f"WITH {_LIVE} {by_file.format('live')}",
        "engine_vocabulary": f"WITH {_LIVE} SELECT term, count(DISTINCT n) AS df FROM {_LIVE_TERMS} GROUP BY term",
        "engine_reopened": f"WITH {_LIVE} SELECT file_path, count(*) AS count FROM live WHERE list_contains(list_transform(regexp_extract_all(text, '{_TOKEN}'), lambda x: lower(x)), 'the') GROUP BY file_path",
        "engine_lock": _values("moment, lock", ["'while another writes', 'locked'", "'afterwards', 'open'"]),
        "engine_segments": _values("step, segments", ["'empty', 0", "'added', 1", "'upserted', 2", "'singles', 4", "'merged', 1", "'cleared', 0"]),
        "engine_singles": f"""WITH {_DOCS} SELECT 'before commit' AS step, count(*) AS hits FROM docs WHERE NOT is_pdf
            UNION ALL {_values("step, hits", ["'added', 1", "'replaced', 0", "'upserted', 1", "'rolled back', 0", "'cleared', 0"])}""",
        "score_regex_constant": f"{_phrase(_like('judge.*'))} SELECT row_id, id, 1.0 AS score FROM hits JOIN docs USING (row_id) ORDER BY row_id LIMIT 30",
        "score_fuzzy_clauses": f"""WITH {_POSTINGS}, hits AS (SELECT row_id FROM postings WHERE {_close('court', 1)} INTERSECT SELECT row_id FROM postings WHERE {_close('judge', 1)})
            SELECT row_id, id, 3.0 AS score FROM hits JOIN docs USING (row_id) WHERE {_under('/english')} ORDER BY row_id LIMIT 30""",
        "score_facet_clause": f"""{counted}, hits AS (SELECT DISTINCT row_id, 1 AS tf FROM postings WHERE term = 'court')
            SELECT row_id, id, round(1 + (SELECT ln(1 + (n - df + 0.5) / (df + 0.5)) FROM vocabulary, total WHERE term = 'court') * {bm25}, 6) AS score
            FROM hits JOIN lengths USING (row_id) JOIN docs USING (row_id), total WHERE {_under('/english/law')} ORDER BY score DESC, row_id LIMIT 30""",
        "score_regex_phrase": f"""{counted}, a AS (SELECT row_id, pos AS place FROM postings WHERE {_like('th.')}), b AS (SELECT row_id, pos - 1 AS place FROM postings WHERE {_like('co.*t')}),
            hits AS (SELECT row_id, count(DISTINCT place) AS tf FROM a JOIN b USING (row_id, place) GROUP BY row_id),
            sums AS (SELECT least(n, (SELECT sum(df) FROM vocabulary WHERE {_like('th.')})) AS x, least(n, (SELECT sum(df) FROM vocabulary WHERE {_like('co.*t')})) AS y, n, mean FROM total)
            SELECT row_id, id, round((ln(1 + (n - x + 0.5) / (x + 0.5)) + ln(1 + (n - y + 0.5) / (y + 0.5))) * {bm25}, 6) AS score
            FROM hits JOIN lengths USING (row_id) JOIN docs USING (row_id), sums ORDER BY (ln(1 + (n - x + 0.5) / (x + 0.5)) + ln(1 + (n - y + 0.5) / (y + 0.5))) * {bm25} DESC, row_id LIMIT 30""",
        "limit_zero": _page(_phrase(_term("the")), 0).replace("SELECT row_id, id, title, reference, segment, is_pdf, file_path", "SELECT id, title, file_path"),
        "refused_queries": _values("\"check\", outcome", ["'distance over 2', 'refused'", "'negative distance', 'refused'", "'topic without slash', 'refused'", "'pattern with an anchor', 'refused'",
            "'anchor at the end', 'refused'", "'too many terms', 'too many terms'", "'no anchor in a class', 'accepted'"]),
        "expansion_limits": _values("query, max_expansions", ["'one word', 10", "'two words', 100", "'typing errors', 50", "'two words, typing errors', 100", "'one letter', 2000", "'two letters', 3000",
            "'three letters', 4000", "'long word', 5000", "'shorter of two', 3000"]),
        "snippet_exact": _wrapped(_phrase(_term("of"), _term("the")), "term IN ('of', 'the')"),
        "snippet_own_marks": _wrapped(_phrase(_term("ספר")), _term("ספר"), "<<", ">>"),
        "snippet_regex": _wrapped(_phrase(_like("judge.*")), _like("judge.*")),
        "snippet_advanced": _wrapped(_phrase(_like(f"{_RICH}ספר")), _like(f"{_RICH}ספר")),
        "snippet_fuzzy": _wrapped(_phrase(_close("court", 1)), _close("court", 1)),
        "snippet_of_phrases_is_the_text": f"{_phrase(_term('of'), _term('the'))} SELECT row_id, text FROM hits JOIN docs USING (row_id) WHERE strlen(text) <= {_SHORT}",
        "highlight_budget": f"WITH {_POSTINGS} SELECT 'one' AS slots, least(512, count(*)) AS marked FROM vocabulary UNION ALL SELECT 'two', count(*) FROM (SELECT term, row_number() OVER (ORDER BY term) AS n FROM vocabulary) WHERE n <= 256 OR term = 'court'",
        "compatibility_states": _values("folder, compatible, status, found_schema_version", [f"'fresh', true, 'compatible', {SCHEMA_VERSION}", "'absent', false, 'missing_index', NULL", "'a file', false, 'invalid_index_path', NULL",
            f"'older', false, 'rebuild_required', {SCHEMA_VERSION - 1}", f"'newer', false, 'engine_too_old', {SCHEMA_VERSION + 1}", f"'another format', false, 'invalid_format', {SCHEMA_VERSION}", "'broken', false, 'invalid_metadata', NULL",
            f"'without metadata', true, 'legacy_compatible', {SCHEMA_VERSION}", "'id not indexed', false, 'rebuild_required', 1", "'nothing in it', false, 'missing_metadata', NULL"]),
    }
