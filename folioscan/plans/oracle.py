"""SQL of the search engine's queries, for DuckDB.

Patterns are written out here, not compiled, so that the compiler of advanced queries is tested too.
"""

from __future__ import annotations

# The letters and points that make up tokens, as Java's alphabetic class has them.
_TOKEN = r"[\p{L}\p{N}\x{05B0}-\x{05BD}\x{05BF}\x{05C1}\x{05C2}\x{05C4}\x{05C5}\x{05C7}]+"

_DOCS = """
docs AS (
  SELECT row_id, id, coalesce(title, '') AS title, coalesce(reference, '') AS reference, '/' || trim(coalesce(topics, ''), '/') AS topics,
         coalesce(text, '') AS text, coalesce(segment, 0) AS segment, coalesce(is_pdf, false) AS is_pdf, coalesce(file_path, '') AS file_path
  FROM document_input WHERE committed_at IS NOT NULL
)"""
_POSTINGS = (
    _DOCS
    + rf""",
tokens AS (
  SELECT row_id, unnest(a) AS raw, unnest(range(len(a))) AS pos
  FROM (SELECT row_id, regexp_extract_all(text, '{_TOKEN}') AS a FROM docs)
),
postings AS (SELECT row_id, lower(raw) AS term, pos FROM tokens WHERE strlen(raw) < 40),
vocabulary AS (SELECT term, count(DISTINCT row_id) AS df FROM postings GROUP BY term),
lengths AS (SELECT d.row_id, count(p.term) AS dl FROM docs d LEFT JOIN postings p USING (row_id) GROUP BY d.row_id)"""
)
# Hebrew letters in order, and as many signs that no term has.
_HEBREW = "אבגדהוזחטיךכלםמןנסעףפץצקרשת"
_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!"
_COLUMNS = "row_id, id, title, reference, segment, is_pdf, file_path"


def _term(word: str) -> str:
    return f"term = '{word}'"


def _like(pattern: str) -> str:
    return f"regexp_full_match(term, '{pattern}')"


def _close(word: str, distance: int) -> str:
    """Edit distance over characters: all that isn't ASCII becomes one sign, Hebrew letters one each."""
    plain = f"regexp_replace(translate(term, '{_HEBREW}', '{_SIGNS}'), '[^\\x00-\\x7F]', '#', 'g')"
    return f"damerau_levenshtein({plain}, translate('{word}', '{_HEBREW}', '{_SIGNS}')) <= {distance}"


def _phrase(*slots: str, slop: int = 0) -> str:
    """Hits of a phrase: one row per placement of its slots within ``slop`` moves."""
    parts = ", ".join(f"s{i} AS (SELECT row_id, pos - {i} AS place FROM postings WHERE {s})" for i, s in enumerate(slots))
    joins = "".join(f" JOIN s{i} USING (row_id)" for i in range(1, len(slots)))
    moves = " + ".join(f"abs(s{i}.place - s{i - 1}.place)" for i in range(1, len(slots))) or "0"
    return f"WITH {_POSTINGS}, {parts}, hits AS (SELECT DISTINCT row_id FROM s0{joins} WHERE {moves} <= {slop})"


def _all(*slots: str) -> str:
    """Hits of words anywhere in the text."""
    parts = " INTERSECT ".join(f"SELECT DISTINCT row_id FROM postings WHERE {s}" for s in slots)
    return f"WITH {_POSTINGS}, hits AS ({parts})"


def _count(hits: str, where: str = "true") -> str:
    return f"{hits} SELECT count(*) AS total_count FROM hits JOIN docs USING (row_id) WHERE {where}"


def _page(hits: str, limit: int = 20, offset: int = 0, where: str = "true") -> str:
    return f"{hits} SELECT {_COLUMNS} FROM hits JOIN docs USING (row_id) WHERE {where} ORDER BY id, row_id LIMIT {limit} OFFSET {offset}"


def _by_book(hits: str) -> str:
    return f"{hits} SELECT file_path, count(*) AS count FROM hits JOIN docs USING (row_id) GROUP BY file_path"


def _children(hits: str, prefix: str) -> str:
    below = f"substr(topics, length('{prefix}/') + 1)"
    return f"""{hits}, found AS (SELECT '{prefix}/' || split_part({below}, '/', 1) AS path FROM hits JOIN docs USING (row_id)
      WHERE starts_with(topics, '{prefix}/') AND {below} <> '') SELECT path, count(*) AS count FROM found GROUP BY path"""


def _under(*paths: str) -> str:
    return "(" + " OR ".join(f"topics = '{p}' OR starts_with(topics, '{p}/')" for p in paths) + ")"


def _bm25(words: list[str], limit: int = 20) -> str:
    slots = ", ".join(f"s{i} AS (SELECT row_id, pos - {i} AS place FROM postings WHERE term = '{w}')" for i, w in enumerate(words))
    joins = "".join(f" JOIN s{i} USING (row_id, place)" for i in range(1, len(words)))
    tf = "1" if len(words) == 1 else "count(*)"
    idf = " + ".join(f"(SELECT ln(1 + (n - df + 0.5) / (df + 0.5)) FROM vocabulary, total WHERE term = '{w}')" for w in words)
    return f"""WITH {_POSTINGS}, total AS (SELECT count(*) AS n, avg(dl) AS mean FROM lengths), {slots},
      counted AS (SELECT row_id, {tf} AS tf FROM s0{joins} GROUP BY row_id)
      SELECT row_id, id, round(({idf}) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)), 6) AS score
      FROM counted JOIN lengths USING (row_id) JOIN docs USING (row_id), total
      ORDER BY ({idf}) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) DESC, row_id LIMIT {limit}"""


_TIMINGS = "benchmark_result JOIN benchmark_case c USING (query_name)"
# Particles before a word and endings after it, in the forms with and without the rarer ones; misspellings of one word.
_RICH = "(?:ו|מ|דא|א|כש|כ|ב|ש|ל|ה|ד)?(?:כ|ב|ש|ל|ה|ד)?(?:ה)?"
_ENDINGS = "(?:ותי|ותיך|ותיו|ותיה|ותינו|ותיכם|ותיכן|ותיהם|ותיהן|יי|יך|יו|יה|ינו|יכם|יכן|יהם|יהן|י|ך|ו|ה|נו|כם|כן|ם|ן|ים|ות)?"
_LEAN = "(?:ו|מ|כ|ב|ש|ל|ה|ד)?(?:כ|ב|ש|ל|ה|ד)?(?:ה)?"
_ALL_ENDINGS = "(?:ותי|ותיך|ותיו|ותיה|ותינו|ותיכם|ותיכן|ותיהם|ותיהן|יות|יי|יך|יו|יה|יא|תא|ינו|יכם|יכן|יהם|יהן|י|ך|ו|ה|נו|כם|כן|ם|ן|ים|ות)?"
_TYPOS = (
    "כתב קתב כטב כתו תכב כבת תב כב כת וכתב יכתב אכתב הכתב פכתב לכתב מכתב נכתב בכתב ככתב שכתב תכתב רכתב "
    "כתבו כתבי כתבא כתבה כתבפ כתבל כתבמ כתבנ כתבב כתבכ כתבש כתבת כתבר כותב כיתב כאתב כהתב כפתב כלתב כמתב כנתב כבתב כשתב כתתב"
)


def oracle_sql() -> dict[str, str]:
    return {
        "exact_term_count": _count(_phrase(_term("סוחר"))),
        "exact_term_page_catalogue": _page(_phrase(_term("court"))),
        "exact_term_page_offset": _page(_phrase(_term("the")), 15, 30),
        "exact_phrase2_count": _count(_phrase(_term("of"), _term("the"))),
        "exact_phrase3_page": _page(_phrase(_term("in"), _term("the"), _term("long")), 50),
        "exact_pointed_query": _count(_phrase(_term("ספר"))),
        "exact_facet_filter": _count(_phrase(_term("את")), _under("/עברית/trade")),
        "exact_multi_facet": _page(_phrase(_term("the")), 40, 0, _under("/english/law/early", "/english/ethics")),
        "exact_count_by_book": _by_book(_phrase(_term("the"))),
        "exact_facet_counts": _children(_phrase(_term("הוא")), "/עברית"),
        "exact_facet_counts_root": _children(_phrase(_term("הוא")), ""),
        "exact_search_and_count": f"""{_phrase(_term("witness"))} SELECT row_id, id, (SELECT count(*) FROM hits) AS total_count
            FROM hits JOIN docs USING (row_id) ORDER BY id, row_id LIMIT 5""",
        "exact_relevance_bm25": _bm25(["court"]),
        "exact_phrase_relevance_bm25": _bm25(["of", "the"]),
        "regex_single_count": _count(_phrase(_like("contract.*"))),
        "regex_single_page": _page(_phrase(_like(".{0,2}מולד")), 30),
        "regex_alternation": _count(_phrase(_like("(?:מותר|אסור|חייב|פטור|דין)"))),
        "regex_class_quantifier": _count(_phrase(_like("[bc]o[a-z]{2,4}t+"))),
        "regex_phrase_slop0": _count(_phrase(_like("th.{1,2}"), _like("co.*"))),
        "regex_phrase_slop2": _count(_phrase(_term("of"), _term("the"), slop=2)),
        "regex_phrase3_slop": _page(_phrase(_term("in"), _like("th."), _like("l.{3}"), slop=3), 60),
        "regex_phrase4_slop": _count(_phrase(_term("of"), _term("the"), _term("in"), _term("and"), slop=5)),
        "regex_phrase_facet": _count(_phrase(_term("את"), _like("ה.*"), slop=1), _under("/עברית/law", "/עברית/ethics/late")),
        "regex_count_by_book": _by_book(_phrase(_like("[וב]?סוחר"))),
        "regex_facet_counts": _children(_phrase(_like("judge.*")), "/english"),
        "regex_expansion_terms": f"WITH {_POSTINGS} SELECT term, df FROM vocabulary WHERE {_like('pri[a-z]+')}",
        "fuzzy_d0": _count(_all(_term("court"))),
        "fuzzy_d1_count": _count(_all(_close("court", 1))),
        "fuzzy_d1_terms": f"WITH {_POSTINGS} SELECT term FROM vocabulary WHERE {_close('סוחר', 1)}",
        "fuzzy_d2_terms": f"WITH {_POSTINGS} SELECT term FROM vocabulary WHERE {_close('witness', 2)}",
        "fuzzy_d1_multi_and": _count(_all(_close("court", 1), _close("judge", 1))),
        "fuzzy_d2_page": _page(_all(_close("lawsuit", 2)), 40),
        "fuzzy_facets": _count(_all(_close("lawsuit", 1)), _under("/english/law")),
        "fuzzy_count_by_book": _by_book(_all(_close("חודש", 1))),
        "fuzzy_facet_counts": _children(_all(_close("month", 1)), "/english"),
        "fuzzy_given_terms": _count(_all(_close("court", 1).replace("'court'", "'Court'"), _close("judge", 1))),
        "advanced_plain_phrase": _count(_phrase(_term("of"), _term("the"), slop=1)),
        "advanced_prefix": _count(_phrase(_like(".{0,3}לוח"))),
        "advanced_suffix": _count(_phrase(_like("judge.{0,5}"))),
        "advanced_partial": _page(_phrase(_like(".{0,2}מולד.{0,2}")), 40),
        "advanced_grammatical_prefix": _count(_phrase(_like(f"{_RICH}ספר"))),
        "advanced_grammatical_suffix": _count(_phrase(_like(f"חוד{_ENDINGS}"))),
        "advanced_full_morphology": _count(_phrase(_like(f"{_LEAN}דין{_ALL_ENDINGS}"))),
        "advanced_spelling": _count(_phrase(_like("(?:סדר|סידר|סדור|סידור)"))),
        "advanced_typo": _count(_phrase(f"term IN ({', '.join(repr(w) for w in _TYPOS.split())})")),
        "advanced_alternatives": _count(_phrase(_like("(?:court|tribunal|judge)"))),
        "advanced_custom_spacing": _count(_phrase(_term("of"), _term("the"), slop=3)),
        "advanced_count_by_book": _by_book(_phrase(_like(f"{_RICH}לוח"))),
        "advanced_facet_counts": _children(_phrase(_like("judge.{0,5}")), "/english/law"),
        "empty_query": f"WITH {_DOCS} SELECT {_COLUMNS} FROM docs WHERE false",
        "docs_by_file_path": f"WITH {_DOCS} SELECT file_path, count(*) AS count FROM docs GROUP BY file_path",
        "indexed_file_paths": f"WITH {_DOCS} SELECT DISTINCT file_path FROM docs",
        "document_count": f"WITH {_DOCS} SELECT count(*) AS documents FROM docs",
        "get_document_by_id": f"WITH {_DOCS} SELECT id, title, reference, text, segment, is_pdf, file_path FROM docs WHERE id = (SELECT min(id) FROM docs) ORDER BY row_id LIMIT 1",
        "vocabulary_frequencies": f"WITH {_POSTINGS} SELECT term, df FROM vocabulary",
        "document_lengths": f"WITH {_POSTINGS} SELECT row_id, dl FROM lengths",
        "topic_tree": f"""WITH {_DOCS}, parts AS (SELECT list_filter(string_split(topics, '/'), lambda x: x <> '') AS p FROM docs),
            paths AS (SELECT unnest(list_transform(range(1, len(p) + 1), lambda n: '/' || array_to_string(p[1:n], '/'))) AS path FROM parts)
            SELECT path, count(*) AS documents FROM paths GROUP BY path""",
        "stream_chunks": f"""{_phrase(_term("the"))}, n AS (SELECT least(45, count(*)) AS n FROM hits), c AS (SELECT unnest(range(CAST(ceil(n / 20.0) AS BIGINT))) AS chunk, n FROM n)
            SELECT chunk, CAST(least(20, n - chunk * 20) AS BIGINT) AS n_rows FROM c""",
        "upsert_last_wins": """SELECT id, row_id, title, segment FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY added_at DESC, row_id DESC) AS n FROM document_input) WHERE n = 1""",
        "delete_by_id": f"WITH {_DOCS} SELECT file_path, count(*) AS count FROM docs WHERE id NOT IN (SELECT id FROM search_result WHERE id IS NOT NULL) GROUP BY file_path",
        "delete_by_title": f"WITH {_DOCS} SELECT file_path, count(*) AS count FROM docs WHERE title NOT IN (SELECT title FROM book_list WHERE is_pdf) GROUP BY file_path",
        "uncommitted_by_file": "SELECT file_path, count(*) AS count FROM document_input WHERE committed_at IS NULL GROUP BY file_path",
        "checks_by_status": """SELECT status, count(*) AS checks, CAST(sum(CASE WHEN compatible THEN 1 ELSE 0 END) AS BIGINT) AS compatible,
            count(found_schema_version) AS with_version FROM index_check GROUP BY status""",
        "latest_check": """SELECT metadata_path, check_id, status FROM (SELECT *, row_number() OVER (PARTITION BY metadata_path ORDER BY checked_at DESC, check_id DESC) AS n FROM index_check) WHERE n = 1""",
        "bench_summary": f"""SELECT count(*) AS runs, CAST(sum(execution_time_ms) AS BIGINT) AS total_ms, round(avg(execution_time_ms), 6) AS mean_ms, min(execution_time_ms) AS min_ms,
            max(execution_time_ms) AS max_ms FROM {_TIMINGS} WHERE execution_time_ms >= 0""",
        "bench_speeds": f"""SELECT CASE WHEN execution_time_ms < 50 THEN 'fast' WHEN execution_time_ms < 200 THEN 'medium' ELSE 'slow' END AS speed, count(*) AS runs
            FROM {_TIMINGS} WHERE execution_time_ms >= 0 GROUP BY 1""",
        "bench_patterns": " UNION ALL ".join(
            f"SELECT '{kind}' AS kind, CASE WHEN {test} THEN '{yes}' ELSE '{no}' END AS part, count(*) AS runs, round(avg(execution_time_ms), 6) AS mean_ms FROM {_TIMINGS} WHERE execution_time_ms >= 0 GROUP BY 2"
            for kind, test, yes, no in (
                ("terms", "len(regex_terms) = 1", "single", "multi"),
                ("slop", "benchmark_result.slop > 0", "with", "without"),
                ("expansion", "benchmark_result.max_expansions <= 100", "low", "high"),
            )
        ),
        "bench_by_complexity": f"""WITH tagged AS (SELECT execution_time_ms, array_to_string(regex_terms, ' ') AS j FROM {_TIMINGS} WHERE execution_time_ms >= 0),
            named AS (SELECT execution_time_ms, concat_ws(',', CASE WHEN contains(j, '.*') THEN 'wildcard' END, CASE WHEN contains(j, '[א-ת]') THEN 'hebrew class' END,
              CASE WHEN contains(j, '|') THEN 'alternation' END, CASE WHEN contains(j, '+') OR contains(j, '?') THEN 'quantifier' END, CASE WHEN contains(j, chr(123)) THEN 'repetition' END) AS tags FROM tagged)
            SELECT CASE WHEN tags = '' THEN 'simple' ELSE tags END AS complexity, count(*) AS runs, round(avg(execution_time_ms), 6) AS mean_ms,
              CAST(sum(CASE WHEN execution_time_ms > 100 THEN 1 ELSE 0 END) AS BIGINT) AS over_100_ms FROM named GROUP BY 1""",
        "bench_by_keyword": f"""SELECT regexp_extract(query_name, '([^_]+)$', 1) AS keyword, count(*) AS runs, round(avg(execution_time_ms), 6) AS mean_ms
            FROM {_TIMINGS} WHERE execution_time_ms >= 0 GROUP BY 1""",
        "bench_slow_runs": f"""WITH tagged AS (SELECT query_name, execution_time_ms, array_to_string(regex_terms, ' ') AS j FROM {_TIMINGS} WHERE execution_time_ms > 200),
            named AS (SELECT query_name, execution_time_ms, concat_ws(',', CASE WHEN contains(j, '.*') THEN 'wildcard' END, CASE WHEN contains(j, '[א-ת]') THEN 'hebrew class' END,
              CASE WHEN contains(j, '|') THEN 'alternation' END, CASE WHEN contains(j, '+') OR contains(j, '?') THEN 'quantifier' END, CASE WHEN contains(j, chr(123)) THEN 'repetition' END) AS tags FROM tagged)
            SELECT query_name, CASE WHEN tags = '' THEN 'simple' ELSE tags END AS complexity, execution_time_ms FROM named""",
        "bench_by_group": f"""SELECT CASE WHEN regexp_matches(query_name, 'Talmudic|Rabbi') THEN 'talmudic' WHEN regexp_matches(query_name, 'Biblical|Verse') THEN 'biblical'
            WHEN regexp_matches(query_name, 'Halachic|Responsa') THEN 'halachic' ELSE 'other' END AS "group", count(*) AS runs, round(avg(execution_time_ms), 6) AS mean_ms
            FROM {_TIMINGS} WHERE execution_time_ms >= 0 GROUP BY 1""",
        "bench_hebrew_slow": f"""SELECT query_name, execution_time_ms, pattern, contains(pattern, '.*') AS wildcard
            FROM (SELECT query_name, execution_time_ms, unnest(regex_terms) AS pattern FROM {_TIMINGS} WHERE execution_time_ms > 100) WHERE contains(pattern, '[א-ת]')""",
        "bench_impacts": " UNION ALL ".join(
            f"SELECT '{kind}' AS kind, round(avg(CASE WHEN {slow} THEN execution_time_ms END) / avg(CASE WHEN NOT ({slow}) THEN execution_time_ms END), 4) AS times FROM {_TIMINGS} WHERE execution_time_ms >= 0"
            for kind, slow in (("terms", "len(regex_terms) > 1"), ("slop", "benchmark_result.slop > 0"), ("expansion", "benchmark_result.max_expansions > 100"))
        ),
        "bench_diagnostic": f"""WITH {_POSTINGS}, cases AS (SELECT * FROM (VALUES ('Hebrew letter aleph', 'א', 100, 10), ('Hebrew letter bet', 'ב', 100, 10), ('Hebrew letter gimel', 'ג', 100, 10), ('Word: and', 'ו', 100, 10),
              ('Word: the', 'ה', 100, 10), ('Word: in', 'ב', 100, 10), ('Any Hebrew letter', '[א-ת]', 100, 10), ('Two Hebrew letters', '[א-ת][א-ת]', 100, 10), ('Simple wildcard', '.*', 100, 10), ('any term', '.*', 1000, NULL)) AS t(query_name, pattern, cap, most)),
            matched AS (SELECT query_name, cap, most, term FROM cases LEFT JOIN vocabulary ON regexp_full_match(term, pattern)),
            sizes AS (SELECT query_name, cap, most, count(term) AS size FROM matched GROUP BY ALL),
            hits AS (SELECT query_name, count(DISTINCT row_id) AS n FROM matched JOIN postings USING (term) GROUP BY query_name)
            SELECT query_name, CASE WHEN size <= cap THEN least(coalesce(n, 0), coalesce(most, coalesce(n, 0))) END AS result_count, size > cap AS failed FROM sizes LEFT JOIN hits USING (query_name)""",
        "bench_memory": """SELECT query_name, round(1 + max_expansions / 1000.0 * list_sum(list_transform(regex_terms, lambda t: 1.0 + CASE WHEN contains(t, '.*') THEN 0.5 ELSE 0 END
            + CASE WHEN contains(t, '[') THEN 1.0 ELSE 0 END + CASE WHEN contains(t, '(') THEN 1.5 ELSE 0 END + CASE WHEN contains(t, chr(123)) THEN 0.8 ELSE 0 END
            + CASE WHEN contains(t, '+') OR contains(t, '*') THEN 0.3 ELSE 0 END)), 6) AS memory_usage_mb FROM benchmark_case""",
        "case_hits": f"""WITH RECURSIVE {_POSTINGS},
            slots AS (SELECT query_name, unnest(regex_terms) AS pattern, unnest(range(len(regex_terms))) AS slot, len(regex_terms) AS n, facets, slop, max_expansions FROM benchmark_case),
            matched AS (SELECT pattern, term FROM (SELECT DISTINCT pattern FROM slots), vocabulary WHERE regexp_full_match(term, pattern)),
            sizes AS (SELECT s.query_name, s.slot, s.n, s.max_expansions, count(m.term) AS size FROM slots s LEFT JOIN matched m USING (pattern) GROUP BY ALL),
            summed AS (SELECT *, sum(size) OVER (PARTITION BY query_name ORDER BY slot) AS so_far FROM sizes),
            ends AS (SELECT query_name, min(CASE WHEN size = 0 THEN slot END) AS empty, min(CASE WHEN so_far > max_expansions THEN slot END) AS beyond FROM summed GROUP BY query_name),
            states AS (SELECT query_name, CASE WHEN empty IS NOT NULL AND (beyond IS NULL OR empty < beyond) THEN 'no terms' WHEN beyond IS NOT NULL THEN 'too many terms' ELSE 'matched' END AS status FROM ends),
            places AS (SELECT DISTINCT s.query_name, s.slot, s.n, s.slop, s.facets, p.row_id, p.pos - s.slot AS place
              FROM slots s JOIN states USING (query_name) JOIN matched USING (pattern) JOIN postings p USING (term) WHERE status = 'matched'),
            chain AS (SELECT query_name, slot, n, slop, facets, row_id, place, 0 AS moves FROM places WHERE slot = 0
              UNION SELECT c.query_name, p.slot, c.n, c.slop, c.facets, c.row_id, p.place, c.moves + abs(p.place - c.place)
              FROM chain c JOIN places p ON p.query_name = c.query_name AND p.row_id = c.row_id AND p.slot = c.slot + 1 AND c.moves + abs(p.place - c.place) <= c.slop),
            hits AS (SELECT DISTINCT query_name, row_id FROM chain JOIN docs USING (row_id) WHERE slot = n - 1
              AND (len(facets) = 0 OR len(list_filter(facets, lambda f: topics = rtrim(f, '/') OR starts_with(topics, rtrim(f, '/') || '/'))) > 0))
            SELECT s.query_name, status, CASE WHEN status <> 'too many terms' THEN count(h.row_id) END AS total_count FROM states s LEFT JOIN hits h USING (query_name) GROUP BY s.query_name, status""",
        "results_by_query": """SELECT query_name, count(*) AS n_rows, count(DISTINCT (search_id, hit_no, id)) AS distinct_rows, count(DISTINCT search_id) AS searches,
            CAST(sum(CASE WHEN contains(text, '<font color=red>') THEN 1 ELSE 0 END) AS BIGINT) AS marked FROM search_result GROUP BY query_name""",
    }
