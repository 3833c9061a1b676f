"""SQL of the training-data queries, for DuckDB, where SQL can express them on whole tables.

Scans (p1), canonical forms (p3), subjects (p10), the pieces of a text, cleaned texts and the mixtures have none: the tests hold
them against brute force, round trips and held-out accuracy.
"""

from __future__ import annotations

_TERMS = r"""
tokens AS (SELECT row_id, unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+')) AS raw FROM document_input),
counts AS (SELECT row_id, lower(raw) AS term, count(*) AS tf FROM tokens WHERE strlen(raw) < 40 GROUP BY 1, 2),
terms AS (SELECT term, sum(tf) AS c, count(*) AS records FROM counts GROUP BY term)"""

# words without case, marks and punctuation, with their places
_WORDS = r"""SELECT {id}, unnest(w) AS word, unnest(range(len(w))) AS pos
FROM (SELECT {id}, regexp_extract_all(lower(strip_accents(text)), '[\p{{L}}\p{{N}}]+') AS w FROM {table})"""
_TWELVE = "SELECT {id}, array_to_string(list(word) OVER (PARTITION BY {id} ORDER BY pos ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING), ' ') AS g, count(*) OVER (PARTITION BY {id} ORDER BY pos ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS n FROM ({words})"


def _grams(table: str, id: str) -> str:
    return f"SELECT DISTINCT {id}, g FROM ({_TWELVE.format(id=id, words=_WORDS.format(id=id, table=table))}) WHERE n = 12"


_SIMILAR = f"""WITH {_TERMS},
sizes AS (SELECT row_id, count(*) AS n FROM counts GROUP BY row_id HAVING count(*) >= 20),
common AS (SELECT a.row_id AS row_id_a, b.row_id AS row_id_b, count(*) AS k FROM counts a JOIN counts b ON a.term = b.term AND a.row_id < b.row_id GROUP BY 1, 2),
pairs AS (SELECT row_id_a, row_id_b FROM common JOIN sizes x ON x.row_id = row_id_a JOIN sizes y ON y.row_id = row_id_b WHERE k >= 0.7 * (x.n + y.n - k))"""


# a title without invisible characters and odd spaces, wide and pointed forms taken apart, stray letters in the script of their word
_PLAIN = r"""nfc_normalize(translate(array_to_string(list_transform(regexp_extract_all(regexp_replace(regexp_replace(replace(replace(replace(replace(title, 'װ', 'וו'), 'ױ', 'וי'), 'ײ', 'יי'), 'ﭏ', 'אל'), '\p{Cf}', '', 'g'), '\p{Zs}', ' ', 'g'), '(?s).'),
            lambda c: CASE WHEN ord(c) BETWEEN 65281 AND 65374 THEN chr(ord(c) - 65248) ELSE c END), ''),
            'ﬠﬡﬢﬣﬤﬥﬦﬧﬨаеорсхуіѕјАВЕКМНОРСТХІЅЈΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιν', 'עאדהכלםרתaeopcxyisjABEKMHOPCTXISJABEZHIKMNOPTYXoiv'))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": r"""SELECT row_id, CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[\s\p{Z}\x{85}\x{0B}\x{1C}-\x{1F}]+'), lambda s: length(s))) > 3000
            THEN 'forced' ELSE 'boundary' END AS cut FROM document_input WHERE length(text) > 3000""",
        "p3_titles": f"SELECT row_id, b.title AS listed FROM (SELECT row_id, {_PLAIN} AS plain FROM document_input) JOIN book_list b ON plain = b.title",
        "p4_found": f"WITH {_TERMS} SELECT row_id, term FROM counts JOIN terms USING (term) WHERE tf >= 4 AND records <= 5",
        "p4_scores": f"""WITH {_TERMS}, lengths AS (SELECT row_id, sum(tf) AS n FROM counts GROUP BY row_id), whole AS (SELECT sum(pow(n, 0.75)) AS s FROM lengths)
            SELECT row_id, term, tf, records, round(greatest(0, ln(tf * s / (c * pow(n, 0.75)))), 6) AS ppmi
            FROM counts JOIN terms USING (term) JOIN lengths USING (row_id), whole""",
        "p5_found": """WITH grams AS (SELECT DISTINCT row_id, hash(substr(text, i, 200)) AS h FROM (SELECT row_id, text, unnest(range(1, length(text) - 198)) AS i FROM document_input WHERE length(text) >= 200))
            SELECT DISTINCT a.row_id AS row_id_a, b.row_id AS row_id_b FROM grams a JOIN grams b ON a.h = b.h AND a.row_id < b.row_id""",
        "p5_shares": """WITH grams AS (SELECT row_id, i, hash(substr(text, i, 200)) AS h FROM (SELECT row_id, text, unnest(range(1, length(text) - 198)) AS i FROM document_input WHERE length(text) >= 200)),
            held AS (SELECT h FROM grams GROUP BY h HAVING count(DISTINCT row_id) > 1),
            steps AS (SELECT row_id, least(200, coalesce(lead(i) OVER (PARTITION BY row_id ORDER BY i) - i, 200)) AS step FROM grams SEMI JOIN held USING (h)),
            covered AS (SELECT row_id, CAST(sum(step) AS BIGINT) AS n FROM steps GROUP BY row_id),
            copies AS (SELECT text, count(*) - 1 AS copies FROM document_input WHERE length(text) >= 200 GROUP BY text)
            SELECT row_id, reference, length(text) AS chars, coalesce(n, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN round(coalesce(n, 0) / length(text), 6) ELSE 0.0 END AS share,
              coalesce(copies, 0) AS copies FROM document_input LEFT JOIN covered USING (row_id) LEFT JOIN copies USING (text) WHERE text IS NOT NULL""",
        "p6_found": f"""WITH {_TERMS} SELECT term, CASE WHEN records <= 1 THEN 'rare' ELSE 'common' END AS mark FROM terms
            WHERE records <= 1 OR records > 0.1 * (SELECT count(*) FROM document_input)""",
        "p6_terms": f"""WITH {_TERMS} SELECT term, CAST(c AS BIGINT) AS occurrences, records, CASE WHEN records <= 1 THEN 'rare' WHEN records > 0.1 * (SELECT count(*) FROM document_input) THEN 'common' END AS mark FROM terms""",
        "p6_phrases": r"""WITH w AS (SELECT row_id, list_transform(list_filter(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+'), lambda x: strlen(x) < 40), lambda x: lower(x)) AS a FROM document_input),
            g AS (SELECT row_id, array_to_string(a[i:i + k - 1], ' ') AS phrase FROM (SELECT row_id, a, k, unnest(range(1, len(a) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k)))
            SELECT phrase, count(*) AS occurrences, count(DISTINCT row_id) AS records FROM g GROUP BY phrase HAVING count(DISTINCT row_id) > 1""",
        "p7_found": f"{_SIMILAR} SELECT row_id_a, row_id_b FROM pairs",
        "p7_links": f"""{_SIMILAR}, both_ways AS (SELECT row_id_a AS row_id, row_id_b AS other FROM pairs UNION ALL SELECT row_id_b, row_id_a FROM pairs),
            sets AS (SELECT row_id, md5(string_agg(term, ' ' ORDER BY term)) AS s FROM counts WHERE row_id IN (SELECT row_id FROM sizes) GROUP BY row_id),
            classes AS (SELECT row_id, min(row_id) OVER (PARTITION BY s) AS class_id FROM sets)
            SELECT row_id, class_id, (SELECT count(*) FROM both_ways b WHERE b.row_id = classes.row_id) AS links FROM classes""",
        "p7_groups": f"""WITH RECURSIVE {_TERMS},
            sizes AS (SELECT row_id, sum(tf) AS n FROM counts GROUP BY row_id HAVING count(*) >= 20),
            common AS (SELECT a.row_id AS x, b.row_id AS y, sum(least(a.tf, b.tf)) AS k FROM counts a JOIN counts b ON a.term = b.term AND a.row_id != b.row_id GROUP BY 1, 2),
            edges AS (SELECT x, y FROM common JOIN sizes s ON s.row_id = x JOIN sizes t ON t.row_id = y WHERE k >= 0.8 * (s.n + t.n - k)),
            reach(row_id, other) AS (SELECT row_id, row_id FROM sizes UNION SELECT row_id, y FROM reach JOIN edges ON other = x),
            named AS (SELECT row_id, min(other) AS group_id FROM reach GROUP BY row_id)
            SELECT row_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_rows FROM named""",
        "p8_found": f"SELECT DISTINCT doc_id, item_id FROM ({_grams('documents', 'doc_id')}) JOIN ({_grams('eval_item', 'item_id')}) USING (g)",
        "p9_found": r"""WITH lengths AS (SELECT source, len(list_filter(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+'), lambda x: strlen(x) < 40)) AS n FROM documents),
            have AS (SELECT source, sum(n) AS tokens FROM lengths GROUP BY source)
            SELECT source FROM mix_target LEFT JOIN have USING (source) WHERE max_repeats * coalesce(tokens, 0) < target_share * (SELECT sum(n) FROM lengths)""",
    }
