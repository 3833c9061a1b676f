import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from folioscan.engine import SearchEngine
from folioscan.functions.morph import GRAM_PREFIX
from folioscan.functions.topics import TopicError
from folioscan.operators import match
from folioscan.operators.index import Index
from folioscan.operators.match import whole_term
from folioscan.schema import DocumentInput, ExpansionError, HighlightConfig, ResultsOrder
from folioscan.sources import store
from folioscan.sources.files import HadoopFiles
from folioscan.sources.store import WriterLocked


def doc(id, text, path="a", topics="/root", title="title"):
    return DocumentInput(id, title, "ref", topics, text, 0, False, path)


@pytest.fixture
def engine(spark, tmp_path):
    e = SearchEngine(spark, str(tmp_path / "index"))
    yield e
    e.close()


def filled(engine, *docs):
    engine.add_documents_batch(list(docs))
    engine.commit()
    return engine


def ids(frame):
    return [r.id for r in frame.collect()]


def books(frame):
    return {r.file_path: r["count"] for r in frame.collect()}


BOOKS = (doc(1, "שלום עולם"), doc(2, "שלום רב"), doc(3, "שלום חבר", "b"))


def test_counts_by_book_and_path(engine):
    assert books(engine.count_documents_by_file_path()) == {}
    filled(engine, *BOOKS[:2])
    filled(engine, BOOKS[2])
    assert engine.get_segment_count() == 2
    assert books(engine.count_by_book_exact("שלום")) == {"a": 2, "b": 1}
    assert books(engine.count_by_book_exact("ביי")) == {}
    assert books(engine.count_by_book(["של.*"])) == {"a": 2, "b": 1}
    assert books(engine.count_by_book_fuzzy("שלם")) == {"a": 2, "b": 1}
    engine.delete_document_by_id(1)
    engine.delete_document_by_id(3)
    assert books(engine.count_documents_by_file_path()) == {"a": 2, "b": 1}  # not committed
    engine.commit()
    assert books(engine.count_documents_by_file_path()) == {"a": 1}
    assert [r.file_path for r in engine.get_indexed_file_paths().collect()] == ["a"]
    assert engine.count_exact("שלום") == 1
    assert engine.get_document_count() == 1


def test_reopening_and_lookup(engine, spark):
    filled(engine, doc(42, "תורה ומצוות"))
    engine.add_document(doc(43, "עוד", "z"))
    other = SearchEngine(spark, engine._store.path)
    assert books(other.count_documents_by_file_path()) == {"a": 1}
    assert other.get_document_by_id(42).text == "תורה ומצוות"
    assert other.get_document_by_id(999) is None
    assert other.get_document_by_id(43) is None


def test_upsert_rollback_clear_titles(engine):
    filled(engine, doc(1, "טקסט ישן"))
    engine.upsert_document(doc(1, "טקסט חדש"))
    engine.commit()
    assert [engine.count_exact(w) for w in ("טקסט", "ישן", "חדש")] == [1, 0, 1]
    engine.upsert_documents_batch([doc(2, "ראשון"), doc(3, "אחר", title="gone"), doc(2, "אחרון")])
    engine.commit()
    assert [engine.count_exact(w) for w in ("ראשון", "אחרון", "אחר")] == [0, 1, 1]
    engine.remove_documents_by_title("gone")
    engine.add_document(doc(9, "נשאר", title="gone"))  # after the deletion
    engine.commit()
    assert [engine.count_exact(w) for w in ("אחר", "נשאר")] == [0, 1]
    engine.add_document(doc(5, "טקסט"))
    engine.rollback()
    engine.commit()
    assert engine.count_exact("טקסט") == 1
    engine.clear()
    assert engine.get_document_count() == 3
    engine.add_document(doc(6, "אחרי"))
    engine.commit()
    assert engine.get_document_count() == 1


def test_frames_as_input(engine, spark):
    rows = spark.createDataFrame([doc(1, "one a").values(), doc(1, "two a").values(), doc(2, "three a").values()], "id long, title string, reference string, topics string, text string, segment long, is_pdf boolean, file_path string")
    engine.add_documents_batch(rows)
    engine.commit()
    assert engine.count_exact("a") == 3  # duplicates stay
    engine.upsert_documents_batch(rows.coalesce(1).withColumn("extra", F.lit(1)))
    engine.commit()
    assert (engine.count_exact("a"), engine.count_exact("one"), engine.count_exact("two")) == (2, 0, 1)
    with pytest.raises(TopicError):
        engine.add_documents_batch(rows.withColumn("topics", F.lit("no slash")))


def test_bad_topics_leave_what_came_before(engine):
    filled(engine, doc(7, "ישן"))
    with pytest.raises(TopicError):
        engine.add_documents_batch([doc(1, "א"), doc(2, "ב", topics="bad"), doc(3, "ג")])
    with pytest.raises(TopicError):
        engine.upsert_document(doc(7, "חדש", topics="bad"))
    engine.commit()
    assert sorted(r.id for r in engine.index.docs.collect()) == [1]  # the deletion of 7 was queued first


def test_lock(engine, spark):
    filled(engine, doc(1, "שלום"))
    other = SearchEngine(spark, engine._store.path)
    assert other.count_exact("שלום") == 1
    with pytest.raises(WriterLocked):
        other.add_document(doc(2, "שלום"))
    engine.close()
    other.add_document(doc(2, "שלום"))
    other.commit()
    assert engine.count_exact("שלום") == 2
    other.close()


def test_lock_of_a_writer_that_is_gone(engine, spark):
    """A lock without a sign of life is taken over, and the writer before learns of it."""
    filled(engine, doc(1, "שלום"))
    engine._store._stop()  # as if the process had died
    engine._store._beat = threading.Event()
    other = SearchEngine(spark, engine._store.path)
    with pytest.raises(WriterLocked):
        other.add_document(doc(2, "שלום"))
    held = engine._store._holder()
    engine._store._files.replace("writer.lock", json.dumps(held | {"until": 1}))
    other.add_document(doc(2, "שלום"))
    other.commit()
    with pytest.raises(WriterLocked):
        engine.add_document(doc(3, "שלום"))
    assert engine.count_exact("שלום") == 2
    other.close()
    engine._store._files.create("writer.lock", "")  # left by something else, without an owner
    other.add_document(doc(4, "שלום"))
    other.close()


def test_lock_lives_on(spark, tmp_path):
    e = SearchEngine(spark, str(tmp_path / "index"), lock_seconds=0.6)
    e.add_document(doc(1, "שלום"))
    time.sleep(1.5)
    with pytest.raises(WriterLocked):
        SearchEngine(spark, str(tmp_path / "index")).add_document(doc(2, "שלום"))
    e.close()


def test_files_of_hadoop(spark, tmp_path):
    files = HadoopFiles(spark, f"file://{tmp_path}/x")
    assert not files.exists() and not files.is_folder()
    files.make()
    assert files.is_folder() and files.create("a", "שלום") and not files.create("a", "2")
    files.replace("a", "new")
    assert files.read("a") == "new" and files.exists("a")
    files.delete("a")
    with pytest.raises(FileNotFoundError):
        files.read("a")


def test_index_by_hadoop_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "files_at", lambda path, spark=None: HadoopFiles(spark, path))
    e = SearchEngine(spark, f"file://{tmp_path}/index")
    filled(e, *BOOKS)
    e.upsert_document(doc(1, "שלום חדש"))
    e.commit()
    assert books(SearchEngine(spark, f"file://{tmp_path}/index").count_by_book_exact("שלום")) == {"a": 2, "b": 1}
    e.close()


def test_vocabulary_follows_deletions(engine):
    """The vocabulary told after adds, upserts and deletions is that of the live records, before and after merging."""
    terms = lambda: {r.term: r.df for r in engine.index.vocabulary.collect()}
    filled(engine, doc(1, "a b a"), doc(2, "a c"), doc(2, "a d"))
    filled(engine, doc(3, "b c", title="gone"))
    engine.upsert_document(doc(1, "e"))
    engine.remove_documents_by_title("gone")
    engine.commit()
    assert terms() == {"a": 2, "c": 1, "d": 1, "e": 1}
    engine.delete_document_by_id(2)
    engine.delete_document_by_id(77)
    engine.commit()
    assert terms() == {"e": 1}
    engine.optimize()
    assert terms() == {"e": 1}
    engine.clear()
    engine.commit()
    assert terms() == {} and engine.get_segment_count() == 0


def test_a_commit_reads_no_postings_of_before(engine, spark, monkeypatch):
    """Tables of earlier segments that a later commit opens: their records' keys, if something is deleted, and nothing else."""
    for n in range(3):
        filled(engine, doc(n, f"שלום {n}"))
    read, opened = engine._store._read, []
    monkeypatch.setattr(engine._store, "_read", lambda names, part, schema: (opened.append((len(names), part)), read(names, part, schema))[1])
    filled(engine, doc(9, "שלום"))
    assert max(n for n, _ in opened) == 1
    opened.clear()
    engine.delete_document_by_id(1)
    engine.commit()
    assert {part for n, part in opened if n > 1} == {"docs"}


def test_upsert_in_order(engine, spark):
    rows = spark.createDataFrame([(*doc(i % 10, f"v{i}").values(), i) for i in range(200)], "id long, title string, reference string, topics string, text string, segment long, is_pdf boolean, file_path string, at long")
    engine.upsert_documents_batch(rows.repartition(7), order=["at"])
    engine.commit()
    assert sorted(r.text for r in engine.index.docs.collect()) == sorted(f"v{i}" for i in range(190, 200))


def test_optimize(engine):
    for n in range(3):
        filled(engine, doc(n, f"שלום {n}"))
    engine.delete_document_by_id(0)
    assert engine.get_segment_count() == 3
    before = engine.index
    engine.optimize()
    assert engine.get_segment_count() == 1
    assert before.docs.count() == 3  # the version before stays readable
    assert ids(engine.search_exact("שלום")) == [1, 2]
    engine.add_document(doc(9, "שלום"))
    engine.optimize()  # one segment: nothing happens, what is pending stays
    assert engine.get_document_count() == 2
    engine.commit()
    assert engine.get_document_count() == 3


def test_exact(engine):
    filled(engine, doc(1, "שלום עולם"), doc(2, "שלום רב"), doc(3, "Aa bb AA"), doc(4, "x " + "y" * 40 + " z"))
    assert ids(engine.search_exact("שלום")) == [1, 2]
    assert ids(engine.search_exact("שלום עולם")) == [1]
    assert ids(engine.search_exact("עולם שלום")) == []
    assert ids(engine.search_exact("שָׁלוֹם")) == [1, 2]
    assert ids(engine.search_exact("aa")) == [3]
    assert ids(engine.search_exact("x z")) == []  # the long token keeps its place
    for query in ("", "?!"):
        assert ids(engine.search_exact(query, ["/root"])) == []
        assert ids(engine.search_advanced(query)) == []
        assert ids(engine.search_fuzzy(query)) == []
        assert engine.count_exact(query) == 0


def test_fuzzy(engine):
    filled(engine, doc(1, "שלום"), doc(2, "שלם"), doc(3, "ביי"), doc(4, "אמר שלם לחברו"), doc(5, "שולם"))
    assert ids(engine.search_fuzzy("שלום", max_distance=0)) == [1]
    assert ids(engine.search_fuzzy("שלום", max_distance=1)) == [1, 2, 4, 5]  # an exchange is one edit
    assert {r.text for r in engine.search_fuzzy("שלום", max_distance=1).collect()} >= {"<font color=red>שלום</font>", "אמר <font color=red>שלם</font> לחברו"}
    assert ids(engine.search_fuzzy("שלום לחברו", max_distance=1)) == [4]
    assert ids(engine.search_fuzzy_terms(["שָׁלום"], max_distance=0)) == []  # as given
    for call in (engine.search_fuzzy, engine.count_fuzzy):
        with pytest.raises(ValueError, match="distance"):
            call("שלום", max_distance=3)


def edits(a, b):
    """Insertions, deletions, replacements and exchanges of neighbours that lead from ``a`` to ``b``, none touching another."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@pytest.mark.parametrize("word", ["abcd", "aabc", "abab", "ba", "a"])
def test_misspelt_against_brute_force(spark, word):
    import itertools

    terms = ["".join(x) for n in range(1, 6) for x in itertools.product("abcd"[: 4 if n < 5 else 3], repeat=n)]
    frame = spark.createDataFrame([(t, 1) for t in terms], "term string, df long")
    for distance in (1, 2):
        got = {r.term for r in match.misspelt(Index(frame, frame, frame, frame), word, distance).collect()}
        assert got == {t for t in terms if edits(t, word) <= distance}


@pytest.mark.parametrize(("pattern", "start"), [("abc.*", "abc"), ("ab*c", "a"), ("ab+c", "ab"), ("a?b", ""), ("(?:a|b)c", ""), ("ab|cd", ""), ("[ab]c", ""), ("שלו{2}", "של"), ("a\\.b", "a")])
def test_literal_start(pattern, start):
    assert match.literal_start(pattern) == start


def test_advanced(engine):
    filled(engine, doc(1, "ספר"), doc(2, "הספר"), doc(3, "מטבע"), doc(4, "מלך"), doc(5, "שר"), doc(6, "ספר תורה"))
    options = {"search_options": {"ספר_0": {GRAM_PREFIX: True}}}
    assert ids(engine.search_advanced("ספר", **options)) == [1, 2, 6]
    assert "<font color=red>הספר</font>" in {r.text for r in engine.search_advanced("ספר", **options).collect()}
    assert engine.count_advanced("ספר", **options) == 3
    assert ids(engine.search_advanced("שר", alternative_words={0: ["מלך"]})) == [4, 5]
    page = engine.search_and_count_advanced("סֵפֶר תורה", limit=1)
    assert (page.total_count, ids(page.results)) == (1, [6])
    assert page.results.first().text == "<font color=red>ספר</font> <font color=red>תורה</font>"


def test_expansions(engine):
    filled(engine, doc(1, "ספר"), doc(2, "הספר"))
    with pytest.raises(ExpansionError):
        engine.search([".*ספר"], max_expansions=1)
    assert ids(engine.search([".*ספר"], max_expansions=2)) == [1, 2]
    with pytest.raises(ExpansionError):
        engine.search([".*ספר", ".*ספר"], max_expansions=3)
    assert engine.count(["nothing", ".*"], max_expansions=1) == 0  # ends before the second is counted


def test_expansions_without_refusing(engine):
    filled(engine, doc(1, "את הספר ההוא"), doc(2, "את זה"), doc(3, "הים את"), doc(4, "את ספר הים", topics="/other"))
    ix = engine.index

    def found(patterns, slop, cap, facets=(), scored=False):
        return {r.row_id: r.score for r in match.regex(ix, patterns, slop, cap, facets, scored, refuse=False).rows.collect()}

    with pytest.raises(ExpansionError):
        match.regex(ix, ["את", "ה.*"], 1, 2)
    for patterns in (["את", "ה.*"], ["ה.*", "את"], [".*", "ה.*"], ["ה.*", ".*"], ["ה.*"], [".*ים"], ["none", ".*"], [".*", "none"]):
        for slop in (0, 1, 2):
            for facets in ((), ("/root",)):
                assert found(patterns, slop, 0, facets) == found(patterns, slop, 2, facets) == found(patterns, slop, 100, facets)
        few, all_ = found(patterns, 1, 0, scored=True), found(patterns, 1, 100, scored=True)
        assert few == pytest.approx(all_)
    assert len(found(["את", "ה.*"], 1, 2)) == 2 and len(found(["את", "ה.*"], 1, 2, ["/root"])) == 1
    assert len(found(["none", ".*"], 1, 0)) == 0


@pytest.mark.parametrize(("bad", "good"), [("^a", "[^a]"), ("a$", r"a\$"), ("(?:a|$)", "[$^]")])
def test_anchors(bad, good):
    with pytest.raises(ValueError, match="anchor"):
        whole_term(bad)
    assert whole_term(good)


def test_slop(engine):
    filled(engine, doc(1, "a b c"), doc(2, "a x b c"), doc(3, "a x b x c"), doc(4, "b a"), doc(5, "c b a"))
    assert ids(engine.search(["a", "b", "c"])) == [1]
    assert ids(engine.search(["a", "b", "c"], slop=1)) == [1, 2]
    assert ids(engine.search(["a", "b", "c"], slop=2)) == [1, 2, 3]
    assert ids(engine.search(["a", "b"], slop=1)) == [1, 2, 3]
    assert ids(engine.search(["a", "b"], slop=2)) == [1, 2, 3, 4, 5]  # an exchange costs two moves


def test_facets(engine):
    filled(engine, doc(1, "w", topics="/a/b"), doc(2, "w", topics="/a/c/d"), doc(3, "w", topics="/a"), doc(4, "w", topics="/ab"))
    assert ids(engine.search_exact("w", ["/a"])) == [1, 2, 3]
    assert ids(engine.search_exact("w", ["/a/b", "/ab"])) == [1, 4]
    assert ids(engine.search_exact("w", ["/"])) == [1, 2, 3, 4]
    assert ids(engine.search_exact("w", [])) == [1, 2, 3, 4]
    with pytest.raises(TopicError):
        engine.search_exact("w", ["not-a-facet"])
    assert {r.path: r["count"] for r in engine.get_facet_counts_exact("w", "/a").collect()} == {"/a/b": 1, "/a/c": 1}
    assert {r.path: r["count"] for r in engine.get_facet_counts(["w"], "/").collect()} == {"/a": 3, "/ab": 1}
    assert {r.path: r["count"] for r in engine.get_facet_counts_fuzzy("w", "/a", ["/a/c"], 0).collect()} == {"/a/c": 1}


def test_pages_chunks_and_order(engine):
    filled(engine, *[doc(n, "שלום " * (n % 3 + 1)) for n in (5, 3, 4, 1, 2)])
    assert ids(engine.search_exact("שלום", limit=2)) == [1, 2]
    assert ids(engine.search_exact("שלום", limit=2, offset=4)) == [5]
    assert ids(engine.search_exact("שלום", limit=0)) == []
    page = engine.search_and_count_exact("שלום", limit=1, offset=9)
    assert (page.total_count, ids(page.results)) == (5, [])
    assert [[r.id for r in c] for c in engine.search_exact_stream("שלום", chunk_size=2)] == [[1, 2], [3, 4], [5]]
    assert [len(c) for c in engine.search_stream(["שלום"], chunk_size=0)] == [1] * 5
    assert list(engine.search_fuzzy_stream("אין")) == []
    best = ids(engine.search_exact("שלום", order=ResultsOrder.RELEVANCE))
    assert best[0] == 3 and set(best[-2:]) == {5, 2}  # shorter texts first


def test_snippets(engine):
    text = " ".join(f"w{n}" for n in range(200)) + " <needle> & more"
    filled(engine, doc(1, text), doc(2, "needle needle x"))
    got = engine.search_exact("needle", highlight=HighlightConfig("[", "]", 60)).collect()
    assert got[0].text.endswith("[needle]&gt; &amp; more") and len(got[0].text) < 120
    assert got[1].text == "[needle] [needle] x"
    assert engine.search(["need.*", "x"]).collect()[0].text == "needle needle x"  # several patterns mark nothing


def test_properties(engine):
    filled(engine, *[doc(n, t, p, tp) for n, (t, p, tp) in enumerate([("a b c", "x", "/t/u"), ("a c b", "y", "/t"), ("b b a", "x", "/v"), ("ab ba", "z", "/t/w"), ("", "z", "/"), ("A-b", "y", "/t/u")])])
    for query in ("a", "a b", "b"):
        n = engine.count_exact(query)
        assert n == len(ids(engine.search_exact(query))) == sum(books(engine.count_by_book_exact(query)).values())
        assert set(ids(engine.search_exact(query, ["/t"]))) <= set(ids(engine.search_exact(query)))
    assert engine.count_exact("a") == engine.count_fuzzy("a", max_distance=0) <= engine.count_fuzzy("a", max_distance=1)
    by_slop = [engine.count(["a", "b"], slop=s) for s in range(4)]
    assert by_slop == sorted(by_slop)
