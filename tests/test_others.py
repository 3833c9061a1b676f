import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from folioscan import bench
from folioscan.engine import SearchEngine
from folioscan.functions import topics as T
from folioscan.functions.analysis import query_terms, raw_tokens
from folioscan.operators import match
from folioscan.operators.index import Index, build_index
from folioscan.operators.results import highlight_weights
from folioscan.plans import catalogue, writes
from folioscan.schema import DOCUMENT, STORED, DocumentInput
from folioscan.streaming.ingest import ingest
from tests.conftest import DATA, compare


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def test_tokens(spark):
    assert one(spark, raw_tokens(F.lit("שָׁלוֹם בְּרֵאשִׁ֖ית x-1 é"))) == ["שָׁלוֹם", "בְּרֵאשִׁ", "ית", "x", "1", "é"]
    assert one(spark, raw_tokens(F.lit(None).cast("string"))) == []
    assert query_terms("שָׁלוֹם א־ב C") == ["שלום", "אב", "c"]


def test_topics(spark):
    for stored, path in ((None, "/"), ("a/b/", "/a/b"), ("/", "/"), ("/a", "/a"), ("", "/")):
        assert one(spark, T.tidy(F.lit(stored).cast("string"))) == path
    assert one(spark, T.ancestors(F.lit("/a/b/c"))) == ["/a", "/a/b", "/a/b/c"]
    assert one(spark, T.ancestors(F.lit("/"))) == []
    assert one(spark, T.child(F.lit("/a/b/c"), "/a")) == "/a/b"
    assert one(spark, T.child(F.lit("/a"), "/a")) is None
    assert one(spark, T.child(F.lit("/ab"), "/a")) is None


def test_benchmarks(spark, tmp_path):
    engine = SearchEngine(spark, str(tmp_path / "index"))
    engine.add_document(DocumentInput(1, "t", "r", "/", "alpha beta gamma delta", 0, False, "p"))
    engine.commit()
    runner = bench.RegexBenchmarker(spark, engine)
    cases = [bench.TestCase("one", ["al.*"], [], 0, 10), bench.TestCase("two", ["alpha", "beta"], [], 1, 200)]
    got = runner.benchmark_custom_queries(cases, 0, 1)
    assert [(r.query_name, r.result_count) for r in got.collect()] == [("one", 1), ("two", 1)]
    assert got.first().memory_usage_mb == pytest.approx(1 + 1.8 * 0.01)
    assert bench.summary(got).first().runs == 2
    assert {(r.kind, r.part) for r in bench.patterns(got).collect()} >= {("terms", "single"), ("terms", "multi"), ("expansion", "high")}
    focused = runner.run_focused([*cases, bench.TestCase("bad", [".*"], [], 0, 1)]).collect()
    assert focused[2].error and focused[0].error is None
    assert [r.result_count for r in runner.run_diagnostic(cases).collect()] == [1, 1, 1]
    assert [r.result_count for r in runner.run_diagnostic().collect()] == [0] * 8 + [1, 1]
    named = [("Rabbi and Verse", ["[א-ת]+.*"], 0, 50, 250, 1, 1.0), ("Verse", ["x"], 1, 500, 101, 1, 1.0), ("plain", ["[א-ת]", "b"], 0, 50, -1, None, None)]
    runs = spark.createDataFrame(named, bench.RESULT)
    assert {(r.group, r.runs) for r in bench.by_group(runs).collect()} == {("talmudic", 1), ("biblical", 1)}
    assert [tuple(r) for r in bench.slow_runs(runs).collect()] == [("Rabbi and Verse", "wildcard,hebrew class,quantifier", 250)]
    assert [tuple(r) for r in bench.hebrew_slow(runs).collect()] == [("Rabbi and Verse", 250, "[א-ת]+.*", True)]
    assert {r.kind: r.times for r in bench.impacts(runs).collect()} == {"terms": None, "slop": 0.404, "expansion": 0.404}
    told = bench.report(got).splitlines()
    assert len(told) == 3 and "slow" in told[2]
    assert len(runner.run_focused(bench.focused_cases(["alpha", "beta"])[:2]).collect()) == 2
    assert len(bench.comprehensive_cases(["alpha", "beta", "gamma", "delta"])) == 21
    engine.close()


def test_a_refused_case_leaves_the_suite_whole(spark, tmp_path):
    engine = SearchEngine(spark, str(tmp_path / "index"))
    engine.add_document(DocumentInput(1, "t", "r", "/", "alpha beta gamma delta " + " ".join(f"al{n}" for n in range(1001)), 0, False, "p"))
    engine.commit()
    got = bench.RegexBenchmarker(spark, engine).run_comprehensive_benchmark(["alpha", "beta", "gamma", "delta"], 0, 1)
    rows = {r.query_name: r for r in got.collect()}
    assert list(rows) == [c.query_name for c in bench.comprehensive_cases(["alpha", "beta", "gamma", "delta"])]
    half = rows.pop("half")  # "al.*" stands for 1,002 terms and may for 1,000
    assert (half.execution_time_ms, half.result_count) == (None, None) and "1000" in half.error
    assert all(r.error is None and r.execution_time_ms >= 0 for n, r in rows.items() if n != "length")
    assert bench.summary(got).first().runs == got.where("error is null").count()
    engine.close()


def test_phrase_with_a_pattern_of_many_terms(spark, monkeypatch):
    """The query counts whole where its pattern stands for more terms than 5,000."""
    many = " ".join(f"ה{n}" for n in range(5001))
    rows = [(1, 1, "", "", "/עברית/law", f"את {many}", 0, False, ""), (2, 2, "", "", "/עברית/law", "את", 0, False, ""), (3, 3, "", "", "/english", "את הספר", 0, False, "")]
    ix = build_index(spark.createDataFrame(rows, STORED))
    monkeypatch.setattr(catalogue, "open_index", lambda spark, d: ix)
    assert catalogue.queries()["regex_phrase_facet"](spark, "").first().total_count == 1


def test_highlight_budget_beyond_all_bounds(spark, monkeypatch):
    """A vocabulary over the query's 1,000,000 terms, of which no more than are marked come to the driver."""
    rows = spark.range(1_000_001).select(F.format_string("w%07d", "id").alias("term"), F.lit(1).cast("long").alias("df"))
    vocabulary = rows.unionByName(spark.createDataFrame([("court", 3)], "term string, df long"))
    none = spark.createDataFrame([], "term string, row_id long, positions array<int>")
    ix = Index(spark.createDataFrame([], STORED), none, vocabulary, spark.createDataFrame([], "row_id long, dl long"))
    monkeypatch.setattr(writes, "open_index", lambda spark, d: ix)
    assert [tuple(r) for r in writes.queries()["highlight_budget"](spark, "").collect()] == [("one", 512), ("two", 256)]
    many = match.regex(ix, [".*"], 0, 1_000_000, scored=False, refuse=False)
    assert sorted(highlight_weights(ix, many))[:3] == ["court", "w0000000", "w0000001"]


def test_stream_into_index(spark, tmp_path):
    source = tmp_path / "in"
    rows = [DocumentInput(n, "t", "r", "/", f"word{n}", 0, False, "p").values() for n in (1, 2)]
    spark.createDataFrame(rows, DOCUMENT).write.parquet(str(source))
    engine = SearchEngine(spark, str(tmp_path / "index"))
    stream = spark.readStream.schema(DOCUMENT).parquet(str(source))
    ingest(stream, engine, str(tmp_path / "cp")).awaitTermination()
    assert engine.get_document_count() == 2
    changed = [DocumentInput(2, "t", "r", "/", "changed", 0, False, "p").values()]
    spark.createDataFrame(changed, DOCUMENT).write.mode("append").parquet(str(source))
    ingest(stream, engine, str(tmp_path / "cp")).awaitTermination()
    assert engine.get_document_count() == 2
    assert (engine.count_exact("word2"), engine.count_exact("changed")) == (0, 1)
    engine.close()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql() | writes.oracle_sql()))
def test_against_sql(spark, name):
    directory = f"{DATA}/sf0.001"
    queries, sql = catalogue.queries() | writes.queries(), catalogue.oracle_sql() | writes.oracle_sql()
    got, expected = compare(queries[name](spark, directory), sql[name], directory)
    assert got == expected


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")
def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["id", "title", "reference", "file_path", "text"]
    assert frame.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
