"""Timing of searches, and the analysis of timings."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.engine import Searcher
from folioscan.schema import ResultsOrder

# What a sign in a pattern adds to its complexity, and the times that part fast, medium and slow.
WEIGHTS = ((".*", 0.5), ("[", 1.0), ("(", 1.5), ("{", 0.8))
REPEATS = ("+", "*")
FAST_MS, SLOW_MS = 50, 200
FEW_EXPANSIONS = 100
ALL_TERMS = 1000
HEBREW_SLOW_MS = 100
# Words in a case's name that put it into a group of texts, in order of precedence.
GROUPS = {"talmudic": ("Talmudic", "Rabbi"), "biblical": ("Biblical", "Verse"), "halachic": ("Halachic", "Responsa")}
# The patterns of a diagnostic run, by name.
DIAGNOSTIC = {
    "Hebrew letter aleph": "א", "Hebrew letter bet": "ב", "Hebrew letter gimel": "ג", "Word: and": "ו", "Word: the": "ה", "Word: in": "ב",
    "Any Hebrew letter": "[א-ת]", "Two Hebrew letters": "[א-ת][א-ת]", "Simple wildcard": ".*",
}
RESULT = "query_name string, regex_terms array<string>, slop int, max_expansions int, execution_time_ms long, result_count int, memory_usage_mb double"


@dataclass(frozen=True)
class TestCase:
    query_name: str
    regex_terms: list[str]
    facets: list[str]
    slop: int
    max_expansions: int


@dataclass(frozen=True)
class BenchmarkResult:
    query_name: str
    regex_terms: list[str]
    slop: int
    max_expansions: int
    execution_time_ms: int
    result_count: int
    memory_usage_mb: float


def estimated_memory(regex_terms: Sequence[str], max_expansions: int) -> float:
    """MB that a query is taken to need: a formula over its patterns, nothing measured."""
    total = sum(1 + sum(w for sign, w in WEIGHTS if sign in t) + 0.3 * any(s in t for s in REPEATS) for t in regex_terms)
    return 1 + total * max_expansions / 1000


def estimated_memory_column(regex_terms: Column, max_expansions: Column) -> Column:
    def one(t: Column) -> Column:
        parts = [F.when(F.instr(t, sign) > 0, w).otherwise(0.0) for sign, w in WEIGHTS]
        repeat = F.when((F.instr(t, "+") > 0) | (F.instr(t, "*") > 0), 0.3).otherwise(0.0)
        return sum(parts, F.lit(1.0)) + repeat

    total = F.aggregate(F.transform(regex_terms, one), F.lit(0.0), lambda a, x: a + x)
    return F.lit(1.0) + total * max_expansions / 1000


def complexity(regex_terms: Column) -> Column:
    """Kinds of signs in the patterns, comma-separated; ``simple`` without any."""
    joined = F.array_join(regex_terms, " ")
    tags = [
        F.when(joined.contains(".*"), "wildcard"),
        F.when(joined.contains("[א-ת]"), "hebrew class"),
        F.when(joined.contains("|"), "alternation"),
        F.when(joined.contains("+") | joined.contains("?"), "quantifier"),
        F.when(joined.contains("{"), "repetition"),
    ]
    found = F.concat_ws(",", *tags)
    return F.when(found == "", "simple").otherwise(found)


class RegexBenchmarker:
    """Runs cases against an index: warm-up runs for 10 results, then timed ones for 100, by relevance."""

    def __init__(self, spark: SparkSession, searcher: Searcher):
        self.spark, self.searcher = spark, searcher

    def _once(self, case: TestCase, limit: int) -> int:
        found = self.searcher.search(case.regex_terms, case.facets, limit, case.slop, case.max_expansions, ResultsOrder.RELEVANCE)
        return len(found.collect())

    def benchmark_single_query(self, case: TestCase, warmups: int = 2, runs: int = 5) -> BenchmarkResult:
        for _ in range(warmups):
            self._once(case, 10)
        began, n = time.perf_counter(), 0
        for _ in range(runs):
            n = self._once(case, 100)
        ms = int((time.perf_counter() - began) * 1000 / max(runs, 1))
        return BenchmarkResult(case.query_name, list(case.regex_terms), case.slop, case.max_expansions, ms, n, estimated_memory(case.regex_terms, case.max_expansions))

    def benchmark_custom_queries(self, cases: Sequence[TestCase], warmups: int = 2, runs: int = 5) -> DataFrame:
        """A row per case; a case that the search refuses has no time and no count but the error in its row, and the others go on."""
        rows = []
        for c in cases:
            try:
                rows.append((*asdict(self.benchmark_single_query(c, warmups, runs)).values(), None))
            except ValueError as e:
                rows.append((c.query_name, list(c.regex_terms), c.slop, c.max_expansions, None, None, estimated_memory(c.regex_terms, c.max_expansions), str(e)))
        return self.spark.createDataFrame(rows, f"{RESULT}, error string")

    def run_comprehensive_benchmark(self, words: Sequence[str], warmups: int = 2, runs: int = 5) -> DataFrame:
        return self.benchmark_custom_queries(comprehensive_cases(words), warmups, runs)

    def run_focused(self, cases: Sequence[TestCase]) -> DataFrame:
        """One warm-up and one timed run for each case, an error told in its row."""
        rows = []
        for c in cases:
            try:
                r = self.benchmark_single_query(c, 1, 1)
                rows.append((c.query_name, r.execution_time_ms, r.result_count, None))
            except ValueError as e:
                rows.append((c.query_name, None, None, str(e)))
        return self.spark.createDataFrame(rows, "query_name string, execution_time_ms long, result_count int, error string")

    def run_diagnostic(self, cases: Sequence[TestCase] | None = None) -> DataFrame:
        """How many of up to 10 results each case (those of ``DIAGNOSTIC`` if none are given) finds with 100 expansions, and how many records hold any term if that takes no
        more than ``ALL_TERMS`` expansions; an error is told in its row."""
        rows = []
        for c in [TestCase(n, [p], [], 0, 100) for n, p in DIAGNOSTIC.items()] if cases is None else cases:
            try:
                rows.append((c.query_name, self._once(TestCase(c.query_name, c.regex_terms, c.facets, c.slop, 100), 10), None))
            except ValueError as e:
                rows.append((c.query_name, None, str(e)))
        try:
            rows.append(("any term", self.searcher.count([".*"], max_expansions=ALL_TERMS), None))
        except ValueError as e:
            rows.append(("any term", None, str(e)))
        return self.spark.createDataFrame(rows, "query_name string, result_count int, error string")


def comprehensive_cases(words: Sequence[str]) -> list[TestCase]:
    """Cases of growing complexity around ``words`` (four at least): words, affixes, classes, alternations; phrases with slop."""
    a, b, c, d = words[:4]
    half = a[: max(1, len(a) // 2)]
    shapes = [
        ("word", [a], 0, 50), ("ending", [f"{a}.*"], 0, 200), ("beginning", [f".*{a}"], 0, 200), ("half", [f"{half}.*"], 0, 1000),
        ("optional", [f"{a}(?:.)?"], 0, 200), ("either", [f"(?:{a}|{b})"], 0, 50), ("one of four", [f"(?:{'|'.join(words[:4])})"], 0, 50),
        ("class", [f"[{a[0]}{b[0]}]{a[1:]}"], 0, 100), ("length", [f"{half}.{{0,3}}"], 0, 1000), ("plus", [f"{a}.+"], 0, 500),
        ("phrase", [a, b], 0, 100), ("near", [a, b], 2, 100), ("far", [a, b], 5, 100), ("near ending", [f"{a}.*", b], 2, 500),
        ("near endings", [f"{a}.*", f"{b}.*"], 3, 1000), ("either, then", [f"(?:{a}|{b})", c], 1, 100),
        ("three", [a, b, c], 0, 100), ("three, far", [a, b, c], 5, 100), ("three endings", [f"{a}.*", f"{b}.*", f"{c}.*"], 4, 1000),
        ("four", [a, b, c, d], 0, 100), ("four, far", [a, b, c, d], 5, 200),
    ]
    return [TestCase(n, t, [], s, m) for n, t, s, m in shapes]


def focused_cases(words: Sequence[str]) -> list[TestCase]:
    """Single patterns of growing reach around ``words`` (two at least), with caps from 50 to 10,000."""
    a, b = words[:2]
    shapes = [(a, 50), (f"{a}.*", 100), (f".*{a}", 500), (f".*{a}.*", 1000), (f"(?:{a}|{b})", 50), (f"{a[:2]}.*", 5000), (f"{a[:1]}.{{1,3}}", 10_000), (f"[{a[0]}{b[0]}].*", 10_000), (".{3}", 10_000)]
    return [TestCase(p, [p], [], 0, cap) for p, cap in shapes]


def report(results: DataFrame) -> str:
    """The timed runs from the fastest to the slowest, and how many were fast, medium and slow. For suites, whose size is that of their cases."""
    rows = timed(results).orderBy("execution_time_ms", "query_name").collect()
    lines = [f"{r.execution_time_ms:>8} ms  {r.result_count or 0:>4} results  {r.query_name}" for r in rows]
    named = {r.speed: r.runs for r in speeds(results).collect()}
    return "\n".join([*lines, ", ".join(f"{named.get(s, 0)} {s}" for s in ("fast", "medium", "slow"))])


def timed(results: DataFrame) -> DataFrame:
    """Results without runs that weren't timed (null or negative times)."""
    return results.where("execution_time_ms >= 0")


def summary(results: DataFrame) -> DataFrame:
    """Total, mean, least and greatest time of the timed runs."""
    ms = F.col("execution_time_ms")
    return timed(results).agg(F.count("*").alias("runs"), F.sum(ms).alias("total_ms"), F.round(F.avg(ms), 6).alias("mean_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"))


def speed(ms: Column) -> Column:
    return F.when(ms < FAST_MS, "fast").when(ms < SLOW_MS, "medium").otherwise("slow")


def speeds(results: DataFrame) -> DataFrame:
    """Runs that were fast, medium and slow."""
    return timed(results).groupBy(speed(F.col("execution_time_ms")).alias("speed")).agg(F.count("*").alias("runs"))


def patterns(results: DataFrame) -> DataFrame:
    """Mean time by number of patterns, slop and size of expansion: ``(kind, part, runs, mean_ms)``."""
    kinds = F.array(
        F.struct(F.lit("terms").alias("kind"), F.when(F.size("regex_terms") == 1, "single").otherwise("multi").alias("part")),
        F.struct(F.lit("slop").alias("kind"), F.when(F.col("slop") > 0, "with").otherwise("without").alias("part")),
        F.struct(F.lit("expansion").alias("kind"), F.when(F.col("max_expansions") <= FEW_EXPANSIONS, "low").otherwise("high").alias("part")),
    )
    parts = timed(results).select(F.inline(kinds), "execution_time_ms")
    return parts.groupBy("kind", "part").agg(F.count("*").alias("runs"), F.round(F.avg("execution_time_ms"), 6).alias("mean_ms"))


def by_complexity(results: DataFrame) -> DataFrame:
    """Runs, mean time and runs over 100 ms by the signs in the patterns."""
    slow = F.sum((F.col("execution_time_ms") > 100).cast("long"))
    return timed(results).groupBy(complexity(F.col("regex_terms")).alias("complexity")).agg(F.count("*").alias("runs"), F.round(F.avg("execution_time_ms"), 6).alias("mean_ms"), slow.alias("over_100_ms"))


def impacts(results: DataFrame) -> DataFrame:
    """``(kind, times)``: how many times as long runs with slop, with many expansions and of several patterns take on average."""
    pairs = {"terms": ("multi", "single"), "slop": ("with", "without"), "expansion": ("high", "low")}
    mean = lambda part: F.max(F.when(F.col("part") == part, F.col("mean_ms")))
    times = F.coalesce(*[F.when(F.col("kind") == k, mean(a) / F.nullif(mean(b), F.lit(0.0))) for k, (a, b) in pairs.items()])
    return patterns(results).groupBy("kind").agg(F.round(times, 4).alias("times"))


def slow_runs(results: DataFrame) -> DataFrame:
    """Runs over ``SLOW_MS`` with the kinds of signs in their patterns."""
    return timed(results).where(F.col("execution_time_ms") > SLOW_MS).select("query_name", complexity(F.col("regex_terms")).alias("complexity"), "execution_time_ms")


def text_group(name: Column) -> Column:
    """The group of texts that a case's name tells, ``other`` without any of the words."""
    out = F.lit("other")
    for group, words in reversed(GROUPS.items()):
        out = F.when(name.contains(words[0]) | name.contains(words[1]), group).otherwise(out)
    return out


def by_group(results: DataFrame) -> DataFrame:
    """Mean time by group of texts."""
    return timed(results).groupBy(text_group(F.col("query_name")).alias("group")).agg(F.count("*").alias("runs"), F.round(F.avg("execution_time_ms"), 6).alias("mean_ms"))


def hebrew_slow(results: DataFrame) -> DataFrame:
    """Patterns with a class of Hebrew letters in runs over ``HEBREW_SLOW_MS``, and whether they also have a wildcard."""
    slow = timed(results).where(F.col("execution_time_ms") > HEBREW_SLOW_MS).select("query_name", "execution_time_ms", F.explode("regex_terms").alias("pattern"))
    return slow.where(F.col("pattern").contains("[א-ת]")).withColumn("wildcard", F.col("pattern").contains(".*"))


def by_keyword(results: DataFrame) -> DataFrame:
    """Mean time by the last part of the query's name."""
    return timed(results).groupBy(F.regexp_extract("query_name", "([^_]+)$", 1).alias("keyword")).agg(F.count("*").alias("runs"), F.round(F.avg("execution_time_ms"), 6).alias("mean_ms"))
