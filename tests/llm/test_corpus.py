import os
import random
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from folioscan.llm import leakage, mixing
from folioscan.llm.leakage import SuffixAutomaton, _walk, leaked_items, without_leaks
from folioscan.llm.mixing import fit_counts, plan_mixture, select_mixture, term_tokens, tokenizer_lengths
from folioscan.llm.subjects import fit_subjects, stems, subject_areas
from tests.conftest import DATA


def brute(words, items, least):
    best = {}
    for i, w in items.items():
        for a in range(len(words)):
            for b in range(len(w)):
                n = 0
                while a + n < len(words) and b + n < len(w) and words[a + n] == w[b + n]:
                    n += 1
                if n >= least:
                    best[i] = max(best.get(i, 0), n)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_automaton(seed):
    r = random.Random(seed)
    items = {k: [r.choice("abc") for _ in range(r.randint(1, 14))] for k in range(4)}
    items[4] = items[0][:5] + items[1]
    a = SuffixAutomaton(items)
    auto = (a.ids, a.next, a.link, a.length, a.cut_states(3), a.ends)
    for _ in range(10):
        words = [r.choice("abcd") for _ in range(r.randint(0, 30))]
        runs = _walk(words, auto, 3)
        assert {i: max(e - s for s, e, _ in found) for i, found in runs.items()} == brute(words, items, 3)
        assert all(words[s:e] == items[i][at - (e - s) : at] for i, found in runs.items() for s, e, at in found)
        covered = {k for found in runs.values() for s, e, _ in found for k in range(s, e)}
        expected = {k for s in range(len(words)) for e in range(s + 3, len(words) + 1) if brute(words[s:e], items, e - s) for k in range(s, e)}
        assert covered == expected


@pytest.fixture
def items(spark):
    rows = [(1, " ".join(f"a{n}" for n in range(20))), (2, " ".join(["same"] * 3 + [f"b{n}" for n in range(15)])), (3, None), (4, ""), (1, " ".join(f"c{n}" for n in range(13)))]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit(7))


def test_leaks(spark, items):
    a = [f"A{n}" for n in range(20)]
    rows = [
        (1, "x, " + "; ".join(a[2:14]) + " y"),
        (2, " ".join(a[:11])),
        (3, " ".join(a[:6] + ["z"] + a[6:])),
        (4, None),
        (5, ""),
        (6, " ".join(f"b́{n}" for n in range(15))),
        (7, "q " * 50_000 + " ".join(f"c{n}" for n in range(13))),
        (1, " ".join(a)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(3))
    got = {(r.doc_id, r.item_id): (r.words, r.coverage) for r in leaked_items(docs, items).collect()}
    assert got == {(1, 1): (20, 1.0), (3, 1): (14, 0.7), (6, 2): (15, round(15 / 18, 6)), (7, 1): (13, 0.65)}
    clean = {(r.doc_id, r.removed_words): (r.text, r.dropped) for r in without_leaks(docs, items, max_coverage=0.9).collect()}
    assert clean[1, 12] == ("x,  y", False)
    assert clean[1, 20] == ("", True)
    assert clean[2, 0][0] == " ".join(a[:11])
    assert clean[4, 0] == (None, False)
    assert len(clean) == len(rows)
    assert leaked_items(docs.limit(0), items).collect() == []
    assert leaked_items(docs, items.limit(0)).collect() == []


def test_leaks_by_coverage(spark):
    """Short items, and items in pieces, count by coverage; items in several passes give the same."""
    whole = [f"p{n}" for n in range(30)]
    items = spark.createDataFrame([(1, "q0 q1 q2 q3 q4 q5 q6"), (2, " ".join(whole)), (3, "one two"), (4, "r0 r1 r2 r3 r4 r5 r6 r7 r8")], "item_id long, text string")
    pieces = " - x ".join(" ".join(whole[k : k + 8]) for k in range(0, 30, 8))
    rows = [(1, "see Q0 q1 q2 q3 q4 q5 q6!"), (2, pieces), (3, "one two"), (4, "r0 r1 r2 r3 r4 x"), (5, " ".join(whole[:11])), (6, " ".join(whole[:12]) + " more words to keep here and there and so on")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    strict = {(r.doc_id, r.item_id): r.words for r in leaked_items(docs, items).collect()}
    assert strict == {(6, 2): 12}
    for most in (400_000, 10):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(leakage, "MAX_ITEM_WORDS", most)
            got = {(r.doc_id, r.item_id): (r.words, r.coverage) for r in leaked_items(docs, items, min_coverage=0.8).collect()}
            assert got == {(1, 1): (7, 1.0), (2, 2): (8, 1.0), (6, 2): (12, 0.4)}
            clean = {r.doc_id: r for r in without_leaks(docs, items, min_coverage=0.8, max_coverage=0.95).collect()}
            assert clean[1].text == "see !" and clean[1].removed_words == 7
            assert clean[2].text.split() == ["-", "x"] * 3 and clean[6].text.strip().startswith("more words")
            assert [clean[k].removed_words for k in (3, 4, 5)] == [0, 0, 0]


def test_stems():
    assert stems("והמחזור") >= {"והמחזור", "המחזור", "מחזור"}
    assert "עדות" in stems("עדותא")
    assert stems("word") == {"word"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")
def test_subjects_held_out(spark):
    examples = spark.read.parquet(f"{DATA}/sf0.001/subject_example.parquet")
    known, held = examples.where("example_id % 4 != 0"), examples.where("example_id % 4 = 0")
    model = fit_subjects(known)
    got = {(r.doc_id, r.subject) for r in subject_areas(held.withColumnRenamed("example_id", "doc_id"), model).collect()}
    true = {(r.example_id, r.subject) for r in held.collect()}
    assert len(got & true) >= 0.97 * len(true)
    assert len(got - true) <= 0.03 * len(got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "zzz " * 20_000), (4, "!!")], "doc_id long, text string")
    assert subject_areas(odd, model).collect() == []
    assert subject_areas(odd.limit(0), model).collect() == []
    empty = fit_subjects(known.limit(0))
    assert subject_areas(held.withColumnRenamed("example_id", "doc_id"), empty).collect() == []


def best_sum(lengths, budget):
    sums = {0}
    for n, c in lengths.items():
        for _ in range(c):
            sums |= {s + n for s in sums if s + n <= budget}
    return max(sums)


@pytest.mark.parametrize("seed", range(20))
def test_fits_the_budget_best(seed):
    r = random.Random(seed)
    lengths = {r.randint(3, 60): r.randint(1, 6) for _ in range(6)}
    budget = r.randint(0, sum(n * c for n, c in lengths.items()) + 20)
    got = fit_counts(lengths, budget)
    assert all(0 < c <= lengths[n] for n, c in got.items())
    assert sum(n * c for n, c in got.items()) == best_sum(lengths, budget)


def test_fits_large_budgets():
    lengths = {n: 5000 for n in range(80, 300)}
    for budget in (10**7, 10**8):
        got = fit_counts(lengths, budget)
        assert sum(n * c for n, c in got.items()) == budget
        assert all(c <= 5000 for c in got.values())


def test_mixture(spark):
    r = random.Random(4)
    rows = [(n, r.choice(["a"] * 6 + ["b"] * 3 + ["c"]), r.randint(5, 90)) for n in range(600)] + [(1000, "d", 0), (1001, "other", 50)]
    lengths = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.3, 2), ("none", 0.0, 2), ("gone", 0.01, 9), ("n", None, None), (None, 0.1, 1), ("d", 0.0, 1)], "source string, target_share double, max_repeats int")
    report, takes = plan_mixture(lengths, targets)
    total = sum(x[2] for x in rows)
    have = Counter()
    for _, s, n in rows:
        have[s] += n
    got = {x.source: x for x in report.collect()}
    assert set(got) == {"a", "b", "c", "none", "gone", "n", "d"}
    assert not got["c"].reachable and not got["gone"].reachable and got["a"].reachable and got["none"].reachable and got["n"].reachable
    assert got["c"].mixed_tokens == 2 * have["c"]
    assert got["a"].mixed_tokens == got["a"].wanted_tokens == int(0.3 * total)
    assert sum(x.reached_share for x in got.values()) == pytest.approx(1.0, abs=1e-5)
    chosen = select_mixture(lengths, takes).collect()
    mixed = Counter()
    for x in chosen:
        mixed[x.source] += x.copies * x.n_tokens
        assert 1 <= x.copies <= got[x.source].max_repeats
    assert {s: n for s, n in mixed.items() if n} == {s: x.mixed_tokens for s, x in got.items() if x.mixed_tokens}
    again = select_mixture(lengths.repartition(7), takes).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, chosen))
    report, takes = plan_mixture(lengths.limit(0), targets)
    assert {x.source for x in report.where("not reachable").collect()} == set()
    assert select_mixture(lengths.limit(0), takes).collect() == []


@pytest.mark.parametrize("parts", [1, 8, 1 << 16])
def test_mixture_of_one_length(spark, monkeypatch, parts):
    """A source whose documents all have one length: as many as planned, whatever the parts of the hash."""
    monkeypatch.setattr(mixing, "HASH_PARTS", parts)
    lengths = spark.range(5000).selectExpr("id as doc_id", "if(id < 4000, 'hot', 'other') as source", "if(id < 4000, 100L, id % 7) as n_tokens")
    takes = spark.createDataFrame([("hot", 100, 1234, 0)], "source string, n_tokens long, take long, whole_repeats long")
    got = select_mixture(lengths, takes).collect()
    assert len(got) == 1234 and {(x.source, x.copies) for x in got} == {("hot", 1)}
    twice = select_mixture(lengths, takes.withColumn("whole_repeats", F.lit(2).cast("long"))).collect()
    assert Counter(x.copies for x in twice) == {3: 1234, 2: 2766}
    assert {x.doc_id for x in twice if x.copies == 3} == {x.doc_id for x in got}


def test_even_share_of_every_length():
    """Whatever the budget's size, documents of all lengths are taken in proportion."""
    lengths = {n: 400 for n in range(50, 150)}
    total = sum(n * c for n, c in lengths.items())
    for share in (0.02, 0.1, 0.5, 0.9):
        got = fit_counts(lengths, int(total * share))
        assert sum(n * c for n, c in got.items()) == int(total * share)
        assert all(abs(got.get(n, 0) - 400 * share) <= 50 for n in lengths)


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/byte_bpe_multi_50k.tiktoken"), reason="needs the vocabulary")
def test_token_counts(spark):
    rows = [(1, "s", "hello world"), (2, "s", None), (3, "s", ""), (4, "s", "שלום " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n_tokens", F.lit(5))
    got = {r.doc_id: r.n_tokens for r in tokenizer_lengths(df, "/opt/tokenizers/byte_bpe_multi_50k.tiktoken").collect()}
    assert got[1] > 1 and got[2] == got[3] == 0 and got[4] > 9000
    counted = {r.doc_id: r.n for r in df.select("doc_id", term_tokens(F.col("text")).alias("n")).collect()}
    assert counted == {i: len(regex.findall(r"[\p{L}\p{M}\p{N}]+", t or "")) for i, _, t in rows}
