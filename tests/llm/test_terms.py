import math
import random
from collections import Counter, defaultdict

import pytest
import regex

from folioscan.llm import frequency
from folioscan.llm.distinctive import distinctive_terms
from folioscan.llm.frequency import marked_terms, term_frequencies
from folioscan.llm.queries import p6_phrases

random.seed(3)
WORDS = ["the", "The", "of", "שלום", "שָׁלוֹם", "é", "x" * 40, "א" * 20, "rare1", "rare2", "b-c", "12"]
TEXTS = [" ".join(random.choices(WORDS, weights=[30, 5, 20, 9, 3, 2, 2, 2, 1, 1, 3, 2], k=random.randint(0, 40))) for _ in range(60)]
ROWS = [(n, t) for n, t in enumerate(TEXTS)] + [(100, None), (101, ""), (102, "?! -"), (103, TEXTS[0]), (104, "the " * 30_000)]


def tokens(text):
    return [w.lower() for w in regex.findall(r"[\p{L}\p{M}\p{N}]+", text or "") if len(w.encode()) < 40]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, "row_id long, text string").selectExpr("*", "'a' as term", "1 as tf", "2 as n").repartition(5)


@pytest.mark.parametrize("max_len", [1, 2, 3])
@pytest.mark.parametrize("held", [3, 200_000])
def test_frequencies(df, monkeypatch, max_len, held):
    monkeypatch.setattr(frequency, "HELD", held)
    count, records = Counter(), defaultdict(set)
    for i, t in ROWS:
        w = tokens(t)
        for n in range(1, max_len + 1):
            for k in range(len(w) - n + 1):
                g = tuple(w[k : k + n])
                count[g] += 1
                records[g].add(i)
    got = {tuple(r.terms): (r.occurrences, r.records) for r in term_frequencies(df, max_len=max_len).collect()}
    assert got == {g: (c, len(records[g])) for g, c in count.items()}
    some = {tuple(r.terms) for r in term_frequencies(df, max_len=max_len, min_records=3).collect()}
    assert some == {g for g in count if len(records[g]) >= 3}


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_stack_over_batches(rows):
    """Whatever the batches, a prefix that goes on from one to the next is told once."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(2)
    suffixes = sorted({frequency.BETWEEN.join([*(r.choice("abc") for _ in range(k)), *[""] * (3 - k)]) for k in (1, 2, 3) for _ in range(40)}, reverse=True)
    stack = frequency.PrefixStack(3, 1)
    told = []
    for a in range(0, len(suffixes), rows):
        part = suffixes[a : a + rows]
        told += stack.push(pa.array(part), np.zeros(len(part), np.int32), np.full(len(part), 2, np.int32), np.ones(len(part), np.int32)).to_pylist()
    told += stack.end().to_pylist()
    expected = Counter()
    for s in suffixes:
        w = s.rstrip(frequency.BETWEEN).split(frequency.BETWEEN)
        expected.update(frequency.BETWEEN.join(w[: k + 1]) for k in range(len(w)))
    assert {x["run"]: x["records"] for x in told} == expected and len(told) == len(expected)
    assert all(x["occurrences"] == 2 * x["records"] for x in told)


def test_marks(df, spark):
    got = {r.term: r.mark for r in marked_terms(df).collect()}
    records = Counter(w for _, t in ROWS for w in set(tokens(t)))
    for w, n in records.items():
        assert got[w] == ("rare" if n == 1 else "common" if n > len(ROWS) / 10 else None)
    assert marked_terms(df.limit(0)).collect() == []


def test_ppmi(df):
    joint = {i: Counter(tokens(t)) for i, t in ROWS}
    c, records = Counter(), Counter()
    for k in joint.values():
        c.update(k)
        records.update(k.keys())
    n = {i: sum(k.values()) for i, k in joint.items()}
    whole = sum(v**0.75 for v in n.values() if v)
    expected = {(i, w): (tf, records[w], max(0.0, math.log(tf * whole / (c[w] * n[i] ** 0.75)))) for i, k in joint.items() for w, tf in k.items()}
    got = {(r.row_id, r.term): (r.tf, r.records, r.ppmi) for r in distinctive_terms(df).collect()}
    assert got.keys() == expected.keys()
    for k, v in got.items():
        assert v[:2] == expected[k][:2] and v[2] == pytest.approx(expected[k][2], abs=1e-9)
    some = {(r.row_id, r.term) for r in distinctive_terms(df, min_tf=2, max_records=20).collect()}
    assert some == {k for k, v in expected.items() if v[0] >= 2 and v[1] <= 20}
    assert distinctive_terms(df.limit(0)).collect() == []


def test_phrases_have_up_to_three_terms(spark, tmp_path):
    spark.createDataFrame([(1, "One two three four"), (2, "zero one two, three"), (3, "two")], "row_id long, text string").write.parquet(f"{tmp_path}/document_input.parquet")
    got = {r.phrase: (r.occurrences, r.records) for r in p6_phrases(spark, str(tmp_path)).collect()}
    assert got == {"one": (2, 2), "two": (3, 3), "three": (2, 2), "one two": (2, 2), "two three": (2, 2), "one two three": (2, 2)}
