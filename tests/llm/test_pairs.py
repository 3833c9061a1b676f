import random
from itertools import combinations

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from folioscan.llm.near import MAX_LEVEL, MISS, REGISTERS, ROWS, _texts, bag_signatures, band_count, band_hashes, components, linked_pairs, linked_rows, near_duplicates, near_groups, prefix_pairs
from folioscan.llm.spans import K, repeated_spans, shared_pairs, shared_shares, shared_spans, text_boundaries, window_sizes


def words(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def test_signatures_estimate_the_weighted_similarity():
    rng = np.random.default_rng(1)
    m = 4096
    for _ in range(4):
        hashes = rng.integers(0, 1 << 63, 60).astype(np.uint64)
        a, b = rng.integers(0, MAX_LEVEL + 1, 60), rng.integers(0, MAX_LEVEL + 1, 60)
        b[:40] = a[:40]
        docs = np.concatenate([np.zeros(60, np.int64), np.ones(60, np.int64)])
        levels = np.concatenate([a, b])
        keep = levels > 0
        sig = bag_signatures(docs[keep], np.concatenate([hashes, hashes])[keep], levels[keep], 2, m)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert np.isfinite(sig).all()
        assert (sig[0] == sig[1]).mean() == pytest.approx(true, abs=4 * (true * (1 - true) / m) ** 0.5 + 0.005)


def test_a_signature_does_not_depend_on_its_neighbours():
    rng = np.random.default_rng(2)
    sizes = [1, 5, 80]
    hashes = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in sizes]
    levels = [rng.integers(1, MAX_LEVEL + 1, n) for n in sizes]
    all_ = bag_signatures(np.repeat(np.arange(3), sizes), np.concatenate(hashes), np.concatenate(levels), 3, 240)
    for k in range(3):
        assert (bag_signatures(np.zeros(sizes[k], np.int64), hashes[k], levels[k], 1, 240)[0] == all_[k]).all()


def similar(texts, least=0.7, terms=20):
    sets = {i: {w.lower() for w in regex.findall(r"[\p{L}\p{M}\p{N}]+", t or "")} for i, t in texts}
    sets = {i: s for i, s in sets.items() if len(s) >= terms}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def near_rows():
    rows = []
    for k in range(120):
        base = words(60 + k, k)
        rows.append((len(rows), " ".join(base)))
        r = random.Random(-k)
        edited = [w if r.random() > 0.06 else f"e{r.randrange(9**9)}" for w in base]
        if k % 3 == 0:
            rows.append((len(rows), " ".join(edited)))
        if k % 5 == 0:
            r.shuffle(edited)
            rows.append((len(rows), "; ".join(edited).upper()))
    copies = " ".join(words(40, 999))
    rows += [(len(rows) + n, copies) for n in range(40)]
    return [*rows, (9001, None), (9002, ""), (9003, "too short"), (9004, " ".join(words(30_000, 5)))]


def test_near_duplicates_against_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "row_id long, text string").selectExpr("*", "'x' as k1", "1 as class_id").repartition(4)
    members, links = near_duplicates(df)
    expected = similar(rows)
    got = {(r.row_id_a, r.row_id_b) for r in linked_pairs(members, links).collect()}
    assert got <= expected
    assert len(got) >= 0.99 * len(expected)
    per_row = {r.row_id: r.links for r in linked_rows(members, links).collect()}
    assert {i for i, _ in rows} - per_row.keys() == {9001, 9002, 9003}
    assert sum(per_row.values()) == 2 * len(got)
    hub = linked_rows(members, links).where("links >= 39")
    assert hub.select("class_id").distinct().count() == 1


def test_near_duplicates_with_new_terms_only(spark):
    """Copies whose changed terms occur nowhere else are as rare as terms get: the exact way leaves out none down to the bound."""
    common = [f"w{k}" for k in range(250)]
    rows = []
    for k in range(60):
        r = random.Random(k)
        base = r.sample(common, 70)
        replaced = [*base[:58], *(f"n{k}x{x}" for x in range(12))]  # 58 of 82: 0.707
        inserted = [*base, *(f"m{k}x{x}" for x in range(30))]  # 70 of 100: 0.7
        under = [*base, *(f"u{k}x{x}" for x in range(31))]  # 70 of 101
        for x in (base, replaced, inserted, under, base):
            r.shuffle(x)
            rows.append((len(rows), " ".join(x)))
    df = spark.createDataFrame(rows, "row_id long, text string").repartition(4)
    got = {(r.row_id_a, r.row_id_b) for r in linked_pairs(*near_duplicates(df, exact=True)).collect()}
    assert got == similar(rows)
    assert {(5 * k, 5 * k + 2) for k in range(60)} <= got and not {(5 * k, 5 * k + 3) for k in range(60)} & got
    banded = {(r.row_id_a, r.row_id_b) for r in linked_pairs(*near_duplicates(df)).collect()}
    assert banded <= got and len(banded) >= 0.98 * len(got)


@pytest.mark.parametrize("similarity", [0.7, 0.8])
def test_bands_miss_as_rarely_as_told(similarity):
    """Bands that share registers are a little worse than independent ones; pairs above the similarity are found all the same."""
    rng = np.random.default_rng(6)
    bands = band_count(similarity)
    assert (1 - similarity**ROWS) ** bands <= MISS
    for s, least in ((similarity, 0.99), (similarity + 0.05, 1.0)):
        agree = rng.random((4000, REGISTERS)) < s
        a = np.zeros((4000, REGISTERS), np.float32)
        b = np.where(agree, a, np.float32(1))
        share = (band_hashes(a, bands) == band_hashes(b, bands)).any(axis=1).mean()
        assert share >= least


def multiset_groups(texts, least=0.8, terms=20):
    from collections import Counter

    bags = {i: Counter(w.lower() for w in regex.findall(r"[\p{L}\p{M}\p{N}]+", t or "")) for i, t in texts}
    bags = {i: b for i, b in bags.items() if len(b) >= terms}
    group = {i: i for i in bags}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in combinations(sorted(bags), 2):
        if (bags[a] & bags[b]).total() >= least * (bags[a] | bags[b]).total():
            x, y = sorted((top(a), top(b)))
            group[y] = x
    return {i: top(i) for i in bags}


def test_near_groups_against_brute_force(spark):
    """Chains of edits, a family around one text, texts that differ only in how often terms occur."""
    rows, r = near_rows(), random.Random(4)
    at = max(i for i, _ in rows) + 1
    chain = words(90, 77)
    for k in range(25):
        chain = [w if r.random() > 0.05 else f"c{k}x{n}" for n, w in enumerate(chain)]
        rows.append((at + k, " ".join(chain)))
    base = words(70, 78)
    rows += [(at + 100 + k, " ".join([*base[:66], *(f"f{k}x{n}" for n in range(4))])) for k in range(60)]
    rows += [(at + 200, " ".join(base * 3)), (at + 201, " ".join(base * 3 + ["once"]))]
    df = spark.createDataFrame(rows, "row_id long, text string").selectExpr("*", "1 as part", "'y' as id").repartition(4)
    expected = multiset_groups(rows)
    for exact in (False, True):
        got = {x.row_id: (x.group_id, x.group_rows) for x in near_groups(df, exact=exact).collect()}
        assert {i: g for i, (g, _) in got.items()} == expected
        assert all(n == sum(g == h for h in expected.values()) for g, n in got.values())


def test_components(spark):
    r = random.Random(9)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 300)] + [(500, 499), (499, 498), (7, 7)]
    links += [(r.randrange(1000, 1050), r.randrange(1000, 1050)) for _ in range(30)]
    top = {x: x for e in links for x in e}
    for _ in range(60):
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    got = [(x.id, x.group) for x in components(spark.createDataFrame(links, "a long, b long")).collect()]
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert sorted(got) == sorted((i, g) for i, g in top.items() if i in linked)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("similarity", [0.5, 0.7, 0.9])
@pytest.mark.parametrize("batch", [7, 10_000])
def test_prefix_pairs_leave_out_none(spark, similarity, batch):
    r = random.Random(5)
    rows = []
    for k in range(60):
        base = r.sample(range(90), r.randint(20, 60))
        rows += [(len(rows) + n, " ".join(f"w{w}" for w in {*base[n * 3 :], *r.sample(range(90), n)})) for n in range(4)]
    df = spark.createDataFrame(rows, "row_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        docs = _texts(df, "row_id", "text")
        got = [(x.a, x.b) for x in prefix_pairs(docs, docs.select(F.col("i").alias("id")), similarity, 20, False).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert similar(rows, similarity) <= set(got) and len(got) == len(set(got))


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, "a b c")], "row_id long, text string")
    for frame in (df, df.limit(0)):
        members, links = near_duplicates(frame)
        assert (members.count(), links.count()) == (0, 0)
        assert near_groups(frame).count() == 0


@pytest.mark.parametrize("least", [200, 60, 37])
def test_every_long_run_holds_an_edge(least):
    g, w = window_sizes(least)
    rng = np.random.default_rng(3)
    for alphabet in (2, 60):
        run = rng.integers(1, alphabet + 1, least).astype(np.uint32)
        found = []
        for seed in range(3):
            r = np.random.default_rng(seed + 10)
            before, after = (r.integers(1, alphabet + 1, n).astype(np.uint32) for n in (50 + seed, 90))
            text = np.concatenate([before, run, after])
            place, _ = text_boundaries(text, np.array([0, len(text)]), g, w)
            found.append({p - len(before) for p in place.tolist() if len(before) <= p <= len(before) + least - g})
        inside = set.intersection(*found)
        assert len(inside) > K


def common_run(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = last + 1 if x == y else 0
            best = max(best, row[j])
            last = keep
    return best


def span_rows():
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdefgh שלום\n") for _ in range(n))
    shared, edge, under = text(260), text(200), text(199)
    rows = [text(300) for _ in range(6)]
    rows += [text(50) + shared + text(90), shared[20:] + text(100), text(10) + shared[:230]]
    rows += [text(70) + edge + "1" + text(40), "2" + edge + "3" + text(10), text(40) + "4" + under + "5" + text(60), "6" + under + "7" + text(60)]
    rows += ["a" * 450, "b" + "a" * 300, "ab" * 150, text(30) + "ab" * 120]
    # the same sentences in another order: many short common runs, few long ones
    sentences = [" ".join(r.choice(["of", "the", "in", "and", "note", "page"]) for _ in range(r.randint(6, 16))) + ". " for _ in range(30)]
    for _ in range(12):
        r.shuffle(sentences)
        rows.append("".join(sentences[:14]))
    rows += [rows[0]] * 4 + [shared[:199], "", "x" * 200]
    return [(n, t) for n, t in enumerate(rows)] + [(900, None)]


def test_shared_spans_against_brute_force(spark):
    rows = span_rows()
    df = spark.createDataFrame(rows, "row_id long, text string").selectExpr("*", "concat('r', row_id) as reference", "1 as cls", "'z' as t").repartition(3)
    expected = {(i, j) for (i, a), (j, b) in combinations([x for x in rows if x[1]], 2) if common_run(a, b) >= 200}
    members, spans = shared_spans(df)
    assert {(r.row_id_a, r.row_id_b) for r in shared_pairs(members, spans).collect()} == expected
    shares = {r.row_id: r for r in shared_shares(df, *repeated_spans(df)).collect()}
    for i, t in rows:
        if t is not None:
            held = [k for k in range(len(t) - 199) if any(t[k : k + 200] in u for j, u in rows if j != i and u)]
            assert shares[i].shared_chars == len({p for k in held for p in range(k, k + 200)})
    assert len(shares) == len(rows) - 1
    assert shares[0].copies == 4 and shares[0].share == 1.0 and shares[0].reference == "r0"
    assert (shares[6].shared_chars, shares[6].copies) == (260, 0)
    assert shares[7].shared_chars == 240
    assert shares[11].shared_chars == 0
    assert any(r.chars == 0 and r.share == 0 for r in shares.values())


def test_a_formula_in_many_texts_makes_no_pairs(spark, monkeypatch):
    """A passage just too short stands in many texts: nearly none are compared; a long one stands in others, with surroundings of their own."""
    from folioscan.llm import spans as module

    r = random.Random(12)
    text = lambda n: "".join(r.choice("abcdefghijklmn ") for _ in range(n))
    formula, passage = text(180), text(230)
    rows = [(n, text(r.randint(20, 300)) + formula + text(r.randint(20, 300))) for n in range(150)]
    rows += [(1000 + n, text(r.randint(20, 300)) + passage + text(r.randint(20, 300))) for n in range(12)]
    compared = spark.sparkContext.accumulator(0)
    extent = module._extent
    monkeypatch.setattr(module, "_extent", lambda *x: (compared.add(1), extent(*x))[1])
    pairs = {(x.row_id_a, x.row_id_b) for x in shared_pairs(*shared_spans(spark.createDataFrame(rows, "row_id long, text string"))).collect()}
    assert pairs == set(combinations(range(1000, 1012), 2))
    assert 60 <= compared.value < 1000


def test_shared_spans_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, "short")], "row_id long, text string")
    for members, spans in (shared_spans(df), repeated_spans(df)):
        assert (members.count(), spans.count()) == (0, 0)
