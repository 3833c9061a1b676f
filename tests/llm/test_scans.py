import random

import pytest

from folioscan.llm.scans import CONFUSIONS, PAIRS, Page, _distance, _pointed, bare, candidates, page_marks, repaired_pages, signs_undone

LETTERS = "abcdefghilmnoprstuvw"


def lexicon(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(4, 9))) for _ in range(n)]


def test_candidates_undo_confusions():
    for true, seen in CONFUSIONS.items():
        for s in seen.split():
            assert f"x{true}y" in candidates(f"x{s}y")
    assert {"שולום", "the"} <= candidates("ש|ל1ם").keys() | candidates("tbc").keys()
    assert "the" not in candidates("tbc", two=False)
    assert "abc" not in candidates("abc")
    assert signs_undone("l1l1l1l1l1", "lililililи") is None
    assert [PAIRS[c] for c in signs_undone("l1l1", "lili")] == [("i", "1")] * 2
    assert bare("שָׁלוֹם") == "שלום" and bare("café") == "café"
    assert _pointed("שלוח", "שָׁלוֹם") == "שָׁלוֹח"


def test_distance():
    assert [_distance(a, b) for a, b in (("", "abc"), ("abc", "abc"), ("kitten", "sitting"))] == [3, 0, 3]


@pytest.mark.parametrize(
    ("line", "kind"),
    [
        ("12", "pageno"), ("[12]", "pageno"), ("- 12 -", "pageno"), ("12 / 402", "pageno"), ("p. 9", "pageno"), ("עמוד 9", "pageno"), ("דף קיא", "pageno"), ("xvi", "pageno"),
        ("The Good Book", "header"), ("12  The Good Book", "header"), ("THE GOOD BOOK   Ch. 4", "header"), ("Ch. 4 | The Good Book", "header"), ("Tbe Go0d Book", "header"),
        ("", "blank"), ("Some running text", "text"), ("The good old book", "text"), ("12 men", "text"), ("Chapter 3", "text"),
    ],
)
def test_kinds_of_lines(line, kind):
    assert Page().kinds(f"first line of the page here\n{line}\nmore text", ["The Good Book", None])[1][1] == kind


def test_one_line_has_no_header():
    for text in ("12", "The Good Book", "\nThe Good Book\n"):
        assert set(Page().kinds(text, ["The Good Book"])[1]) <= {"text", "blank"}


def noisy_page(r, words, title):
    """A page with known marks: wrapped at random, words broken and misread, a header and a page number between lines."""
    lines, marks, k = [], set(), 0
    line: list[str] = []
    plain: list[str] = []
    flip = lambda w: next((w.replace(t, s.split()[0], 1) for t, s in CONFUSIONS.items() if len(t) == 1 and t in w), w)
    for n, w in enumerate(words):
        plain.append(w)
        seen = w
        if r.random() < 0.08:
            seen = flip(w)
            if seen != w:
                marks.add((k, "misread"))
        line.append(seen)
        if len(line) == 8 and n < len(words) - 4:
            if seen == w and len(w) > 5 and r.random() < 0.4:
                line[-1] = seen[:3] + r.choice("-¬")
                marks.add((k, "hyphen"))
                rest = [seen[3:]]
            else:
                rest = []
            lines.append(" ".join(line))
            k += 1
            if r.random() < 0.2:
                lines += [str(r.randint(1, 99)), title.upper()]
                marks |= {(k, "pageno"), (k + 1, "header")}
                k += 2
            line = rest
    lines.append(" ".join(line))
    return "\n".join(lines), marks, " ".join(plain)


@pytest.fixture(scope="module")
def pages():
    r = random.Random(11)
    common = lexicon(1, 400)
    names = lexicon(2, 20_000)
    pick = lambda: r.choice(common) if r.random() < 0.93 else r.choice(names)
    clean = [(n, " ".join(pick() for _ in range(250)), False, None, "f") for n in range(200)]
    truth, rows = {}, []
    for n in range(60):
        text, marks, plain = noisy_page(r, [pick() for _ in range(120)], "Curious Title")
        rows.append((1000 + n, text, True, "Curious Title" if n % 2 else None, "f"))
        truth[1000 + n] = (marks, plain)
    return clean + rows, truth


def test_held_out_accuracy(spark, pages):
    rows, truth = pages
    extra = [(5000, None, True, None, None), (5001, "", True, "t", None), (5002, "text", None, "t", "g"), (5003, "word " * 30_000, True, None, "f")]
    df = spark.createDataFrame(rows + extra, "row_id long, text string, is_pdf boolean, title string, file_path string").selectExpr("*", "1 as word", "'x' as marks", "2 as grp")
    titles = spark.createDataFrame([("f", "Curious Title"), ("g", None)], "file_path string, title string")
    repaired = repaired_pages(df, titles).cache()
    got = {(r.row_id, r.line_no, r.kind) for r in page_marks(repaired).collect()}
    true = {(i, k, kind) for i, (marks, _) in truth.items() for k, kind in marks}
    for kind, precision, recall in (("hyphen", 1, 1), ("header", 1, 1), ("pageno", 1, 1), ("misread", 0.93, 0.85)):
        g, t = ({x for x in s if x[2] == kind} for s in (got, true))
        assert len(g & t) >= precision * len(g), kind
        assert len(g & t) >= recall * len(t), kind
    texts = {r.row_id: r.text for r in repaired.collect()}
    assert set(texts) == {*truth, 5001, 5003}
    assert texts[5001] == ""
    words = [(a, b) for i, (_, plain) in truth.items() for a, b in zip(texts[i].split(), plain.split(), strict=True)]
    assert sum(a == b for a, b in words) >= 0.985 * len(words)
    before = sum(len(marks) for marks, _ in truth.values())
    assert sum(a != b for a, b in words) < before / 8


def test_words_that_need_more(spark):
    """Two confusions, many signs in a word, points, a hyphen of the word's own, and the neighbours deciding between words."""
    known = "illicit willing shalom brother lantern keeper gallery well-known silver winter garden lamp".split()
    clean = [(n, " ".join([*known * 3, "open the lamp", "hot the damp", "ספר שלום ספר רחוק"]), False) for n in range(60)]
    rows = [(100, "a brotber lantcrn kccper here\n1ll1c1t w1ll1ng", True), (101, "silver well-\nknown and gar-\nden", True), (102, "סֵפֶר שָׁלוֹס כאן", True)]
    df = spark.createDataFrame([(i, t, p, None, None) for i, t, p in clean + rows], "row_id long, text string, is_pdf boolean, title string, file_path string")
    got = {r.row_id: (r.text, {(m.line_no, m.kind) for m in r.marks}) for r in repaired_pages(df).collect()}
    assert got[100] == ("a brother lantern keeper here illicit willing", {(0, "misread"), (1, "misread")})
    assert got[101] == ("silver well-known and garden", {(0, "hyphen"), (1, "hyphen")})
    assert got[102] == ("סֵפֶר שָׁלוֹם כאן", {(0, "misread")})


def test_without_clean_texts(spark):
    df = spark.createDataFrame([(1, "a b-\ncde", True, None, None)], "row_id long, text string, is_pdf boolean, title string, file_path string")
    assert [(r.line_no, r.kind) for r in page_marks(repaired_pages(df)).collect()] == [(0, "hyphen")]
    assert repaired_pages(df).first().text == "a bcde"
    assert repaired_pages(df.limit(0)).collect() == []
