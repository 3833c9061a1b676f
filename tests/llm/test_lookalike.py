import unicodedata

import pytest

from folioscan.llm.lookalike import Former, canonical_forms, look_alike_groups, matched_titles, prototypes

CASES = {
    "\uff28\uff41\uff54\uff45\uff4e Coin": "Haten Coin",
    "\ufb01ne": "fine",
    "\u05e1\u05e4\ufb27": "\u05e1\u05e4\u05e8",
    "\ufb2a": "\u05e9\u05c1",
    "cafe\u0301": "caf\u00e9",
    "\u05d0\u05bc\u05b0": "\u05d0\u05b0\u05bc",
    "a\u200bb\ufeff": "ab",
    "a\u00a0b\u2009c\u3000d": "a b c d",
    "N\u043et\u0435s": "Notes",
    "qu\u043erum": "quorum",
    "\u05d9\u05d0\u05d7\u05f1": "\u05d9\u05d0\u05d7\u05d5\u05d9",
    "\ufb4f": "\u05d0\u05dc",
}
CLEAN = ["", "plain text", "שָׁלוֹם", 'ר״ל א"כ וגו׳ בית־ספר', "café naïveté", "a\r\nb\tc", "word слово λόγος מילה", "In־long"]


ALIKE = ["rn m", "0 O", "I l", "1 l", "| l", "m м", "ס o", "ח п", "ı i", "ɑ a", "ꓮ A", "𝒜 A", "ｍ rn", "а a", "ѕ s", "Ν N", "cafe\u0301 caf\u00e9"]
UNLIKE = ["a b", "o O", "ב כ", "n m", "i l", "ו נ"]


@pytest.fixture(scope="module")
def f(spark):
    return Former(prototypes(spark))


@pytest.mark.parametrize("pair", ALIKE)
def test_skeletons_of_what_looks_alike(f, pair):
    a, b = pair.split()
    assert f.skeleton(a) == f.skeleton(b)
    assert f.skeleton(f"x{a}y") == f.skeleton(f"x{b}y")


@pytest.mark.parametrize("pair", UNLIKE)
def test_skeletons_of_what_does_not(f, pair):
    a, b = pair.split()
    assert f.skeleton(a) != f.skeleton(b)


@pytest.mark.parametrize(("value", "form"), CASES.items())
def test_cases(f, value, form):
    assert f.form(value) == (form, f.skeleton(form), True)
    assert f.canonical(value) == form
    assert f.canonical(form) == form
    assert f.skeleton(value) == f.skeleton(form)


@pytest.mark.parametrize("value", [unicodedata.normalize("NFC", c) for c in CLEAN])
def test_no_cases(f, value):
    assert not f.form(value)[2]
    assert f.canonical(value) == value
    assert not f.mixed_word(value)


def test_frame(spark):
    spaced = "a\u00a0b" * 40
    rows = [(1, "Notes", "x"), (2, "N\u043et\u0435s", None), (3, None, ""), (4, "Notes", spaced), (4, "Notes", spaced), (5, "No\u0436", "y")]
    df = spark.createDataFrame(rows, "row_id long, title string, text string").selectExpr("*", "'z' as form", "1 as field")
    got = {(r.row_id, r.field, r.form, r.changed) for r in canonical_forms(df).collect()}
    assert (1, "title", "Notes", False) in got
    assert (2, "title", "Notes", True) in got
    assert (3, "text", "", False) in got
    assert (4, "text", "a b" * 40, True) in got
    assert (5, "title", "No\u0436", True) in got  # a letter without a look-alike stays, but is told
    assert not any(k[:2] in {(3, "title"), (2, "text")} for k in got)
    groups = {r.row_id: (r.forms, r.rows, r.changed_rows) for r in look_alike_groups(canonical_forms(df, fields=("title",), whole=False)).collect()}
    assert groups == {1: (1, 4, 1), 5: (1, 1, 1)}
    assert canonical_forms(df.limit(0)).collect() == []
    listed = spark.createDataFrame([("Notes",), (None,), ("Notes",), ("N0tes",), ("Other",)], "title string")
    assert sorted((r.row_id, r.listed) for r in matched_titles(df, listed).collect()) == [(1, "Notes"), (2, "Notes"), (4, "Notes"), (4, "Notes")]
