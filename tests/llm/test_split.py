import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscan.llm.split import KINDS, bisect_text, cut_kinds, split_oversized

SCHEMA = "row_id long, text string, segment long, start string, piece string"


def joined(text, limit, overlap):
    pieces = bisect_text(text, limit, overlap)
    assert "".join(text[a:b] for a, b, _, _ in pieces) == text
    for n, (a, b, back, _) in enumerate(pieces):
        assert 0 < b - a and b - a + back <= limit
        assert back == (0 if n == 0 else min(overlap, limit - (b - a), a))
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab,. \n\rאְ ", max_size=300), st.integers(2, 60), st.data())
def test_pieces_fit_and_make_the_text(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    pieces = joined(text, limit, overlap) if text else []
    longest = max((len(run) for run in text.split()), default=0)
    assert any(KINDS[rank] == "forced" for _, _, _, rank in pieces if rank >= 0) == (longest > limit)


def test_the_strongest_boundary_near_the_middle():
    text = "a" * 20 + ". " + "b" * 20 + "\n\n" + "c" * 20 + " " + "d" * 20
    (a, b, _, rank), *rest = bisect_text(text, 60, 0)
    assert (a, b, KINDS[rank]) == (0, 44, "paragraph")
    assert len(rest) == 1


def test_a_forced_cut_keeps_letter_and_mark_together():
    text = "אּ" * 40
    assert all(text[b - 1] != "א" for _, b, _, _ in joined(text, 30, 5))


def test_frame(spark):
    long = "word " * 900
    run = "x" * 3001
    rows = [(1, long, 7, "a", "b"), (2, "short", 0, None, None), (3, None, 1, None, None), (4, run, None, None, None), (5, "", 0, None, None), (6, "y" * 3000 + " z", 0, None, None), (1, long, 7, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    pieces = split_oversized(df)
    got = sorted((r.row_id, r.piece, r.segment, r.overlap, r.text) for r in pieces.collect())
    assert {g[0] for g in got} == {1, 4, 6}
    assert all(len(g[4]) <= 3000 for g in got)
    one = [g for g in got if g[0] == 1]
    assert [g[2] - g[1] for g in one] == [7] * len(one)
    assert len(one) == 4 and one[2][3] == 200  # two pieces, twice, as the row is there twice
    assert one[2][4][:200] == one[0][4][-200:]
    assert {(r.row_id, r.cut) for r in cut_kinds(pieces).collect()} == {(1, "boundary"), (4, "forced"), (6, "boundary")}
    assert split_oversized(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="overlap"):
        split_oversized(df, limit=10, overlap=10)


def test_very_long(spark):
    random.seed(1)
    text = "".join(random.choice(["ab", " ", ".\n", "\n\n"]) for _ in range(400_000))
    joined(text, 3000, 200)
