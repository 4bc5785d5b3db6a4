import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.llm import pieces
from sheaf.llm.queries import QUERIES, SQL
from tests.oracle import rows_of_spark, rows_of_sql


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word ", "longerword ", "end. ", "\n", "\n\n", "\r\n", "# Title\n", "x" * 90, "é😀 ", "\f", "\t"]), max_size=120).map("".join), st.integers(40, 200), st.integers(0, 30))
def test_pieces_hold_the_text(text, limit, overlap):
    found = pieces.cuts(text, limit, overlap)
    assert "".join(text[a:b] for a, b, _ in found) == text
    for n, (start, end, kind) in enumerate(found):
        assert end > start and end - max(0, start - (overlap if n else 0)) <= limit
        assert (kind == "end") == (n == len(found) - 1)
        # A hard cut has no blank to cut at within reach.
        if kind == "hard":
            first = start + (1 if n else max(1, overlap))
            assert not re.search(r"[ \t\n\r\f]", text[first : end - 1]) or text[end - 1 : end + 1] == "\r\n"


def test_edits_stay_local():
    text = "\n\n".join(f"Paragraph {i} says that {i * 7919 % 1000} things happened. " * 6 for i in range(200))
    edited = text[:9000] + "One more sentence. " + text[9000:]
    a, b = ({t[s:e] for s, e, _ in pieces.cuts(t)} for t in (text, edited))
    assert len(a - b) <= 4 and len(a) > 10


def test_limits():
    assert pieces.cuts(None) == [] and pieces.cuts("") == []
    assert pieces.cuts("x" * 6000) == [(0, 6000, "end")]
    assert [k for *_, k in pieces.cuts("x" * 6001)] == ["hard", "end"]
    for limit, overlap in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            pieces.cuts("x", limit, overlap)


def test_in_spark(spark):
    rows = [(1, None), (2, ""), (3, "short"), (4, "word " * 3000), (5, "😀" * 6000 + " x"), (6, "a" * 6001), (6, "a" * 6001), (7, ("b" * 5900 + " ") * 3)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "result_id bigint, markdown string, cut string")
    assert sorted(tuple(r) for r in pieces.oversized(df).collect()) == [(4, "natural"), (5, "natural"), (6, "hard"), (6, "hard"), (7, "natural")]
    parts = pieces.split(df.where("result_id in (3, 4, 5)")).orderBy("result_id", "piece_no").collect()
    for i, text in ((3, "short"), (4, "word " * 3000), (5, "😀" * 6000 + " x")):
        own = [p for p in parts if p["result_id"] == i]
        assert "".join(p["piece"] if n == 0 else p["piece"][300:] for n, p in enumerate(own)) == text
        assert all(b["piece"][:300] == a["piece"][-300:] and len(b["piece"]) <= 6000 for a, b in zip(own, own[1:]))
    assert pieces.oversized(df.limit(0)).count() == 0


def test_same_rows_as_sql(spark, folder):
    assert rows_of_spark(QUERIES["p4_found"](spark, folder)) == rows_of_sql(SQL["p4_found"], folder)
