import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf.functions import chunks, geometry, grids, identifiers, latex, references, text
from sheaf.functions.metadata import leading_metadata, leading_title, title_with_fallbacks

PROPERTY = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def values(spark, function, cases, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", function("x").alias("y")).orderBy("i").select("y").collect()]


def test_identifiers(spark):
    cases = {
        identifiers.is_arxiv: [("2301.00001", 1), ("2301.00001v2", 1), ("arxiv:2301.00001", 1), ("arXiv:2301.00001v2", 1), ("hep-th/9901001", 1), ("not-an-arxiv-id", 0), ("10.1234/example", 0), ("", 0), (None, 0)],
        identifiers.is_doi: [("10.1234/example", 1), ("10.1257/aer.20180779", 1), ("doi:10.1234/example", 1), ("https://doi.org/10.1234/example", 1), ("https://dx.doi.org/10.1234/example", 1), ("not-a-doi", 0), ("2301.00001", 0), ("", 0)],
        identifiers.is_ssrn: [("1234567", 1), ("ssrn:1234567", 1), ("SSRN-id1234567", 1), ("12345678", 1), ("123", 0), ("not-ssrn", 0), ("", 0)],
        identifiers.is_nber: [("w29000", 1), ("W29000", 1), ("29000", 1), ("nber:w29000", 1), ("nber:29000", 1), ("12345", 1), ("not-nber", 0), ("", 0)],
        identifiers.is_url: [("https://example.com/paper.pdf", 1), ("http://example.com/paper.pdf", 1), ("ftp://example.com/paper.pdf", 0), ("example.com/paper.pdf", 0), ("", 0)],
    }
    for function, pairs in cases.items():
        assert values(spark, function, [p[0] for p in pairs]) == [bool(p[1]) for p in pairs], function
    got = values(spark, identifiers.normalised, ["arXiv:2301.00001v2", "doi:10.1234/example", "https://doi.org/10.1234/example", "SSRN-id1234567", "nber:w29000", "x"])
    assert got == ["2301.00001v2", "10.1234/example", "10.1234/example", "1234567", "29000", "x"]


def test_file_names(spark):
    cases = [("../../../etc/passwd", "passwd"), ("..\\..\\windows\\system32", "system32"), ("%2e%2e%2fetc%2fpasswd", "passwd"), ("...hidden", "hidden"), ("..file.pdf", "file.pdf"), ('file<>:"|?*.pdf', "file_______.pdf"), ("", "download"), ("..", "download"), (".", "download"), ("paper.pdf", "paper.pdf"), (None, "download"), ("100%", "100%")]
    assert values(spark, identifiers.safe_filename, [c[0] for c in cases]) == [c[1] for c in cases]
    (long,) = values(spark, identifiers.safe_filename, ["a" * 300 + ".pdf"])
    assert len(long) == 255 and long.endswith(".pdf")
    assert values(spark, identifiers.slug, ["Hello World!", "Test-Paper (2020)"]) == ["hello_world", "test_paper_2020"]
    assert values(spark, identifiers.filename_from_url, ["https://example.com/my-paper.pdf", "https://example.com/download/12345"]) == ["my-paper.pdf", "example_com_download_12345.pdf"]


def test_latex(spark):
    assert values(spark, latex.escape, [None, "a_b & 50%", "\\"]) == ["", "a\\_b \\& 50\\%", "\\textbackslash\\{\\}"]
    assert values(spark, latex.from_markdown, ["**b** and *i* 5%", "**open"]) == ["\\textbf{b} and \\textit{i} 5\\%", "**open"]
    assert values(spark, latex.keep_math, ["$a & b$ & c", "from $5 & to $10", "$$x & y$$ #1", "$", None]) == ["$a & b$ \\& c", "from \\$5 & to \\$10", "$$x & y$$ \\#1", "$", ""]


@PROPERTY
@given(st.lists(st.text(alphabet="ab$&%# 1\n\\", max_size=30), min_size=5, max_size=40))
def test_keep_math_as_modelled(spark, cases):
    def model(t):
        parts = re.split(r"(\$\$[^$]+\$\$|\$[^$]+\$)", re.sub(r"\$(\d)", r"\\$\1", t))
        keep = lambda p: p.startswith("$") and p.endswith("$") and len(p) > 2
        return "".join(p if keep(p) else p.replace("&", "\\&").replace("%", "\\%").replace("#", "\\#") for p in parts)

    assert values(spark, latex.keep_math, cases) == [model(t) for t in cases]


@PROPERTY
@given(st.lists(st.text(alphabet="ab :é😀", max_size=130), min_size=5, max_size=40))
def test_truncations_as_modelled(spark, cases):
    def words(t, n):
        if len(t) <= n:
            return t
        cut = t[:n]
        at = cut.rfind(" ")
        return (cut[:at] if at > n // 2 else cut).rstrip() + "..."

    def short(t):
        base = t.split(":")[0].strip() if ":" in t else t
        return base[:50].rsplit(" ", 1)[0] + "..." if len(base) > 50 else base

    assert values(spark, lambda c: text.truncate_words(c, 50), cases) == [words(t, 50) for t in cases]
    assert values(spark, text.short_title, cases) == [short(t) for t in cases]
    assert values(spark, lambda c: text.head_and_tail(c, 100, between="|"), cases) == [t[:70] + "|" + t[-30:] if len(t) > 100 else t for t in cases]


def test_unreadable(spark):
    assert values(spark, text.is_unreadable, [None, "", "short", "/G31" * 40, "x" * 100, "\x00" * 20 + "x" * 100, "x" * 1000 + "/G31" * 400]) == [True, True, True, True, False, True, False]


def test_years_and_numbers(spark):
    assert values(spark, text.year_in, ["in 1997.", "1979 and 2030", "x2001", None]) == ["1997", None, None, None]
    assert values(spark, text.first_number, ["Table 12b", "Figure", "9" * 30, None]) == [12, None, None, None]


def test_front_matter(spark):
    cases = [
        "## Minimum Wages and Employment Effects\nDavid Card and Alan Krueger\nJanuary 1997\nbody",
        "Does Class Size Matter for Student Achievement Joshua Angrist and Victor Lavy and NBER Working Paper No. 5888 January 1997",
        "", None,
        "x" * 40 + " NBER " + "y" * 60 + " 1999\n## Heading That Is Long Enough Here\nnobody\n",
    ]
    got = values(spark, leading_metadata, cases)
    assert [(r["title"], r["authors"], r["year"]) for r in got] == [
        ("Minimum Wages and Employment Effects", "David Card and Alan Krueger", "1997"),
        ("Does Class Size Matter for Student Achievement", "Joshua Angrist and Victor Lavy", "1997"),
        (None, None, None), (None, None, None),
        ("Heading That Is Long Enough Here", None, "1999"),
    ]
    assert values(spark, leading_title, ["We study wages in a long line of papers and more", "# H1 never counts\nx"]) == [None, None]
    assert values(spark, lambda c: title_with_fallbacks(c, F.lit("JEL codes")), ["tiny", "# A heading to fall back on"]) == ["Untitled Paper", "A heading to fall back on"]


def test_references(spark):
    got = values(spark, references.parsed, ["Smith, J., Smith, J. and Jones, K. (2020). A paper about testing. Journal of Tests, 1, 1-10. doi: 10.1234/example.5678"])[0]
    assert (got["year"], got["title"], got["journal"], got["pages"], got["doi"], got["authors"]) == (2020, "A paper about testing", "Journal of Tests", "1-10", "10.1234/example.5678", ["Smith, J.", "Jones, K."])
    assert "Smith, J. (2020)" in values(spark, references.references_section, ["Intro\n\n  References\n\nSmith, J. (2020). One.\n"])[0]
    assert values(spark, references.references_section, ["x\nBibliography\ny", "none", None]) == ["y", None, None]
    rows = [(["van der Berg, Jan"], 2020, "Some Paper Title"), (None, 2020, None), (["Smith, John"], 2020, "The Theory of Everything"), (["John Smith"], 2021, "Machine Learning"), (["Smith-Jones, Mary"], 2022, "Testing Names")]
    df = spark.createDataFrame(rows, "a array<string>, y int, t string")
    assert [r[0] for r in df.select(references.citation_key(F.col("a"), F.col("y"), F.col("t"))).collect()] == ["vanderberg2020some", "unknown2020", "smith2020theory", "smith2021machine", "smithjones2022testing"]
    entry = df.limit(1).select(references.bibtex(F.col("a"), F.col("y"), F.lit("100% of\nit & more"), F.lit("J"), F.lit(None), F.lit(None))).first()[0]
    assert entry.startswith("@article{vanderberg2020it") and "title = {100\\% of it \\& more}" in entry and "doi" not in entry


def test_grids(spark):
    rows = [(0, [["Name", "Value"], ["Alice", None], ['a,"b"', "2"]]), (1, []), (2, None), (3, [["A", "A"], ["1", "2"]])]
    df = spark.createDataFrame(rows, "i int, g array<array<string>>")
    got = {r["i"]: r for r in df.select("i", grids.csv("g").alias("csv"), grids.row_count("g").alias("n"), grids.column_count("g").alias("m"), grids.row_maps("g").alias("maps"), grids.header("g").alias("h")).collect()}
    assert got[0]["csv"] == 'Name,Value\nAlice,\n"a,""b""",2' and (got[0]["n"], got[0]["m"]) == (3, 2)
    assert got[0]["maps"] == [{"Name": "Alice", "Value": None}, {"Name": 'a,"b"', "Value": "2"}]
    assert (got[1]["n"], got[1]["m"], got[1]["h"], got[1]["maps"]) == (0, 0, [], [])
    assert got[2]["n"] == 0 and got[3]["maps"] == [{"A": "2"}]


def test_geometry(spark):
    assert values(spark, geometry.is_math_font, ["CMEX10", "Symbol", "Cambria Math", "CMSY10", "Times-Roman", "Arial", "Helvetica", "", None]) == [True] * 4 + [False] * 5
    assert values(spark, geometry.has_math_symbols, ["∑∫∂", "x ∈ ℝ", "α + β = γ", "hello world", "", "x", None]) == [True] * 3 + [False] * 4
    df = spark.createDataFrame([(200.0, 412.0), (72.0, 200.0), (50.0, 562.0)], "a double, b double")
    assert [r[0] for r in df.select(geometry.is_display(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_chunk_arguments():
    for size, overlap in ((0, 0), (-5, 0), (100, 100), (100, 200), (10, -1)):
        with pytest.raises(ValueError):
            chunks.check(size, overlap)


@PROPERTY
@given(st.lists(st.text(alphabet="ab. é😀\n", max_size=400), min_size=3, max_size=20), st.integers(5, 60), st.integers(0, 4))
def test_chunks_cover_and_overlap(spark, cases, size, overlap):
    for t, got in zip(cases, values(spark, lambda c: chunks.chunks(c, size, overlap), cases)):
        parts = [g["chunk"] for g in got]
        assert "".join(p if not i else p[overlap:] for i, p in enumerate(parts)) == t
        assert all(len(p) <= size for p in parts) and all(a[-overlap:] == b[:overlap] for a, b in zip(parts, parts[1:]) if overlap)
    for t, parts in zip(cases, values(spark, lambda c: chunks.sentence_chunks(c, size + 10, overlap), cases)):
        assert "".join(p if not i else p[overlap:] for i, p in enumerate(parts)) == t
        assert all(len(p) <= size + 10 for p in parts)


def test_break_point(spark):
    t = "A" * 80 + " This is a sentence. " + "B" * 20
    (at,) = values(spark, chunks.break_point, [t])
    assert t[:at].endswith(". ")
    assert values(spark, chunks.break_point, ["no end", "", None]) == [6, 0, None]


def test_pages(spark):
    df = spark.createDataFrame([([0, 1, 2, 100, -1],)], "p array<int>")
    got = df.select(chunks.valid_pages("p", 3).alias("v")).first()["v"]
    assert got["valid"] == [0, 1, 2] and got["invalid"] == [100, -1]
    assert values(spark, chunks.page_range, ["1-3,7", "2", "1-", "abc", "0", "", "3-1", None]) == [[0, 1, 2, 6], [1], None, None, None, None, None, None]


def test_small_ones(spark):
    assert values(spark, lambda c: text.document_title(F.lit(None).cast("string"), c), ["## A title\nbody", "no heading", None]) == ["A title", None, None]
    assert values(spark, lambda c: text.book_title(c, F.lit("stem")), ["  First line \nmore", "\nx", None]) == ["First line", "stem", "stem"]
    assert values(spark, lambda c: text.template_truncate(c, 10), ["short", "exactly 15 char", "this is a longer text", None]) == ["short", "exactly 15 char", "this...", None]
    assert values(spark, text.without_line_numbers, ["12 line one\n 13  line two\nline 3"]) == ["line one\nline two\nline 3"]
    assert values(spark, text.words_per_minute, ["word " * 251, "", None])[:2] == [2, 0]
    df = spark.createDataFrame([("smith2020a", 1), ("smith2020a", 2), ("smith2020a", 3)], "k string, n int")
    assert [r[0] for r in df.select(references.numbered_keys(F.col("k"), F.col("n"))).collect()] == ["smith2020a", "smith2020ab", "smith2020ac"]
    row = spark.createDataFrame([(1, 2, "display", bytearray(b"png"), None, None)], "id int, page int, kind string, image binary, latex string, context string")
    plain, whole = row.select(*(geometry.equation_json(F.col("id"), F.col("page"), F.col("kind"), F.struct(F.lit(1.0).alias("x0")), F.col("image"), F.col("latex"), F.col("context"), w) for w in (False, True))).first()
    assert "latex" not in plain and "base64" not in plain and '"type":"display"' in plain and '"image_base64":"cG5n"' in whole
    assert values(spark, lambda c: identifiers.chapter_filename(F.lit(3), c), ["Ramping: A/B Trading Off of a Very Long Title Indeed"]) == ["03_ramping__a_b_trading_off_of_a_very_long_.txt"]
    assert values(spark, lambda c: grids.as_json(F.lit(5), c), [[["A", "B"], ["1", None]]], "array<array<string>>")[0].startswith('{"page":5,"rows":2,"cols":2')
