import json

import pytest

from sheaf.operators import models, prompts
from sheaf.pipeline import Pipeline
from sheaf.sources import documents, sinks
from sheaf.streaming import ingest as streaming

BODY = "We measure wages in two regions and find that the effect on employment is small but robust. " * 3


@pytest.fixture
def shelf(tmp_path):
    folder = tmp_path / "papers"
    folder.mkdir()
    (folder / "one.txt").write_text("## Minimum Wages and Employment Effects\nDavid Card\n1997\n" + BODY, encoding="utf-8")
    (folder / "two.txt").write_text("# Two\n" + BODY + "\f" + BODY, encoding="utf-8")
    (folder / "glyphs.txt").write_text("/G31/G25" * 80, encoding="utf-8")
    (folder / "broken.txt").write_bytes(b"\xff\xfe\x00bad\xc3")
    (folder / "other.md").write_text("not taken", encoding="utf-8")
    return folder


DECODERS = [("missing", lambda content: (_ for _ in ()).throw(ImportError("no library"))), ("text", documents.text_decoder)]


def test_ingest(spark, shelf):
    rows = {r["id"]: r for r in documents.ingest(documents.files(spark, str(shelf), "*.txt"), DECODERS).collect()}
    assert {k: r["status"] for k, r in rows.items()} == {"one": "ingested", "two": "ingested", "glyphs": "ingested", "broken": "failed"}
    assert rows["two"]["title"] == "Two" and rows["two"]["page_count"] == 2 and rows["broken"]["markdown"] is None and "no library" in rows["broken"]["error"]
    ingested = documents.ingest(documents.files(spark, str(shelf), "*.txt"), DECODERS)
    assert sorted(r["id"] for r in documents.readable(ingested).collect()) == ["one", "two"]
    assert [r["id"] for r in documents.unreadable(ingested).collect()] == ["glyphs"]
    books = documents.books(documents.files(spark, str(shelf), "*.txt"), DECODERS)
    assert documents.pages(books.where("book_id = 'two'")).count() == 2
    assert {r["book_id"] for r in books.where("error is not null").collect()} == {"broken"}


def test_folders(tmp_path):
    with pytest.raises(FileNotFoundError):
        documents.check_folder(str(tmp_path / "none"))
    (tmp_path / "file").write_text("x")
    with pytest.raises(NotADirectoryError):
        documents.check_folder(str(tmp_path / "file"))


def test_outlines(spark, shelf):
    decoder = ("outlined", lambda content: documents.Decoded("x" * 200, outline=[(0, "One", 1), (1, "in", None)], pages=["first", "", "third"]))
    books = documents.books(documents.files(spark, str(shelf), "*.txt"), [decoder])
    assert [tuple(r) for r in documents.pages(books.where("book_id = 'one'")).orderBy("page_no").collect()] == [("one", 1, "first"), ("one", 2, ""), ("one", 3, "third")]
    found = documents.outlines(books)
    assert {(r["position"], r["title"], r["page_no"]) for r in found.where("book_id = 'one'").collect()} == {(0, "One", 1), (1, "in", None)}


def test_extractions_in_both_forms(spark, tmp_path):
    papers = [{"paper_id": "p1", "title": "T"}, {"paper_id": "p2", "title": "U"}]
    for name, value in (("list", papers), ("object", {"executive_summary": None, "categories": [], "papers": papers})):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(value))
        assert sorted(r["paper_id"] for r in documents.read_extractions(spark, str(path)).collect()) == ["p1", "p2"]
    with pytest.raises(FileNotFoundError):
        documents.read_extractions(spark, str(tmp_path / "none.json"))


def test_schema_files(tmp_path):
    path = tmp_path / "columns.yaml"
    path.write_text("columns:\n  - key: n\n    description: \"size\"\n    type: integer\n  - key: m\n    description: method\n")
    assert [c["key"] for c in documents.read_schema_spec(str(path))] == ["n", "m"]
    assert documents._flat_yaml(path.read_text())[0] == {"key": "n", "description": "size", "type": "integer"}
    path.write_text("columns: []\n")
    with pytest.raises(ValueError):
        documents.read_schema_spec(str(path))


def test_parts(spark):
    inventory = spark.createDataFrame([("a",), ("b",)], "id string")
    markdown = spark.createDataFrame([("a", "text")], "id string, markdown string")
    tables = spark.createDataFrame([], "id string, tables array<struct<page:int>>")
    figures = spark.createDataFrame([("a", [(1,)])], "id string, figures array<struct<page:int>>")
    assert [(r["id"], r["tables"], len(r["figures"])) for r in documents.with_parts(inventory, markdown, tables, figures).collect()] == [("a", [], 1)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 'q"x, y', None), ("b", "", "line\nbreak")], "id string, t string, u string")
    sinks.write_csv(df, str(tmp_path / "csv"), one_file=True)
    (part,) = (tmp_path / "csv").glob("part-*")
    assert part.read_bytes() == b'id,t,u\r\na,"q""x, y",\r\nb,,"line\r\nbreak"\r\n'
    sinks.write_table(df, str(tmp_path / "table"))
    sinks.write_table(spark.read.parquet(str(tmp_path / "table")), str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
    sinks.write_text_files(df, str(tmp_path / "texts"), "id", "u")
    assert (tmp_path / "texts" / "b").read_text() == "line\nbreak"
    sinks.write_document(str(tmp_path / "d" / "x.json"), {"é": 1})
    assert json.loads((tmp_path / "d" / "x.json").read_text(encoding="utf-8")) == {"é": 1}
    sinks.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert sinks.compile_latex(str(tmp_path / "none.tex")) is None


class Scripted:
    def complete(self, prompt, temperature):
        if "plan its extraction" in prompt:
            return '{"title": "Planned", "authors": "Somebody", "has_core_model": "true", "sections_to_extract": ["results"]}'
        if "sections of a literature review" in prompt:
            return '```json\n{"context": "c & d", "results": "r", "key_equations": "$x$", "notation": "x", "extracted_fields": {"n": 5},}\n```'
        return "columns:\n  - key: n"


def test_pipeline(spark, shelf, tmp_path):
    steps = Pipeline(spark, str(tmp_path / "work"), DECODERS, Scripted)
    assert tuple(steps.ingest(str(shelf), "*.txt").first()) == (3, 1)
    assert steps.configure(seed=1).startswith("columns:")
    papers = {r["paper_id"]: r for r in steps.extract(prompts.SchemaSpec.of([{"key": "n", "type": "integer"}])).collect()}
    assert set(papers) == {"one", "two", "glyphs"} and papers["glyphs"]["error"] and papers["one"]["error"] is None
    assert (papers["one"]["title"], papers["one"]["authors"], papers["one"]["year"], papers["one"]["data"]) == ("Minimum Wages and Employment Effects", "David Card", "1997", {"n": "5"})
    assert papers["two"]["key_equations"] == "$x$" and papers["two"]["authors"] == "Somebody"
    assert sorted(r["n"] for r in steps.report().collect()) == ["5", "5"]
    review = (tmp_path / "work" / "review.tex").read_text()
    assert "c \\& d" in review and review.startswith("\\documentclass") and review.endswith("\\end{document}\n")
    assert steps.report(condensed=True).count() == 3
    appendix = (tmp_path / "work" / "appendix.tex").read_text()
    assert appendix.count("\\textbf{David Card} (1997) says") == 1 and appendix.count("\\rowcolor{categoryblue}") == 1 and "3 papers" in appendix and appendix.endswith("\\end{longtable}\n\n\\end{document}\n")
    # Again: nothing is lost.
    assert tuple(steps.ingest(str(shelf), "*.txt").first()) == (3, 1)


def test_books(spark, tmp_path):
    pages = spark.createDataFrame([("b", 1, "1\nFirst Things\nalpha"), ("b", 2, "more"), ("b", 3, "2\nSecond Things\nbeta")], "book_id string, page_no int, text string")
    steps = Pipeline(spark, str(tmp_path / "work"), DECODERS, models.EchoClient)
    assert steps.book_index(pages).count() == 2
    assert sorted(r["filename"] for r in steps.book_extract().collect()) == ["01_first_things.txt", "02_second_things.txt"]
    assert steps.book_summarize().count() == 2
    body = steps.book_report().first()["body"]
    assert body.index("First Things") < body.index("Second Things")


def pdf(pages):
    """A small PDF of text pages, for a stand-in of a PDF library that reads the pages' text."""
    return b"%PDF-1.4\n" + b"\n".join(b"BT (" + p.encode() + b") Tj ET" for p in pages) + b"\n%%EOF"


def pdf_decoder(content):
    import re

    if not content.startswith(b"%PDF"):
        raise ValueError("no PDF")
    found = [p.decode() for p in re.findall(rb"BT \((.*?)\) Tj ET", content, re.S)]
    outline = [(0, "Alpha", 2), (1, "inside", 2), (0, "Omega", 4)] if b"Alpha" in content else []
    return documents.Decoded(documents.joined_pages(found), page_count=len(found), outline=outline, pages=found)


def test_books_from_files(spark, tmp_path):
    shelf = tmp_path / "books"
    shelf.mkdir()
    (shelf / "outlined.pdf").write_bytes(pdf(["A Title & More", "Alpha text", "", "Omega text"]))
    (shelf / "headed.pdf").write_bytes(pdf(["1\nFirst Things\n" + "a" * 120_000, "more", "2\nSecond Things\nb"]))
    (shelf / "broken.pdf").write_bytes(b"nothing")
    sent = tmp_path / "sent"

    class Told:
        def complete(self, prompt, temperature):
            with sent.open("a") as out:
                out.write(f"{len(prompt)}\n")
            if "Second Things" in prompt and prompt.startswith("Summarise"):
                raise RuntimeError("too long")
            return '{"main_thesis": "said", "key_terms": [1, null, "k"]}'

    steps = Pipeline(spark, str(tmp_path / "work"), [("pdf", pdf_decoder)], Told)
    found = {(r["book_id"], r["title"], r["start_page"], r["end_page"]) for r in steps.book_read(str(shelf)).collect()}
    assert found == {("outlined", "Alpha", 2, 3), ("outlined", "Omega", 4, 4), ("headed", "First Things", 1, 2), ("headed", "Second Things", 3, 3)}
    steps.book_extract()
    assert (tmp_path / "work" / "chapter_files" / "outlined" / "01_alpha.txt").read_text() == "Alpha text\n\n"
    rows = {(r["book_id"], r["number"]): r for r in steps.book_summarize().collect()}
    assert rows["headed", 2]["error"] == "too long" and rows["headed", 2]["answer"] is None and rows["headed", 1]["error"] is None
    assert "Ch 1: said\n    Key terms: 1, k" in rows["outlined", 2]["context"]
    # One call a chapter and one a book; a long chapter's prompt holds its beginning and end alone.
    lengths = [int(n) for n in sent.read_text().split()]
    assert len(lengths) == 6 and 100_000 < max(lengths) < 101_000
    reports = {r["book_id"]: r["document"] for r in steps.book_report().collect()}
    assert reports["outlined"] == (tmp_path / "work" / "book_documents" / "outlined.tex").read_text()
    assert "\\title{A Title \\& More}" in reports["outlined"] and reports["outlined"].index("Contents") < reports["outlined"].index("\\section{Alpha}") < reports["outlined"].index("\\section{Omega}")
    with pytest.raises(ValueError):
        Pipeline(spark, str(tmp_path / "none"), [("pdf", pdf_decoder)], Told).book_read(str(shelf / "broken.pdf"))


def test_an_inventory_that_cannot_be_read_is_kept(spark, shelf, tmp_path):
    work = tmp_path / "work"
    steps = Pipeline(spark, str(work), DECODERS, Scripted)
    steps.ingest(str(shelf), "*.txt")
    kept = sorted(p.name for p in (work / "inventory").glob("part-*"))
    for part in (work / "inventory").glob("part-*"):
        part.write_bytes(b"damaged")
    for crc in (work / "inventory").glob(".part-*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="(?i)parquet|footer|CANNOT_READ"):
        steps.ingest(str(shelf), "*.txt")
    with pytest.raises(Exception, match="(?i)parquet|footer|CANNOT_READ"):
        streaming.start(streaming.arriving_files(spark, str(shelf), "*.txt"), DECODERS, str(tmp_path / "corpus"), str(work / "inventory"), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(p.name for p in (work / "inventory").glob("part-*")) == kept


def test_tables_are_swapped_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.read_table(spark, path, "a int").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sinks.read_table(spark, path)
    sinks.write_table(spark.range(3), path)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        sinks.write_table(spark.range(5).selectExpr("1 div (id - 4) AS id"), path)
    assert sinks.read_table(spark, path).count() == 3
    # A swap that was broken off between its two moves.
    (tmp_path / "t").rename(tmp_path / "t.old")
    assert sinks.read_table(spark, path, "a int").count() == 3
    sinks.write_binary_files(spark.createDataFrame([("x/a.png", bytearray(b"\x89")), ("b.png", None)], "name string, content binary"), str(tmp_path / "images"), "name", "content")
    assert (tmp_path / "images" / "x" / "a.png").read_bytes() == b"\x89" and not (tmp_path / "images" / "b.png").exists()


def test_malformed_elements_are_left_out(spark, shelf):
    tables = [{"page": 1, "data": [{"k": 1, "n": None}]}, {"page": "x"}, {"data": ["no row"]}, None, {"page": 2, "data": None, "caption": "c"}]
    decoder = ("layout", lambda content: documents.Decoded("# A title\n" + "x" * 200, tables=tables, figures=[{"page": 1, "image_path": None}, 3, {"page": 4, "image_path": "f.png"}]))
    row = documents.ingest(documents.files(spark, str(shelf), "one.txt"), [decoder]).first()
    assert row["status"] == "ingested" and row["title"] == "A title"
    assert [(t["page"], t["data"], t["caption"]) for t in row["tables"]] == [(1, [{"k": "1", "n": None}], None), (2, [], "c")]
    assert [(f["page"], f["image_path"]) for f in row["figures"]] == [(1, ""), (4, "f.png")]


def test_stream(spark, shelf, tmp_path):
    places = [str(tmp_path / n) for n in ("corpus", "inventory", "checkpoint")]

    def run():
        streaming.start(streaming.arriving_files(spark, str(shelf), "*.txt"), DECODERS, *places).awaitTermination()

    run()
    assert spark.read.parquet(places[1]).count() == 4
    (shelf / "three.txt").write_text(BODY, encoding="utf-8")
    run()
    assert spark.read.parquet(places[0]).count() == 5 and {r["status"] for r in spark.read.parquet(places[1]).collect()} == {"ingested", "failed"}


class Synthesising(Scripted):
    def complete(self, prompt, temperature):
        if prompt.startswith("Write an executive summary for 3 papers"):
            assert prompt.index("[Unreadable PDF]") < prompt.index("Minimum Wages") < prompt.index("Planned")
            return "**All** of it. Key themes: (1) a & b"
        if prompt.startswith("Categorize these 3 papers"):
            return '{"categories": [{"name": "B"}, {"name": "A"}], "assignments": [{"paper_id": "one", "category": "A", "paper_order": 1}, {"paper_id": "two", "category": "B", "paper_order": "1"},]}'
        if prompt.startswith("Synthesize these chapter summaries"):
            assert "CHAPTERS: 2" in prompt and prompt.index("Chapter 1: first") < prompt.index("Chapter 2: first")
            return '{"book_thesis": "thesis & all", "key_themes": ["one", "two_b"], "intellectual_journey": "journey", "one_paragraph_summary": "summary"}'
        if prompt.startswith("Summarise this chapter"):
            return '{"main_thesis": "first", "unique_insight": "u", "key_terms": ["k"]}'
        return super().complete(prompt, temperature)


def test_whole_corpus_steps(spark, shelf, tmp_path):
    steps = Pipeline(spark, str(tmp_path / "work"), DECODERS, Synthesising)
    steps.ingest(str(shelf), "*.txt")
    steps.extract(prompts.SchemaSpec.of([{"key": "n", "type": "integer"}]))
    assert [(r["paper_id"], r["category"], r["category_order"], r["paper_order"]) for r in steps.categorised().collect()] == [("two", "B", 1, 1), ("one", "A", 2, 1), ("glyphs", "Uncategorized", 99, 99)]
    steps.report()
    tex = (tmp_path / "work" / "review.tex").read_text()
    assert tex.index("\\section*{Executive Summary}") < tex.index("\\textbf{All} of it. Key themes: (1) a \\& b") < tex.index("\\section{Planned}") < tex.index("\\section{Minimum Wages")
    # One paper alone: nothing is asked, and what was said of more is gone.
    for name in ("two", "glyphs", "broken"):
        (shelf / f"{name}.txt").unlink()
    alone = Pipeline(spark, str(tmp_path / "alone"), DECODERS, Synthesising)
    alone.ingest(str(shelf), "*.txt")
    alone.extract(prompts.SchemaSpec.of([{"key": "n", "type": "integer"}]))
    alone.report()
    assert alone.synthesise().count() == 0 and "Executive Summary" not in (tmp_path / "alone" / "review.tex").read_text()


def test_book_synthesis(spark, tmp_path):
    pages = spark.createDataFrame([("b", 1, "1\nFirst Things\nalpha"), ("b", 2, "2\nSecond Things\nbeta")], "book_id string, page_no int, text string")
    steps = Pipeline(spark, str(tmp_path / "work"), DECODERS, Synthesising)
    steps.book_index(pages)
    steps.book_extract()
    steps.book_summarize()
    body = steps.book_report().first()["body"]
    order = ["summary", "Key Themes:", "two\\_b", "thesis \\& all", "journey", "First Things", "Second Things"]
    assert [body.index(x) for x in order] == sorted(body.index(x) for x in order)


def test_failing_synthesis(spark, shelf, tmp_path):
    class Refusing(Synthesising):
        def complete(self, prompt, temperature):
            if prompt.startswith(("Write an executive", "Categorize")):
                raise RuntimeError("too long")
            return super().complete(prompt, temperature)

    steps = Pipeline(spark, str(tmp_path / "work"), DECODERS, Refusing)
    steps.ingest(str(shelf), "*.txt")
    steps.extract(prompts.SchemaSpec.of([{"key": "n", "type": "integer"}]))
    assert [tuple(r) for r in steps.synthesise().collect()] == [(None, "too long")]
    assert sorted(r["n"] for r in steps.report().collect()) == ["5", "5"]
