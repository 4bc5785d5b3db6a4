import json

import pytest
from pyspark.sql import functions as F

from sheaf.operators import categories, chapters, corpus, inventory, library, matrix, models, prompts, reports, sections, spans


def test_upsert(spark):
    rows = [("a", 1, "x", None), ("a", 2, None, "p"), ("b", None, "y", "q"), ("a", 2, None, "o"), (None, 1, "z", "r"), ("c", 1, "x", "s"), ("c", 1, "x", "s")]
    df = spark.createDataFrame(rows, "id string, at int, status string, path string")
    got = {r["id"]: tuple(r)[1:] for r in inventory.upsert(df, "id", [F.col("at")]).collect()}
    assert got == {"a": (2, None, "p"), "b": (None, "y", "q"), None: (1, "z", "r"), "c": (1, "x", "s")}
    new = spark.createDataFrame([("a", "failed"), ("d", "ingested")], "id string, status string")
    old = spark.createDataFrame([("a", "ingested", "path"), ("b", "extracted", "path")], "id string, status string, path string")
    assert {tuple(r) for r in inventory.merged(old, new, "id").select("id", "status", "path").collect()} == {("a", "failed", None), ("d", "ingested", None), ("b", "extracted", "path")}
    assert {tuple(r) for r in inventory.status_counts(old).collect()} == {("ingested", 1), ("extracted", 1)}
    assert tuple(inventory.tallies(old).first()) == (2, 0) and inventory.upsert(df.limit(0), "id", [F.col("at")]).count() == 0
    assert inventory.with_status(old, "ingested").count() == 1


def test_categories(spark):
    papers = spark.createDataFrame([("p1",), ("p2",), ("p3",), ("p4",)], "paper_id string")
    given = spark.createDataFrame([("p1", "A", 2, 1), ("p1", "B", None, 2), ("p2", "A", 1, 1), ("p3", None, 5, 1), (None, "A", 1, 1)], "paper_id string, category string, paper_order int, ordinal int")
    groups = spark.createDataFrame([("A", 2), ("A", 1), ("B", 3), (None, 1)], "name string, category_order int")
    got = [(r["paper_id"], r["category"], r["paper_order"], r["category_order"]) for r in categories.ordered(categories.assign(papers, given, groups), "paper_id").collect()]
    assert got == [("p2", "A", 1, 1), ("p1", "B", 99, 3), ("p3", "Uncategorized", 5, 99), ("p4", "Uncategorized", 99, 99)]
    headed = categories.headings(categories.assign(papers, given, groups), "paper_id").orderBy("ordinal").collect()
    assert [(r["starts_category"], r["banded"]) for r in headed] == [(True, True), (True, False), (True, True), (False, False)]


def test_matrix(spark):
    rows = [("p1", "T", {"b": "1", "a": "x", "title": "clash"}), ("p2", None, None), ("p3", "U", {"B": "2.6", "ä,b": 'q"'})]
    df = spark.createDataFrame(rows, "paper_id string, title string, data map<string,string>")
    wide = matrix.pivot(df, ["paper_id", "title"])
    assert wide.columns == ["paper_id", "title", "B", "a", "b_2", "data_title", "ä,b"]
    assert [tuple(r) for r in wide.orderBy("paper_id").collect()] == [("p1", "T", "", "x", "1", "clash", ""), ("p2", None, "", "", "", "", ""), ("p3", "U", "2.6", "", "", "", 'q"')]
    typed = matrix.typed(df, ["paper_id"], {"b": "integer", "B": "float", "missing": "string"})
    assert [tuple(r) for r in typed.orderBy("paper_id").collect()] == [("p1", 1, None, None), ("p2", None, None, None), ("p3", None, 2.6, None)]
    assert matrix.pivot(df.limit(0), ["paper_id"]).columns == ["paper_id"]


def test_condensed(spark):
    columns = ["authors", "year", "condensed_says", "contribution", "condensed_theory_data", "context", "condensed_estimation", "method", "condensed_result", "results"]
    df = spark.createDataFrame([("A", "1997", None, "c" * 200, "t", None, None, None, None, "r" * 200), (None,) * 10], ", ".join(f"{c} string" for c in columns))
    assert [tuple(r) for r in matrix.condensed(df).collect()] == [("A (1997) says " + "c" * 150, "t", "", "r" * 100), ("Unknown (n.d.) says ", "", "", "")]


def test_chapters(spark):
    pages = spark.createDataFrame([
        ("b", 1, "cover"), ("b", 2, "1\nIntroduction and Motivation\ntext"), ("b", 3, None), ("b", 4, "2\nPart One\nx"), ("b", 5, "Chapter 3: The A/A Test\nbody"), ("b", 6, "4\nClient-Side Experiments"),
        ("c", 1, "no heading"), ("c", 2, ""),
    ], "book_id string, page_no int, text string")
    found = chapters.detect(pages).orderBy("book_id", "number").collect()
    assert [(r["book_id"], r["number"], r["title"], r["start_page"], r["end_page"], r["page_count"]) for r in found] == [
        ("b", 1, "Introduction and Motivation", 2, 4, 3), ("b", 2, "The A/A Test", 5, 5, 1), ("b", 3, "Client", 6, 6, 1), ("c", 1, "Full Book", 1, 2, 2),
    ]
    texts = {(r["book_id"], r["number"]): r["text"] for r in chapters.texts(pages, chapters.detect(pages)).collect()}
    assert texts["b", 1] == "1\nIntroduction and Motivation\ntext\n\n\n\n2\nPart One\nx" and texts["c", 1] == "no heading\n\n"
    outline = spark.createDataFrame([("c", 0, 0, " One ", 1), ("c", 1, 1, "inner", 1), ("c", 2, 0, "Two", 2), ("c", 3, 0, "lost", None)], "book_id string, position int, level int, title string, page_no int")
    assert [(r["title"], r["start_page"], r["end_page"]) for r in chapters.detect(pages, outline).where("book_id = 'c'").orderBy("number").collect()] == [("One", 1, 1), ("Two", 2, 2)]
    assert chapters.detect(pages.limit(0)).count() == 0


def test_context_and_positions(spark):
    told = spark.createDataFrame([("b", 1, "t1", ["a", "b", "c", "d", "e", "f"]), ("b", 2, "t2", []), ("b", 3, None, None)], "book_id string, chapter_num int, main_thesis string, key_terms array<string>")
    got = [r["context"] for r in chapters.previous_context(told).orderBy("chapter_num").collect()]
    assert got == ["PREVIOUS CHAPTERS: This is the first chapter.", "PREVIOUS CHAPTERS (for context):\n  Ch 1: t1\n    Key terms: a, b, c, d, e", "PREVIOUS CHAPTERS (for context):\n  Ch 1: t1\n    Key terms: a, b, c, d, e\n  Ch 2: t2"]
    left = spark.createDataFrame([("b", 5), ("b", 9), ("b", 11)], "book_id string, number int")
    right = spark.createDataFrame([("b", 2), ("b", 1)], "book_id string, summary_no int")
    assert [(r["number"], r["summary_no"]) for r in chapters.with_summaries(left, right).orderBy("number").collect()] == [(5, 1), (9, 2)]


def test_sections(spark):
    df = spark.createDataFrame([(["prior_work", "results", "made_up"], True, False), (None, None, True)], "s array<string>, m boolean, f boolean")
    plan = [r[0] for r in df.select(sections.planned("s", "m", "f")).collect()]
    assert plan[0] == ["prior_work", "results", "made_up", *(x for x in sections.MANDATORY if x != "results"), "key_equations"] and plan[1] == [*sections.MANDATORY, "key_visual"]
    asked = [r[0] for r in df.select(sections.requested(sections.planned("s", "m", "f"))).collect()]
    assert "made_up" not in asked[0] and asked[0][-2:] == ["key_equations", "notation"]
    flags = spark.createDataFrame([(x,) for x in ("true", "no", "", None, "False", "yes")], "x string")
    assert [r[0] for r in flags.select(sections.truthy("x")).collect()] == [True, False, False, False, False, True]


def test_merge(spark):
    plan = "struct<paper_type:string,has_key_figure:string,key_figure_ref:string,key_figure_type:string,key_figure_description:string,core_problem:string,why_care:string,model_type:string>"
    table = "array<struct<page:int,data:array<map<string,string>>,caption:string>>"
    schema = f"paper_id string, title string, short_title string, authors string, year string, plan {plan}, sections map<string,string>, data map<string,string>, tables {table}, figures array<struct<page:int,image_path:string,caption:string>>"
    rows = [
        ("p1", "T", "T", "A", "1997", ("SURVEY", "true", "Table 1 and Figure 1", None, None, "", None, "none"), {"context": "c", "key_equations": "$x$", "notation": "x", "golden_quote": "", "key_visual": "v"}, None, [(1, [{"k": "v"}], None)], []),
        ("p2", "T", "T", "A", "1997", (None, "true", "Figure 2", "figure", "d", "p", "w", "structural"), {"key_equations": "not provided", "notation": "x"}, {"n": "1"}, [], [(1, "a.png", None), (1, "b.png", None)]),
        ("p3", "T", "T", "A", "1997", (None, "false", "Figure 1", None, None, None, None, None), None, None, None, None),
    ]
    got = {r["paper_id"]: r for r in sections.merge(spark.createDataFrame(rows, schema)).collect()}
    a, b, c = got["p1"], got["p2"], got["p3"]
    assert (a["paper_type"], a["key_equations"], a["golden_quote"], a["model_type"], a["key_visual_type"], a["data"]) == ("SURVEY", "$x$", None, None, "table", {})
    assert json.loads(a["key_visual_data"])["data"] == [{"k": "v"}] and a["key_visual_explanation"] == "v"
    assert (b["paper_type"], b["key_equations"], b["notation"], b["model_type"], b["key_visual_path"], b["data"]) == ("EMPIRICAL", None, None, "structural", "b.png", {"n": "1"})
    assert (c["key_figure_ref"], c["key_visual_type"], c["context"]) == (None, None, "")


def test_spans(spark):
    rows = [("l", 10.0, 20.0, 50.0, 40.0, "x"), ("l", 52.0, 20.0, 100.0, 40.0, "+"), ("l", 102.0, 20.0, 150.0, 40.0, "y"), ("l", 20.0, 18.0, 30.0, 41.0, "in"), ("m", 10.0, 100.0, 100.0, 120.0, "z"), ("l", 300.0, 20.0, 310.0, 40.0, None)]
    df = spark.createDataFrame(rows, "line string, x0 double, y0 double, x1 double, y1 double, text string")
    got = sorted(tuple(r) for r in spans.merge(df, ["line"], 5).select("line", "x0", "x1", "y0", "y1", "text", "spans").collect())
    assert got == [("l", 10.0, 150.0, 18.0, 41.0, "xin+y", 4), ("l", 300.0, 310.0, 20.0, 40.0, "", 1), ("m", 10.0, 100.0, 100.0, 120.0, "z", 1)]
    assert spans.merge(df.limit(0), ["line"], 5).count() == 0


def test_corpus(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None)], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in corpus.exact_copies(df).collect()) == [(1, 1, 2), (2, 2, 1), (3, 1, 2), (4, 4, 1), (5, 5, 1)]
    texts = spark.createDataFrame([(1, "before\r\n# One\nx\n## Two\n\ny"), (2, None), (3, "")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in corpus.sections(texts, "doc_id", "text").collect()) == [(1, 0, 0, None, "before"), (1, 1, 1, "One", "x"), (1, 2, 2, "Two", "\ny"), (3, 0, 0, None, "")]
    assert [r.doc_id for r in corpus.sample(df, 3, 7).collect()] == [r.doc_id for r in corpus.sample(df, 3, 7).collect()]
    assert corpus.joined_texts(df.withColumn("g", F.lit(1)), "g", "doc_id", "text", "|").first()["joined"] == "a|b|a||"


@pytest.mark.parametrize("given, read", [
    ('{"a": 1}', {"a": 1}), ('```json\n{"a": [1, 2,],}\n```', {"a": [1, 2]}), ("Here: {'a': 'it\"s', 'b': None, 'c': True} bye", {"a": 'it"s', "b": None, "c": True}),
    ('{"a": "cut of', {"a": "cut of"}), ('{"a": {"b": [1, {"c": 2', {"a": {"b": [1, {"c": 2}]}}), ('{"a": "line\nbreak"}', {"a": "line\nbreak"}), ("nothing", None), ("", None), (None, None),
])
def test_repair(given, read):
    got = models.repair_json(given)
    assert (json.loads(got) if got else None) == read


class Failing:
    def complete(self, prompt, temperature):
        if "bad" in prompt:
            raise RuntimeError("author trouble")
        return "{'main_thesis': 'said'"


def test_model_calls(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "i int, prompt string")
    rows = models.call(df, "prompt", Failing)
    assert sorted((r["i"], r["answer"], r["error"]) for r in rows.collect()) == [(1, "{'main_thesis': 'said'", None), (2, None, "author trouble"), (3, None, None)]
    read = {r["i"]: r["read"]["main_thesis"] if r["read"] else None for r in models.parsed(rows, "answer", "main_thesis string", "read").collect()}
    assert read == {1: "said", 2: None, 3: None}
    book = spark.createDataFrame([("b", 2, "Two", "y"), ("b", 1, "One", "x")], "book_id string, number int, title string, text string")
    told = models.fold(book, models.EchoClient).orderBy("number").collect()
    assert told[0]["context"].endswith("first chapter.") and "Ch 1: x" in told[1]["context"]


def test_each_prompt_is_sent_once(spark, tmp_path):
    """Answers that differ from call to call: each row stays one row, whatever is read from its answer."""
    sent = tmp_path / "sent"

    class Varying:
        def complete(self, prompt, temperature):
            import random

            with sent.open("a") as out:
                out.write("x")
            return random.choice(['{"main_thesis": "a"}', "{'main_thesis': 'b',}", "no JSON", '```json\n{"main_thesis": "c"}\n```'])

    df = spark.range(200).selectExpr("id", "'p' || id AS prompt")
    rows = models.parsed(models.call(df, "prompt", Varying), "answer", "main_thesis string", "read").select("id", "answer", "read").collect()
    assert sorted(r["id"] for r in rows) == list(range(200)) and sent.stat().st_size == 200
    assert all((r["read"] or {"main_thesis": None})["main_thesis"] == next((x for x in "abc" if f"{x}\"" in r["answer"] or f"'{x}'" in r["answer"]), None) for r in rows)


def test_headings_over_a_whole_table(spark):
    papers = spark.range(500).selectExpr("id AS paper_id", "concat('c', (id * 7) % 5) AS category", "cast((id * 7) % 5 % 3 AS int) AS category_order", "cast(id % 11 AS int) AS paper_order")
    one = categories.headings(papers.withColumn("g", F.lit(1)), "paper_id", "g").drop("g")
    key = lambda df: sorted(tuple(r) for r in df.select("paper_id", "ordinal", "starts_category", "banded").collect())
    assert key(categories.headings(papers.repartition(4), "paper_id")) == key(one)
    assert categories.headings(papers.limit(0), "paper_id").count() == 0


def test_prompts(spark):
    spec = prompts.SchemaSpec.of([{"key": "n", "description": "size", "type": "integer"}, {"key": "m"}])
    assert spec.lines() == "- n: size (integer)\n- m:  (string)" and spec.struct().simpleString() == "struct<n:bigint,m:string>"
    (long,) = spark.createDataFrame([("x" * 40_000,)], "t string").select(F.length(prompts.plan_prompt("t")) - F.length(prompts.plan_prompt(F.lit("")))).first()
    assert long == prompts.PLAN_PREFIX


def test_reports(spark):
    df = spark.createDataFrame([("A & B", None, "T_1", "1997", "SURVEY", "50%", "$x_1$ & y", "r", None, "q")], "authors string, short_title string, title string, year string, paper_type string, context string, method string, results string, prior_work string, golden_quote string")
    section = df.select(reports.paper_section(df.columns)).first()[0]
    assert section.startswith("\\section{T\\_1}") and "A \\& B" in section and "$x_1$ \\& y" in section and "Prior Work" not in section and "``q''" in section
    chapter = spark.createDataFrame([(1, 3, "T", "**b**", "", None, "e", "", None, "", ["a", "b_c"], 1, 9)], "number int, ordinal int, title string, main_thesis string, unique_insight string, how_to string, key_evidence string, counterexample string, practical_implications string, golden_quote string, key_terms array<string>, start_page int, end_page int")
    body = chapter.select(reports.chapter_section(), reports.contents_line()).first()
    assert "\\textbf{b}" in body[0] and "a, b\\_c" in body[0] and "pp.\\,1--9" in body[0] and "p.\\,5" in body[1]
    assert reports.assembled(chapter.withColumn("s", reports.chapter_section()).withColumn("g", F.lit(1)), "g", "number", "s").count() == 1


def test_library(spark):
    paths = spark.createDataFrame([("a.JSON", None), ("b.unknown", "bibtex"), (None, ""), ("c.bib", None)], "path string, given string")
    assert [r[0] for r in paths.select(library.output_format("path", "given")).collect()] == ["json", "bibtex", "text", "bibtex"]
    lines = spark.createDataFrame([("arXiv: 2301.1 ",), ("# note",), ("  ",), ("10.1/x",), (None,), ("doi:10.2/y:z",)], "line string")
    assert [(r["source"], r["identifier"]) for r in library.manifest(lines).collect()] == [("arxiv", "2301.1"), (None, "10.1/x"), ("doi", "10.2/y:z")]
    texts = spark.createDataFrame([("# T\n## Abstract\n\nShort text.\n\n## Introduction\nx",), ("abstract\nto the end",), ("none",), (None,), ("",)], "t string")
    assert [r[0] for r in texts.select(library.abstract("t")).collect()] == ["Short text.", "to the end", None, None, None]
    documents = spark.createDataFrame([(1, "intro Figure 2\n# One\n" + "see table 1, Table 1. " * 3 + "\n## Two\n" + "end " * 30), (2, None), (3, "")], "k bigint, t string")
    found = library.annotated_chunks(documents, "k", "t", 40, 10).orderBy("start").collect()
    assert [r["section"] for r in found][:2] == [None, "One"] and found[-1]["section"] == "Two" and found[0]["mentions"] == ["figure 2", "table 1"] and found[1]["mentions"] == ["table 1"]
    assert all(r["end"] - r["start"] == len(r["chunk"]) for r in found) and {r["k"] for r in found} == {1}
    works = spark.createDataFrame([(1, "10.1/A", "T", 1990), (2, "10.1/a", "other", 1991), (3, None, "A title!", 1990), (4, None, "a  TITLE", 1990), (5, None, None, 1990)], "id int, doi string, title string, year int").withColumn("work", library.work_key("doi", "title", "year"))
    assert sorted((r["id"], r["copies"]) for r in library.merged_bibliography(works, ["id"]).collect()) == [(1, 2), (3, 2)]
    edges, nodes = library.citations(works.withColumn("source", F.lit(1)), "source")
    assert sorted(r["times"] for r in edges.collect()) == [2, 2] and {r["cited_by"] for r in nodes.collect()} == {1}
    papers = spark.createDataFrame([(1, "Ann Lee", "Wages", 2001), (2, "Bo Lee", "WAGE growth", 2005), (3, None, "wages", None), (4, "LEE", "Prices", 2003)], "paper_id int, authors string, title string, year int")
    assert [r["paper_id"] for r in library.search(papers, "lee").collect()] == [2, 4, 1] and [r["paper_id"] for r in library.search(papers, title="wage", years=(2000, 2004)).collect()] == [1]
    assert [r["paper_id"] for r in library.search(papers, limit=2).collect()] == [2, 4]
    assert library.merged_bibliography(works.limit(0), ["id"]).count() == 0
