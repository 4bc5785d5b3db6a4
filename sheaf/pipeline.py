"""The whole way from a folder of documents to a matrix and reports, and the same for books.

Each step reads the tables of the steps before from the working folder and writes its own, so steps can be
run one at a time and again. ``python -m sheaf.pipeline`` offers them on the command line.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.functions import text
from sheaf.functions.identifiers import chapter_filename, safe_filename
from sheaf.functions.metadata import leading_metadata, title_with_fallbacks
from sheaf.operators import categories, chapters, inventory, matrix, models, prompts, reports, sections
from sheaf.sources import documents, sinks

PLAN = "title string, authors string, year string, paper_type string, has_core_model string, model_type string, has_key_figure string, key_figure_type string, key_figure_ref string, key_figure_description string, core_problem string, why_care string, sections_to_extract array<string>"
CATEGORIES = "categories array<struct<name:string,description:string>>, assignments array<struct<paper_id:string,category:string,paper_order:string>>"
SYNTHESIS = "book_thesis string, key_themes array<string>, intellectual_journey string, one_paragraph_summary string"
CHAPTER = ("main_thesis", "unique_insight", "how_to", "key_evidence", "counterexample", "practical_implications", "golden_quote")
class Pipeline:
    """Steps over a working folder. ``make`` gives a model client in each worker."""

    def __init__(self, spark: SparkSession, work: str, decoders: list[tuple[str, documents.Decoder]] | None = None, make: Callable[[], models.ModelClient] = models.EchoClient):
        self.spark, self.work, self.make = spark, work.rstrip("/"), make
        self.decoders = decoders or [("pypdf", documents.pypdf_decoder), ("text", documents.text_decoder)]

    def _at(self, name: str) -> str:
        return f"{self.work}/{name}"

    def _read(self, name: str) -> DataFrame:
        return sinks.read_table(self.spark, self._at(name))

    def _read_if(self, name: str, schema: str) -> DataFrame:
        """A table of an earlier step, or no rows if that step hasn't run; one that can't be read raises."""
        return sinks.read_table(self.spark, self._at(name), schema)

    def ingest(self, folder: str, pattern: str = "*.pdf") -> DataFrame:
        """Decodes a folder's files; returns the tally."""
        documents.check_folder(folder)
        sinks.write_table(documents.ingest(documents.files(self.spark, folder, pattern), self.decoders), self._at("ingested"))
        new = self._read("ingested").select("id", "filename", "status")
        old = self._read_if("inventory", "id string, filename string, status string")
        sinks.write_table(inventory.merged(old, new, "id"), self._at("inventory"))
        return inventory.tallies(self._read("inventory"))

    def configure(self, ask: str | None = None, seed: int | None = None) -> str:
        """Asks the model for a schema from the beginnings of up to three documents; returns its answer."""
        some = documents.readable(self._read("ingested")).orderBy(F.rand(seed) if seed is not None else F.rand()).limit(3)
        joined = some.agg(F.array_join(F.collect_list(F.substring("markdown", 1, prompts.SCHEMA_PREFIX)), "\n\n---\n\n").alias("prompt"))
        lead = ask or "List the columns to extract from papers like these as YAML: columns, each with key, description and type."
        answer = models.call(joined.withColumn("prompt", F.concat(F.lit(lead + "\n\n"), "prompt")), "prompt", self.make, 0.3).select(models.without_fences("answer")).first()[0]
        sinks.write_document(self._at("columns.yaml"), answer or "")
        return answer

    def extract(self, spec: prompts.SchemaSpec) -> DataFrame:
        """Plans, extracts and merges; earlier papers stay, unreadable and failed ones have rows of their own."""
        found = self._read("ingested").where("status = 'ingested'").withColumnRenamed("id", "paper_id")
        good = documents.readable(found)
        planned = models.call(good.withColumn("prompt", prompts.plan_prompt("markdown")), "prompt", self.make, answer="plan_text", error="plan_error")
        # What a model said is written before anything reads it twice.
        sinks.write_table(planned, self._at("plans"))
        plans = models.parsed(self._read("plans"), "plan_text", PLAN, "plan")
        wanted = plans.withColumn("sections", sections.requested(sections.planned(F.col("plan.sections_to_extract"), sections.truthy("plan.has_core_model"), sections.truthy("plan.has_key_figure"))))
        asked = wanted.withColumn("prompt", F.when(F.col("plan_error").isNull(), prompts.sections_prompt("markdown", "sections", F.lit(spec.lines()), "tables"))).drop("sections")
        sinks.write_table(models.call(asked, "prompt", self.make, answer="section_text", error="section_error"), self._at("sections"))
        answered = models.parsed(self._read("sections"), "section_text", "map<string,string>", "sections").withColumn("error", F.coalesce("plan_error", "section_error"))
        meta = leading_metadata("markdown")
        rows = answered.where("error is null").withColumns({
            "title": text.clamp(title_with_fallbacks("markdown", F.col("plan.title"))),
            "authors": F.coalesce(text.null_if_empty(meta["authors"]), F.col("plan.authors"), F.lit("Unknown")),
            "year": F.coalesce(text.null_if_empty(meta["year"]), F.col("plan.year"), F.lit("n.d.")),
            "data": F.from_json(F.coalesce(F.try_element_at("sections", F.lit("extracted_fields")), F.lit("{}")), "map<string,string>"),
        }).withColumn("short_title", text.short_title("title"))
        merged = sections.merge(rows)
        errors = sections.unreadable(documents.unreadable(found)).unionByName(sections.failed(answered.where("error is not null").select("paper_id", "filename", "error")), allowMissingColumns=True)
        sinks.write_table(inventory.with_errors(merged, errors), self._at("extracted"))
        self.synthesise()
        return self._read("extracted")

    def synthesise(self) -> DataFrame:
        """Asks for an executive summary of all extracted papers and for their categories, if there are two or more.

        Each prompt holds all papers, none left out: what a model can't take comes back as its error.
        """
        papers = self._read("extracted").withColumn("run", F.lit(1))
        several = papers.join(papers.groupBy("run").count().where("count >= 2").select("run"), "run")
        summary = models.call(prompts.summary_prompts(several, "run", "paper_id"), "prompt", self.make, 0.3, "executive_summary", "error")
        sinks.write_table(summary.select("executive_summary", "error"), self._at("summary"))
        sinks.write_table(models.call(prompts.category_prompts(several, "run", "paper_id"), "prompt", self.make, 0.2), self._at("categorisation"))
        read = models.parsed(self._read("categorisation"), "answer", CATEGORIES, "c")
        sinks.write_table(read.select(F.posexplode("c.categories").alias("at", "g")).select("g.name", "g.description", (F.col("at") + 1).alias("category_order")), self._at("categories"))
        place = F.col("a.paper_order").try_cast("double").cast("int").alias("paper_order")
        sinks.write_table(read.select(F.posexplode("c.assignments").alias("ordinal", "a")).select("a.paper_id", "a.category", place, "ordinal"), self._at("assignments"))
        return self._read("summary")

    def report(self, condensed: bool = False) -> DataFrame:
        """The matrix and the review, or with ``condensed`` the condensed matrix and the appendix: CSV, LaTeX, and a
        PDF where a LaTeX compiler is installed. Papers are sorted in the cluster and written one partition at a time."""
        papers = self.categorised()
        if condensed:
            out = matrix.condensed(papers)
            sinks.write_csv(out, self._at("appendix.csv"))
            headed = categories.headings(papers, "paper_id").withColumns(matrix.condensed_parts()).select("ordinal", reports.appendix_row().alias("row"))
            sinks.write_table(headed, self._at("appendix_rows"))
            rows = self._read("appendix_rows")
            self._document(rows.orderBy("ordinal"), "row", "appendix.tex", reports.appendix_head(rows.count()), reports.APPENDIX_TAIL, "\n")
            return out
        good = papers.where("error is null")
        out = matrix.pivot(good, ["paper_id", "title"])
        sinks.write_csv(out, self._at("matrix.csv"))
        front = self._read_if("summary", "executive_summary string, error string").where("executive_summary != ''").select(reports.executive_summary("executive_summary")).first()
        head = reports.review_head("Literature Review") + (f"{front[0]}\n\n" if front else "")
        written = categories.ordered(good.withColumn("section", reports.paper_section(good.columns)), "paper_id")
        self._document(written, "section", "review.tex", head, reports.TAIL)
        return out

    def _document(self, rows: DataFrame, column: str, name: str, head: str, tail: str, between: str = "\n\n") -> None:
        sinks.write_pieces(rows, column, self._at(name), head, tail, between)
        sinks.compile_latex(self._at(name))

    def categorised(self, assignments: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
        """The extracted papers with their categories, in order; those that the model gave unless others are passed."""
        if assignments is None:
            assignments = self._read_if("assignments", "paper_id string, category string, paper_order int, ordinal int")
        if groups is None:
            groups = self._read_if("categories", "name string, description string, category_order int")
        return categories.ordered(categories.assign(self._read("extracted"), assignments, groups), "paper_id")

    def book_read(self, source: str) -> DataFrame:
        """Decodes books (a file, or the files of a folder), each once, and indexes their pages by outline or headings."""
        folder = str(Path(source).parent) if Path(source).is_file() else source
        pattern = Path(source).name if Path(source).is_file() else "*"
        sinks.write_table(documents.books(documents.files(self.spark, folder, pattern), self.decoders), self._at("books"))
        books = self._read("books")
        if books.where("error is null").isEmpty():
            raise ValueError(f"{source} holds no book that a decoder reads")
        return self.book_index(documents.pages(books), documents.outlines(books))

    def book_index(self, pages: DataFrame, outlines: DataFrame | None = None) -> DataFrame:
        sinks.write_table(pages, self._at("pages"))
        sinks.write_table(chapters.detect(self._read("pages"), outlines), self._at("chapters"))
        return self._read("chapters")

    def book_extract(self, suffix: str = ".txt") -> DataFrame:
        """The chapters' texts as a table and as files (chapters/<book>/<number and title>)."""
        found = chapters.texts(self._read("pages"), self._read("chapters"))
        sinks.write_table(found.withColumn("filename", chapter_filename("number", "title", suffix)), self._at("chapter_texts"))
        written = self._read("chapter_texts")
        sinks.write_text_files(written.withColumn("at", F.concat_ws("/", safe_filename("book_id"), "filename")), self._at("chapter_files"), "at", "text")
        return written

    def book_summarize(self) -> DataFrame:
        sinks.write_table(models.fold(self._read("chapter_texts"), self.make), self._at("summaries"))
        asked = models.call(prompts.book_prompts(self._told()), "prompt", self.make, 0.2)
        # Answers are written before they are read: parsed() looks at them twice.
        sinks.write_table(asked, self._at("synthesis_answers"))
        read = models.parsed(self._read("synthesis_answers"), "answer", SYNTHESIS, "s")
        sinks.write_table(read.select("book_id", "s.*", "error"), self._at("syntheses"))
        return self._read("summaries")

    def _told(self) -> DataFrame:
        """book_id, number and what the model said of each chapter; chapters whose call failed are empty."""
        read = models.parsed(self._read("summaries"), "answer", ", ".join(f"{f} string" for f in CHAPTER) + ", key_terms array<string>", "s")
        return read.select("book_id", "number", *(F.coalesce(f"s.{f}", F.lit("")).alias(f) for f in CHAPTER), F.coalesce("s.key_terms", F.array().cast("array<string>")).alias("key_terms"))

    def book_titles(self) -> DataFrame:
        """(book_id, book_title): the first line of a book's first page, else its id."""
        first = self._read("pages").where("page_no = 1").groupBy("book_id").agg(F.first("text").alias("_page"))
        return first.select("book_id", text.book_title("_page", "book_id").alias("book_title"))

    def book_report(self) -> DataFrame:
        """(book_id, body, document): LaTeX per book out of its synthesis, its chapters and what the model said of them.
        The documents are written as files and compiled where a LaTeX compiler is installed."""
        told = self._read("chapters").join(self._told(), ["book_id", "number"])
        placed = told.withColumn("ordinal", F.row_number().over(Window.partitionBy("book_id").orderBy("number")))
        joined = placed.withColumns({"section": reports.chapter_section(), "line": reports.contents_line()})
        body = reports.assembled(joined, "book_id", "number", "section").join(reports.assembled(joined, "book_id", "number", "line").withColumnRenamed("body", "contents"), "book_id")
        front = self._read_if("syntheses", "book_id string, " + SYNTHESIS).select("book_id", reports.book_front().alias("front"))
        whole = body.join(front, "book_id", "left").join(self.book_titles(), "book_id", "left").withColumn("body", F.concat_ws("\n\n", "front", "body"))
        sinks.write_table(whole.select("book_id", "body", reports.book_document("book_title", "contents", "body").alias("document")), self._at("book_reports"))
        written = self._read("book_reports")
        files = written.withColumn("at", F.concat(safe_filename("book_id"), F.lit(".tex")))
        sinks.write_text_files(files, self._at("book_documents"), "at", "document")
        for row in files.select("at").toLocalIterator():
            sinks.compile_latex(f"{self._at('book_documents')}/{row[0]}")
        return written


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sheaf")
    parser.add_argument("--work", default=".")
    steps = parser.add_subparsers(dest="step", required=True)
    steps.add_parser("ingest").add_argument("source")
    steps.add_parser("configure").add_argument("--prompt", "-p")
    steps.add_parser("extract")
    steps.add_parser("report").add_argument("--condensed", "-c", action="store_true")
    book = steps.add_parser("book").add_subparsers(dest="book_step", required=True)
    book.add_parser("index").add_argument("source")
    # A layout decoder for chapters isn't part of the reference either: the flag changes the files' suffix alone.
    book.add_parser("extract").add_argument("--docling", "-d", action="store_true")
    for name in ("summarize", "report"):
        book.add_parser(name)
    said = parser.parse_args(arguments)
    from sheaf.session import local_session

    pipeline = Pipeline(local_session(), said.work)
    if said.step == "ingest":
        pipeline.ingest(said.source).show()
    elif said.step == "configure":
        print(pipeline.configure(said.prompt))
    elif said.step == "extract":
        pipeline.extract(prompts.SchemaSpec.of(documents.read_schema_spec(f"{said.work}/columns.yaml"))).show()
    elif said.step == "report":
        pipeline.report(said.condensed).show()
    elif said.book_step == "index":
        pipeline.book_read(said.source).show()
    elif said.book_step == "extract":
        pipeline.book_extract(".md" if said.docling else ".txt").show()
    else:
        {"summarize": pipeline.book_summarize, "report": pipeline.book_report}[said.book_step]().show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
