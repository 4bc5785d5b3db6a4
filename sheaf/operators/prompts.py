"""Texts that are sent to a model, built as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from sheaf.functions.text import head_and_tail, left
from sheaf.operators import corpus

# Characters of a text that each kind of prompt takes.
SCHEMA_PREFIX, PLAN_PREFIX, SECTIONS_PREFIX = 3_000, 30_000, 50_000
# Characters of single fields in the prompts over all papers, as the reference takes them.
FINDING_PREFIX, METHOD_PREFIX, CATEGORY_PREFIX = 500, 300, 200
MOST_TABLES = 3


@dataclass(frozen=True)
class SchemaSpec:
    """The declared columns of a matrix: (key, description, type); the type is string unless given."""

    columns: tuple[tuple[str, str, str], ...]

    @classmethod
    def of(cls, columns: list[dict]) -> SchemaSpec:
        return cls(tuple((c["key"], c.get("description", ""), c.get("type") or "string") for c in columns))

    def struct(self) -> StructType:
        types = {"integer": LongType(), "float": DoubleType()}
        return StructType([StructField(k, types.get(t, StringType())) for k, _, t in self.columns])

    def lines(self) -> str:
        return "\n".join(f"- {k}: {d} ({t})" for k, d, t in self.columns)

    def types(self) -> dict[str, str]:
        return {k: t for k, _, t in self.columns}


def field_lines(specs: DataFrame, group: str = "review") -> DataFrame:
    """(group, fields): a line "- key: description (type)" per declared column, in key order."""
    line = F.concat(F.lit("- "), F.col("key"), F.lit(": "), F.coalesce("description", F.lit("")), F.lit(" ("), F.coalesce("type", F.lit("string")), F.lit(")"))
    return specs.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("key").alias("k"), line.alias("l")))), lambda x: x["l"]), "\n").alias("fields"))


PLAN_LEAD = (
    "Read this paper and plan its extraction. Answer with one JSON object: title, authors, year, paper_type (THEORY, EMPIRICAL, SURVEY or ML), "
    "has_core_model, model_type, has_key_figure, key_figure_type, key_figure_ref, key_figure_description, sections_to_extract (a list).\n\nTEXT:\n"
)


def plan_prompt(content: Column | str) -> Column:
    return F.concat(F.lit(PLAN_LEAD), left(content, PLAN_PREFIX))


def sections_prompt(content: Column | str, sections: Column | str, fields: Column | str, tables: Column | str) -> Column:
    sections, fields, tables = (F.col(c) if isinstance(c, str) else c for c in (sections, fields, tables))
    shown = F.when(F.size(tables) > 0, F.to_json(F.slice(tables, 1, MOST_TABLES))).otherwise(F.lit("None"))
    return F.concat(
        F.lit("Write these sections of a literature review as one JSON object: "), F.array_join(sections, ", "),
        F.lit(".\nPut these values into extracted_fields:\n"), F.coalesce(fields, F.lit("")), F.lit("\n\nTABLES:\n"), shown, F.lit("\n\nTEXT:\n"), left(content, SECTIONS_PREFIX),
    )


def chapter_lead(title: Column | str) -> Column:
    """The part of a chapter's prompt before what the chapters before it say."""
    title = F.col(title) if isinstance(title, str) else title
    return F.concat(F.lit("Summarise this chapter as one JSON object.\nTITLE: "), F.coalesce(title, F.lit("")), F.lit("\n"))


def chapter_body(text: Column | str) -> Column:
    """The part behind: the text, of a long one its beginning and end."""
    text = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit("\n\nTEXT:\n"), head_and_tail(F.coalesce(text, F.lit(""))))


def chapter_prompt(text: Column | str, title: Column | str, context: Column | str) -> Column:
    return F.concat(chapter_lead(title), F.col(context) if isinstance(context, str) else context, chapter_body(text))


def _in_order(rows: DataFrame, group: str, order: str, lead: Column, line: Column, between: str) -> DataFrame:
    """(group, prompt): one prompt per group, with all of its rows' lines in order."""
    joined = corpus.joined_texts(rows.select(group, order, line.alias("line")), group, order, "line", between)
    return joined.join(rows.groupBy(group).agg(F.count("*").cast("string").alias("n")), group).select(group, F.concat(lead, F.col("joined")).alias("prompt"))


def _object(**fields: Column) -> Column:
    return F.to_json(F.struct(*(F.coalesce(c, F.lit("")).alias(k) for k, c in fields.items())))


def summary_prompts(papers: DataFrame, group: str, order: str) -> DataFrame:
    """(group, prompt): the prompt for an executive summary of all papers of a group."""
    lead = F.concat(F.lit("Write an executive summary for "), F.col("n"), F.lit(
        " papers. Target: PhD researchers. 300-400 words: what they ask, each paper's key finding with numbers and authors, where they agree or don't. "
        "End with exactly: **Key themes:** (1) ...; (2) ...; (3) ... (3 to 5 words each).\n\nPAPERS:\n"
    ))
    line = _object(
        title=F.coalesce("title", F.lit("Unknown")), authors=F.coalesce("authors", F.lit("Unknown")), year=F.coalesce("year", F.lit("n.d.")),
        core_finding=left("results", FINDING_PREFIX), contribution=F.col("contribution"), method=left("method", METHOD_PREFIX),
    )
    return _in_order(papers, group, order, lead, line, "\n")


def category_prompts(papers: DataFrame, group: str, order: str) -> DataFrame:
    """(group, prompt): the prompt that asks for categories and each paper's place in them."""
    lead = F.concat(F.lit("Categorize these "), F.col("n"), F.lit(
        " papers for a literature review: 2-5 thematic categories in logical order, each paper in one, papers of a category by year. Answer with one JSON object: "
        "categories (a list of name, description) and assignments (a list of paper_id, category, paper_order), with paper_id and names exactly as given.\n\nPAPERS:\n"
    ))
    line = _object(
        paper_id=F.col("paper_id"), title=F.col("title"), year=F.col("year"), paper_type=F.col("paper_type"),
        contribution=left("contribution", CATEGORY_PREFIX), method=left("method", CATEGORY_PREFIX),
    )
    return _in_order(papers, group, order, lead, line, "\n")


def book_prompts(summaries: DataFrame) -> DataFrame:
    """(book_id, prompt): the prompt for a synthesis of each book. summaries: book_id, number, main_thesis,
    unique_insight, key_terms."""
    lead = F.concat(F.lit("Synthesize these chapter summaries into a book-level overview.\nBOOK: "), F.col("book_id").cast("string"), F.lit("\nCHAPTERS: "), F.col("n"), F.lit(
        "\nAnswer with one JSON object: book_thesis (2-3 sentences), key_themes (a list of exactly 3, 3-5 words each), intellectual_journey (2-3 sentences), "
        "one_paragraph_summary (100-150 words).\n\nCHAPTER SUMMARIES:\n"
    ))
    line = F.concat(F.lit("Chapter "), F.col("number").cast("string"), F.lit(": "), "main_thesis", F.lit("\n  Unique insight: "), "unique_insight", F.lit("\n  Key terms: "), F.array_join("key_terms", ", "))
    return _in_order(summaries, "book_id", "number", lead, line, "\n\n")


def token_estimate(prompts: DataFrame, column: str = "prompt", per_token: float = 4.0) -> DataFrame:
    """(prompts, characters, tokens) in one row: the cost of a batch before it is sent."""
    return prompts.agg(F.count("*").alias("prompts"), F.coalesce(F.sum(F.length(column)), F.lit(0)).alias("characters"), F.ceil(F.coalesce(F.sum(F.length(column)), F.lit(0)) / per_token).alias("tokens"))
