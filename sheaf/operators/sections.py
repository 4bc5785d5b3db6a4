"""What to extract from a paper, and how the parts that come back are merged into one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import first_number, null_if_empty

# The names of sections.
KNOWN = [
    "context", "core_mechanism", "prior_work", "method", "results", "golden_quote", "data_description", "contribution", "key_equations", "notation",
    "applications", "limitations", "key_visual", "condensed_says", "condensed_theory_data", "condensed_estimation", "condensed_result",
]
MANDATORY = [
    "context", "core_mechanism", "method", "results", "contribution", "golden_quote", "limitations",
    "condensed_says", "condensed_theory_data", "condensed_estimation", "condensed_result",
]
OPTIONAL = [
    "core_mechanism", "prior_work", "data_description", "contribution", "condensed_says", "condensed_theory_data", "condensed_estimation", "condensed_result",
    "golden_quote", "applications", "limitations",
]


def _names(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def planned(sections: Column | str, has_core_model: Column | str, has_key_figure: Column | str) -> Column:
    """The planned sections, then the mandatory ones, key_equations with a model, key_visual with a figure; none twice."""
    sections, model, figure = (F.col(c) if isinstance(c, str) else c for c in (sections, has_core_model, has_key_figure))
    none = F.array().cast("array<string>")
    extra = F.concat(F.when(model, _names(["key_equations"])).otherwise(none), F.when(figure, _names(["key_visual"])).otherwise(none))
    return F.array_union(F.array_union(F.coalesce(sections, none), _names(MANDATORY)), extra)


def requested(sections: Column | str) -> Column:
    """The known ones among the sections, notation behind key_equations."""
    sections = F.col(sections) if isinstance(sections, str) else sections
    known = F.filter(sections, lambda s: F.array_contains(_names(KNOWN), s))
    return F.array_distinct(F.flatten(F.transform(known, lambda s: F.when(s == "key_equations", _names(["key_equations", "notation"])).otherwise(F.array(s)))))


def truthy(value: Column | str) -> Column:
    """Whether a flag that may come as text says yes: any text but empty, false, no and none."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(~F.lower(F.trim(value.cast("string"))).isin("", "false", "no", "none", "null", "0"), F.lit(False))


def has_equations(equations: Column | str, notation: Column | str) -> Column:
    """Whether equations come with notation and aren't placeholders."""
    equations, notation = (F.col(c) if isinstance(c, str) else c for c in (equations, notation))
    real = (equations != "") & (notation != "") & ~F.lower(equations).contains("not provided") & ~equations.contains("...")
    return F.coalesce(real, F.lit(False))


def key_visual(ref: Column | str, tables: Column | str, figures: Column | str) -> Column:
    """struct<type, number, found>: what a reference like "Table 2" points to; table is tried before figure,
    numbers beyond the lists and 0 find nothing."""
    ref, tables, figures = (F.col(c) if isinstance(c, str) else c for c in (ref, tables, figures))
    number = first_number(ref)
    low = F.lower(ref)
    is_table, is_figure = low.contains("table") & (number > 0), low.contains("figure") & (number > 0)
    kind = F.when(is_table, F.when(number <= F.size(tables), "table")).when(is_figure, F.when(number <= F.size(figures), "figure"))
    return F.struct(kind.alias("type"), number.alias("number"), kind.isNotNull().alias("found"))


def section(name: str, sections: str = "sections") -> Column:
    return F.try_element_at(F.col(sections), F.lit(name))


def merge(rows: DataFrame) -> DataFrame:
    """One row per paper out of plan and sections.

    rows: paper_id, title, short_title, authors, year, plan struct, sections map<string,string>, data
    map<string,string>, tables, figures. Optional parts without a value are null.
    """
    plan = lambda name: F.col(f"plan.{name}")
    equations = has_equations(section("key_equations"), section("notation"))
    has_figure = truthy(plan("has_key_figure")) & (F.coalesce(plan("key_figure_ref"), F.lit("")) != "")
    visual = key_visual(plan("key_figure_ref"), "tables", "figures")
    at = F.col("_visual.number")
    merged = rows.withColumn("_visual", F.when(has_figure, visual))
    return merged.select(
        "paper_id", "title", "short_title", "authors", "year", F.coalesce(plan("paper_type"), F.lit("EMPIRICAL")).alias("paper_type"),
        *(F.coalesce(section(n), F.lit("")).alias(n) for n in ("context", "method", "results")),
        F.coalesce("data", F.create_map().cast("map<string,string>")).alias("data"),
        *(null_if_empty(section(n)).alias(n) for n in OPTIONAL),
        null_if_empty(plan("core_problem")).alias("core_problem"), null_if_empty(plan("why_care")).alias("why_care"),
        F.when(plan("model_type") != "none", null_if_empty(plan("model_type"))).alias("model_type"),
        F.when(equations, section("key_equations")).alias("key_equations"), F.when(equations, section("notation")).alias("notation"),
        F.when(has_figure, plan("key_figure_ref")).alias("key_figure_ref"),
        F.when(has_figure, F.coalesce(plan("key_figure_type"), F.lit("unknown"))).alias("key_figure_type"),
        F.when(has_figure, F.coalesce(plan("key_figure_description"), F.lit(""))).alias("key_figure_description"),
        F.when(has_figure, null_if_empty(section("key_visual"))).alias("key_visual_explanation"),
        F.col("_visual.type").alias("key_visual_type"),
        F.when(F.col("_visual.type") == "table", F.to_json(F.get("tables", at - 1))).alias("key_visual_data"),
        F.when(F.col("_visual.type") == "figure", F.get("figures", at - 1)["image_path"]).alias("key_visual_path"),
        F.lit(None).cast("string").alias("error"),
    )


def unreadable(papers: DataFrame) -> DataFrame:
    """The rows that stand for unreadable papers: paper_id, filename."""
    return papers.select("paper_id", F.lit("[Unreadable PDF]").alias("title"), F.lit("Unknown").alias("authors"), F.lit("n.d.").alias("year"), F.lit("UNKNOWN").alias("paper_type"), F.lit("").alias("context"), F.lit("unreadable content").alias("error"))


def failed(papers: DataFrame) -> DataFrame:
    """The rows that stand for papers whose extraction failed: paper_id, filename, error."""
    empty = [F.lit("").alias(n) for n in ("method", "results")]
    return papers.select("paper_id", F.col("filename").alias("title"), F.lit("Unknown").alias("authors"), F.lit("n.d.").alias("year"), F.lit("UNKNOWN").alias("paper_type"), F.concat(F.lit("Extraction failed: "), F.coalesce("error", F.lit(""))).alias("context"), *empty, "error")
