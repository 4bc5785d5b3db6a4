"""Queries of the document operators over the tables of a folder, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.functions import chunks as c
from sheaf.functions import geometry, grids, identifiers, latex, references, text
from sheaf.functions.metadata import leading_metadata, leading_title, title_with_fallbacks
from sheaf.operators import categories, chapters, corpus, inventory, library, matrix, models, prompts, reports, sections, spans
from sheaf.plans import views
from sheaf.session import table
from sheaf.sources import documents
from sheaf.streaming.ingest import counts_by_window

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


# Text and LaTeX.

UNREADABLE_SQL = r"""
    CASE WHEN {t} IS NULL OR length({t}) < 100 THEN true
         ELSE ((length({s}) - length(replace({s}, '/G', ''))) / 2 + (length({s}) - length(replace({s}, '\x', ''))) / 2
               + length({s}) - length(replace({s}, chr(0), '')) + length({s}) - length(replace({s}, chr(65533), ''))) > length({s}) * 0.1 END
"""


def _unreadable_sql(column: str) -> str:
    return UNREADABLE_SQL.format(t=column, s=f"left({column}, 1000)")


@query(f"SELECT result_id, {_unreadable_sql('markdown')} AS unreadable FROM ingest_results")
def garbage_flag(spark, folder):
    return table(spark, folder, "ingest_results").select("result_id", text.is_unreadable("markdown").alias("unreadable"))


TITLE_SQL = r"""
    CASE WHEN length({b}) > 50 THEN regexp_replace(left({b}, 50), ' [^ ]*$', '') || '...' ELSE {b} END
"""


@query(
    "SELECT row_id, " + TITLE_SQL.format(b="base") + r""" AS short_title, CASE WHEN length(title) > 60 THEN left(title, 60) || '...' ELSE title END AS clamped,
        coalesce(CASE WHEN length(title) <= 30 THEN title ELSE rtrim(CASE WHEN space > 15 THEN left(title, space) ELSE left(title, 30) END) || '...' END, '') AS truncated
    FROM (SELECT row_id, title, CASE WHEN contains(title, ':') THEN trim(split_part(title, ':', 1)) ELSE title END AS base,
                 CASE WHEN strpos(reverse(left(title, 30)), ' ') = 0 THEN -1 ELSE length(left(title, 30)) - strpos(reverse(left(title, 30)), ' ') END AS space FROM matrix)
    """
)
def short_titles(spark, folder):
    return table(spark, folder, "matrix").select("row_id", text.short_title("title").alias("short_title"), text.clamp("title", 60).alias("clamped"), text.truncate_words("title", 30).alias("truncated"))


def _replaced_sql(column: str, pairs: list[tuple[str, str]]) -> str:
    for what, by in pairs:
        column = f"replace({column}, '{what}', '{by}')"
    return column


@query(f"SELECT doc_id, {_replaced_sql("coalesce(text, '')", latex.ESCAPES)} AS escaped FROM documents")
def latex_escape(spark, folder):
    return table(spark, folder, "documents").select("doc_id", latex.escape("text").alias("escaped"))


@query(
    "SELECT doc_id, "
    + _replaced_sql(r"regexp_replace(regexp_replace(coalesce(text, ''), '\*\*(.+?)\*\*', '\\textbf{\1}', 'g'), '\*(.+?)\*', '\\textit{\1}', 'g')", latex.AFTER_MARKDOWN)
    + " AS converted FROM documents"
)
def markdown_to_latex(spark, folder):
    return table(spark, folder, "documents").select("doc_id", latex.from_markdown("text").alias("converted"))


@query(
    r"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''), '\$(\d)', '\\$\1', 'g'), '(?s)(\$\$[^$]+\$\$|\$[^$]+\$|[^$]+|\$)'),
        lambda p: CASE WHEN starts_with(p, '$') AND length(p) > 2 THEN p ELSE """
    + _replaced_sql("p", latex.OUTSIDE_MATH)
    + " END), '') AS escaped FROM documents"
)
def math_preserving_escape(spark, folder):
    return table(spark, folder, "documents").select("doc_id", latex.keep_math("text").alias("escaped"))


@query(r"""
    SELECT doc_id, CASE WHEN length(text) > 2000 THEN left(text, 1400) || chr(10) || chr(10) || '[...MIDDLE SECTION OMITTED DUE TO LENGTH...]' || chr(10) || chr(10) || right(text, 600) ELSE text END AS shortened
    FROM documents""")
def head_tail_truncate(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.head_and_tail("text", 2000).alias("shortened"))


@query(r"""
    SELECT doc_id, words, CAST(ceil(words / 250.0) AS INTEGER) AS minutes
    FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0b]+'), lambda w: w <> '')) AS words FROM documents WHERE text IS NOT NULL)""")
def reading_time(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", text.word_count("text").cast("bigint").alias("words"), text.words_per_minute("text").alias("minutes"))


# Metadata.


@query()
def paper_metadata(spark, folder):
    return views.papers(spark, folder).withColumn("m", leading_metadata("content")).select("paper_id", "m.title", "m.authors", "m.year")


@query()
def paper_titles(spark, folder):
    planned = F.when(F.col("paper_id") % 2 == 0, F.lit("JEL codes")).otherwise(F.concat(F.lit("Planned title "), F.col("paper_id").cast("string")))
    return views.papers(spark, folder).select("paper_id", leading_title("content").alias("leading"), title_with_fallbacks("content", planned).alias("title"))


@query(r"""
    SELECT result_id, nullif(regexp_extract(markdown, '(?:^|[^\p{L}\p{M}\p{N}_])(19[89][0-9]|20[0-2][0-9])(?:[^\p{L}\p{M}\p{N}_]|$)', 1), '') AS year FROM ingest_results""")
def first_year(spark, folder):
    return table(spark, folder, "ingest_results").select("result_id", text.year_in("markdown").alias("year"))


# Extraction: what is asked for and what comes back.


@query(r"""
    SELECT result_id, ref, number,
           CASE WHEN contains(lower(ref), 'table') AND number > 0 THEN CASE WHEN number <= n_tables THEN 'table' END
                WHEN contains(lower(ref), 'figure') AND number > 0 THEN CASE WHEN number <= n_figures THEN 'figure' END END AS type
    FROM (SELECT result_id, ref, TRY_CAST(nullif(regexp_extract(ref, '\d+', 0), '') AS INTEGER) AS number, coalesce(len(tables), 0) AS n_tables, coalesce(len(figures), 0) AS n_figures
          FROM (SELECT *, CASE result_id % 4 WHEN 0 THEN 'Table ' || (result_id % 3) WHEN 1 THEN 'FIGURE ' || (result_id % 5) WHEN 2 THEN 'Table and Figure 1' ELSE 'Appendix' END AS ref FROM ingest_results))""")
def ref_number_lookup(spark, folder):
    n = F.col("result_id")
    ref = F.when(n % 4 == 0, F.concat(F.lit("Table "), (n % 3).cast("string"))).when(n % 4 == 1, F.concat(F.lit("FIGURE "), (n % 5).cast("string"))).when(n % 4 == 2, F.lit("Table and Figure 1")).otherwise(F.lit("Appendix"))
    rows = table(spark, folder, "ingest_results").select("result_id", ref.alias("ref"), *(F.coalesce(x, F.expr(f"slice({x}, 1, 0)"), F.array().cast(k)).alias(x) for x, k in dict(table(spark, folder, "ingest_results").dtypes).items() if x in ("tables", "figures")))
    return rows.withColumn("v", sections.key_visual("ref", "tables", "figures")).select("result_id", "ref", "v.number", "v.type")


_MANDATORY_SQL = "[" + ", ".join(f"'{s}'" for s in sections.MANDATORY) + "]"


@query(rf"""
    WITH w AS (
        SELECT doc_id, list_concat(base, list_filter({_MANDATORY_SQL}, lambda s: NOT list_contains(base, s)), CASE WHEN doc_id % 3 = 0 AND NOT list_contains(base, 'key_equations') THEN ['key_equations'] ELSE CAST([] AS VARCHAR[]) END,
                                   CASE WHEN doc_id % 5 = 0 THEN ['key_visual'] ELSE CAST([] AS VARCHAR[]) END) AS planned
        FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['prior_work', 'results'] WHEN 2 THEN ['key_equations', 'made_up'] ELSE ['applications'] END AS base FROM documents))
    SELECT doc_id, array_to_string(planned, ',') AS planned,
           array_to_string(flatten(list_transform(list_filter(planned, lambda s: s <> 'made_up'), lambda s: CASE WHEN s = 'key_equations' THEN ['key_equations', 'notation'] ELSE [s] END)), ',') AS requested FROM w""")
def section_plan(spark, folder):
    n = F.col("doc_id")
    names = lambda *x: F.array(*map(F.lit, x))
    base = F.when(n % 4 == 0, F.array().cast("array<string>")).when(n % 4 == 1, names("prior_work", "results")).when(n % 4 == 2, names("key_equations", "made_up")).otherwise(names("applications"))
    planned = sections.planned(base, n % 3 == 0, n % 5 == 0)
    return table(spark, folder, "documents").select("doc_id", F.array_join(planned, ",").alias("planned"), F.array_join(sections.requested(planned), ",").alias("requested"))


@query(r"""
    SELECT row_id, nullif(methodology, '') AS methodology, CASE WHEN model_variant <> 'Base' THEN nullif(model_variant, '') END AS model_type,
           coalesce(methodology <> '' AND notes <> '' AND NOT contains(lower(methodology), 'not provided') AND NOT contains(methodology, '...'), false) AS has_equations FROM matrix""")
def optional_fields(spark, folder):
    rows = table(spark, folder, "matrix")
    return rows.select("row_id", text.null_if_empty("methodology").alias("methodology"), F.when(F.col("model_variant") != "Base", text.null_if_empty("model_variant")).alias("model_type"), sections.has_equations("methodology", "notes").alias("has_equations"))


@query("""
    SELECT review, array_to_string(list_transform(list_sort(list({'k': key, 'l': '- ' || key || ': ' || coalesce(description, '') || ' (' || coalesce(type, 'string') || ')'})), lambda x: x.l), chr(10)) AS fields
    FROM schema_spec GROUP BY review""")
def field_lines(spark, folder):
    return prompts.field_lines(table(spark, folder, "schema_spec"))


@query("""
    SELECT count(*) AS prompts, CAST(sum(n) AS BIGINT) AS characters, CAST(ceil(sum(n) / 4.0) AS BIGINT) AS tokens FROM (SELECT least(length(text), 30000) + 14 AS n FROM documents WHERE text IS NOT NULL)""")
def token_estimate(spark, folder):
    rows = table(spark, folder, "documents").where("text is not null").select(F.concat(F.lit("Plan the text:"), F.left("text", F.lit(prompts.PLAN_PREFIX))).alias("prompt"))
    return prompts.token_estimate(rows)


@query("WITH " + views.PAPERS_SQL + f"""
    SELECT paper_id, NULL AS error, content AS title FROM papers WHERE NOT ({_unreadable_sql('content')})
    UNION ALL SELECT paper_id, 'unreadable content', '[Unreadable PDF]' FROM papers WHERE {_unreadable_sql('content')}""")
def error_union(spark, folder):
    rows = views.papers(spark, folder)
    bad = text.is_unreadable("content")
    good = rows.where(~bad).select("paper_id", F.col("content").alias("title"))
    return inventory.with_errors(good, sections.unreadable(rows.where(bad)).select("paper_id", "title", "error")).select("paper_id", "error", "title")


# Inventory, categories, matrix.


@query("SELECT coalesce(nullif(lower(trim(status)), ''), 'pending') AS status, count(*) AS papers FROM inventory GROUP BY 1")
def status_counts(spark, folder):
    return inventory.status_counts(table(spark, folder, "inventory").withColumn("status", inventory.clean_status("status")))


@query("""
    SELECT id, filename, markdown_path, tables_path, figures_path, status, review FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, loaded_at DESC NULLS LAST, filename DESC NULLS LAST, markdown_path DESC NULLS LAST, tables_path DESC NULLS LAST,
                                     figures_path DESC NULLS LAST, status DESC NULLS LAST, review DESC NULLS LAST) AS n FROM inventory) WHERE n = 1""")
def inventory_upsert(spark, folder):
    return inventory.upsert(table(spark, folder, "inventory"), "id", [F.col("updated_at"), F.col("loaded_at")]).drop("updated_at", "loaded_at")


@query("WITH " + views.ASSIGNMENTS_SQL + "SELECT paper_id, c_nationkey, category, paper_order, category_order FROM assigned")
def category_assignment(spark, folder):
    return categories.assign(*views.assignments(spark, folder)).select("paper_id", "c_nationkey", "category", "paper_order", "category_order")


@query("WITH " + views.ASSIGNMENTS_SQL + """
    SELECT paper_id, c_nationkey, category, paper_order, category_order, ordinal, lag(category) OVER w IS DISTINCT FROM category AS starts_category, ordinal % 2 = 1 AS banded
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY category_order, paper_order, paper_id) AS INTEGER) AS ordinal FROM assigned)
    WINDOW w AS (PARTITION BY c_nationkey ORDER BY ordinal)""")
def category_headings(spark, folder):
    return categories.headings(categories.assign(*views.assignments(spark, folder)), "paper_id", "c_nationkey").select("paper_id", "c_nationkey", "category", "paper_order", "category_order", "ordinal", "starts_category", "banded")


FIELDS = ["benchmark_task", "effect_size", "methodology", "model_variant", "performance_improvement", "sample_size", "training_compute"]


def _with_data(spark, folder) -> DataFrame:
    entries = F.array(*(F.struct(F.lit(f).alias("k"), F.col(f).alias("v")) for f in FIELDS))
    return table(spark, folder, "matrix").select("row_id", "paper_id", "title", F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())).alias("data"))


@query("SELECT row_id, paper_id, title, " + ", ".join(f"coalesce({f}, '') AS {f}" for f in FIELDS) + " FROM matrix")
def matrix_pivot(spark, folder):
    return matrix.pivot(_with_data(spark, folder), ["row_id", "paper_id", "title"])


@query("""
    SELECT row_id, CAST(trunc(TRY_CAST(trim(sample_size) AS DOUBLE)) AS BIGINT) AS sample_size, TRY_CAST(trim(effect_size) AS DOUBLE) AS effect_size, methodology FROM matrix""")
def typed_matrix(spark, folder):
    return matrix.typed(_with_data(spark, folder), ["row_id"], {"sample_size": "integer", "effect_size": "float", "methodology": "string"})


@query("""
    SELECT row_id, coalesce(title, 'Unknown') || ' (' || coalesce(CAST(year(extracted_at) AS VARCHAR), 'n.d.') || ') says ' || coalesce(notes, left(coalesce(methodology, ''), 150)) AS paper,
           coalesce(benchmark_task, left(coalesce(methodology, ''), 100)) AS theory_data, coalesce(model_variant, left(coalesce(training_compute, ''), 150)) AS estimation,
           coalesce(effect_size, left(coalesce(performance_improvement, ''), 100)) AS results FROM matrix""")
def condensed_matrix(spark, folder):
    rows = table(spark, folder, "matrix").select(
        "row_id", F.col("title").alias("authors"), F.year("extracted_at").alias("year"), F.col("notes").alias("condensed_says"), F.col("methodology").alias("contribution"),
        F.col("benchmark_task").alias("condensed_theory_data"), F.col("methodology").alias("context"), F.col("model_variant").alias("condensed_estimation"), F.col("training_compute").alias("method"),
        F.col("effect_size").alias("condensed_result"), F.col("performance_improvement").alias("results"),
    )
    return matrix.condensed(rows, ["row_id"])


# Books.

CHAPTERS_SQL = views.PAGES_SQL + r"""
    , starts AS (
        SELECT book_id, page_no AS start_page, left(trim(split_part(title, chr(10), 1)), 80) AS title
        FROM (SELECT book_id, page_no, coalesce(nullif(regexp_extract(front, '\A(\d+)\s*\n\s*([A-Z][A-Za-z\s,'':]+)', 2), ''), nullif(regexp_extract(front, '\A(?:Chapter|CHAPTER)\s+(\d+)[:.\s]+([^\n]+)', 2), '')) AS title
              FROM (SELECT book_id, page_no, trim(left(text, 300), ' ' || chr(9) || chr(10) || chr(13)) AS front FROM pages))
        WHERE title IS NOT NULL AND NOT regexp_matches(left(split_part(trim(title), chr(10), 1), 80), '(?i)topics?\s+for|^part\s+|selected\s+topics?|advanced\s+topics?|complementary\s+and\s+alternative')
    ),
    totals AS (SELECT book_id, max(page_no) AS total FROM pages GROUP BY book_id),
    found AS (
        SELECT book_id, CAST(row_number() OVER b AS INTEGER) AS number, title, start_page, coalesce(lead(start_page) OVER b - 1, total) AS end_page
        FROM starts JOIN totals USING (book_id) WINDOW b AS (PARTITION BY book_id ORDER BY start_page)
        UNION ALL SELECT book_id, 1, 'Full Book', 1, total FROM totals WHERE book_id NOT IN (SELECT book_id FROM starts)
    )
"""


@query("WITH " + CHAPTERS_SQL + "SELECT book_id, number, title, start_page, end_page, end_page - start_page + 1 AS page_count FROM found")
def chapter_ranges(spark, folder):
    return chapters.detect(views.pages(spark, folder))


@query("WITH " + CHAPTERS_SQL + """
    SELECT f.book_id, number, title, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY page_no) AS text
    FROM found f JOIN pages p ON p.book_id = f.book_id AND p.page_no BETWEEN f.start_page AND f.end_page GROUP BY f.book_id, number, title""")
def chapter_text(spark, folder):
    pages = views.pages(spark, folder)
    return chapters.texts(pages, chapters.detect(pages))


@query("""
    SELECT book_id, position, l.o_orderkey AS number, r.o_orderkey AS summary_no
    FROM (SELECT o_custkey AS book_id, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS position FROM orders WHERE o_orderstatus = 'O') l
    JOIN (SELECT o_custkey AS book_id, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS position FROM orders WHERE o_orderstatus <> 'O') r USING (book_id, position)""")
def zip_join(spark, folder):
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "book_id")
    left = orders.where("o_orderstatus = 'O'").select("book_id", F.col("o_orderkey").alias("number"))
    right = orders.where("o_orderstatus <> 'O'").select("book_id", F.col("o_orderkey").alias("summary_no"))
    return chapters.with_summaries(left, right).select("book_id", "position", "number", "summary_no")


@query("""
    SELECT book_id, chapter_num, CASE WHEN before IS NULL THEN 'PREVIOUS CHAPTERS: This is the first chapter.' ELSE 'PREVIOUS CHAPTERS (for context):' || chr(10) || before END AS context
    FROM (SELECT book_id, chapter_num, string_agg(line, chr(10)) OVER (PARTITION BY book_id ORDER BY chapter_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
          FROM (SELECT o_custkey AS book_id, o_orderkey AS chapter_num, '  Ch ' || o_orderkey || ': ' || o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE chr(10) || '    Key terms: ' || o_orderstatus || ', term' END AS line FROM orders))""")
def previous_context(spark, folder):
    terms = F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("o_orderstatus", F.lit("term")))
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("chapter_num"), F.col("o_orderpriority").alias("main_thesis"), terms.alias("key_terms"))
    return chapters.previous_context(rows).select("book_id", "chapter_num", "context")


# Chunks and pages.


@query("""
    SELECT doc_id, start, substr(text, start + 1, 500) AS chunk
    FROM (SELECT doc_id, text, CAST(unnest(CASE WHEN length(text) <= 500 THEN [0] ELSE range(0, length(text) - 50, 450) END) AS INTEGER) AS start FROM documents WHERE length(text) > 0)""")
def chunks(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.explode(c.chunks("text", 500, 50)).alias("c")).select("doc_id", "c.start", "c.chunk")


@query("""
    SELECT doc_id, CAST(CASE WHEN back > 0 AND length(text) - back + 1 > length(text) * 0.8 THEN length(text) - back + 1 ELSE length(text) END AS INTEGER) AS break_point
    FROM (SELECT doc_id, text, strpos(reverse(text), ' .') AS back FROM documents)""")
def break_points(spark, folder):
    return table(spark, folder, "documents").select("doc_id", c.break_point("text").alias("break_point"))


@query()
def sentence_chunks(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.posexplode(c.sentence_chunks("text", 400, 40)).alias("at", "chunk"))


@query("""
    SELECT part, array_to_string(list_filter(pages, lambda p: p >= 0 AND p < 30), ',') AS valid, array_to_string(list_distinct_sorted, ',') AS invalid
    FROM (SELECT p_partkey AS part, [p_size, p_size - 25, -1, p_size] AS pages, list_sort(list_distinct(list_filter([p_size, p_size - 25, -1, p_size], lambda p: p < 0 OR p >= 30))) AS list_distinct_sorted FROM part)""")
def page_check(spark, folder):
    size = F.col("p_size")
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("part"), c.valid_pages(F.array(size, size - 25, F.lit(-1), size), 30).alias("v"))
    return rows.select("part", F.array_join("v.valid", ",").alias("valid"), F.array_join(F.array_sort("v.invalid"), ",").alias("invalid"))


@query("""
    SELECT part, CASE kind WHEN 0 THEN array_to_string(range(p_size - 1, p_size + 2), ',') WHEN 1 THEN CAST(p_size - 1 AS VARCHAR) || ',0' END AS pages
    FROM (SELECT p_partkey AS part, p_size, p_partkey % 4 AS kind FROM part)""")
def page_selection(spark, folder):
    size, s = F.col("p_size"), F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 4
    spec = F.when(kind == 0, F.concat(s, F.lit(" - "), (size + 2).cast("string"))).when(kind == 1, F.concat(s, F.lit(", 1"))).when(kind == 2, F.concat(s, F.lit("-"))).otherwise(F.lit("abc"))
    return table(spark, folder, "part").select(F.col("p_partkey").alias("part"), F.array_join(c.page_range(spec), ",").alias("pages"))


# Identifiers, file names, references.


@query("WITH " + views.IDENTIFIERS_SQL + r"""
    SELECT id, identifier, source, CASE source WHEN 'arxiv' THEN regexp_replace(identifier, '(?i)^arxiv:', '') WHEN 'doi' THEN regexp_extract(identifier, '10\.\d{4,9}/\S+', 0)
           WHEN 'ssrn' THEN regexp_extract(identifier, '\d+', 0) WHEN 'nber' THEN regexp_extract(identifier, '\d+', 0) ELSE identifier END AS normalised
    FROM (SELECT id, identifier, CASE WHEN regexp_matches(identifier, '(?i)^(arxiv:)?(\d{4}\.\d{4,5}|[a-z]+(-[a-z]+)*(\.[a-z]{2})?/\d{7})(v\d+)?$') THEN 'arxiv'
            WHEN regexp_matches(identifier, '(?i)^(doi:\s*|https?://(dx\.)?doi\.org/)?10\.\d{4,9}/\S+$') THEN 'doi' WHEN regexp_matches(identifier, '(?i)^(ssrn:|ssrn-id)?\d{7,8}$') THEN 'ssrn'
            WHEN regexp_matches(identifier, '(?i)^(nber:)?w?\d{4,5}$') THEN 'nber' WHEN regexp_matches(identifier, '(?i)^https?://\S+$') THEN 'url' ELSE 'unknown' END AS source FROM identifiers)""")
def identifier_router(spark, folder):
    return views.identifiers(spark, folder).select("id", "identifier", identifiers.source_of("identifier").alias("source"), identifiers.normalised("identifier").alias("normalised"))


@query("WITH " + views.IDENTIFIERS_SQL + r"""
    SELECT id, regexp_replace(regexp_replace(lower(identifier), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
           coalesce(nullif(regexp_replace(regexp_replace(regexp_extract(url_decode(identifier), '([^/\\]*)$', 1), '^\.+', ''), '[<>:"|?*]', '_', 'g'), ''), 'download') AS safe FROM identifiers""")
def safe_filenames(spark, folder):
    return views.identifiers(spark, folder).select("id", identifiers.slug("identifier").alias("slug"), identifiers.safe_filename("identifier").alias("safe"))


@query("WITH " + views.IDENTIFIERS_SQL + r"""
    SELECT id, CASE WHEN ends_with(lower(base), '.pdf') THEN base ELSE regexp_replace(regexp_replace(lower(host || '_' || rest), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '.pdf' END AS filename
    FROM (SELECT id, regexp_extract(path, '([^/]*)$', 1) AS base, regexp_extract(identifier, '^[a-zA-Z]+://([^/?#]+)', 1) AS host, regexp_extract(path, '^[a-zA-Z]+://[^/]+/?(.*)$', 1) AS rest
          FROM (SELECT id, identifier, regexp_replace(identifier, '[?#].*$', '') AS path FROM identifiers WHERE starts_with(identifier, 'http')))""")
def url_filenames(spark, folder):
    return views.identifiers(spark, folder).where("startswith(identifier, 'http')").select("id", identifiers.filename_from_url("identifier").alias("filename"))


REFERENCE_FIELDS_SQL = r"""
    TRY_CAST(nullif(regexp_extract(reference, '\(((?:19|20)\d\d)[a-z]?\)', 1), '') AS INTEGER) AS year,
    nullif(trim(regexp_extract(reference, '\((?:19|20)\d\d[a-z]?\)\.?\s*([^.?!]+[?!]?)', 1)), '') AS title,
    nullif(trim(regexp_extract(reference, '\((?:19|20)\d\d[a-z]?\)\.?\s*[^.?!]+[.?!]+\s*([^.,\d]+?),\s*\d', 1)), '') AS journal,
    list_extract(regexp_extract_all(regexp_replace(reference, '(?i)doi.*$', ''), '(?:^|[^\d.])(\d+[-–]\d+)(?:\D|$)', 1), -1) AS pages,
    nullif(regexp_replace(regexp_extract(reference, '(?i)(?:doi:\s*|doi\.org/)(10\.\d{4,9}/[^\s,;]+)', 1), '[.)]+$', ''), '') AS doi,
    list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_extract(reference, '^(.*?)\((?:19|20)\d\d', 1), '(?:\band\b|&)', ',', 'g'), '(\p{L}[\p{L}'' -]*,\s*(?:\p{Lu}\.\s?-?)+)', 1), lambda n: trim(n)), lambda n: n <> '' AND lower(n) <> 'and') AS named
"""
REFERENCES_READ_SQL = views.REFERENCES_SQL + f"""
    , reads AS (
        SELECT *, array_to_string(list_filter(named, lambda n, i: list_position(list_transform(named, lambda x: lower(x)), lower(n)) = i), ' and ') AS authors, named[1] AS first_author
        FROM (SELECT result_id, position, {REFERENCE_FIELDS_SQL} FROM reference_lines)
    )
"""


@query("WITH " + REFERENCES_READ_SQL + "SELECT result_id, position, year, title, journal, pages, doi, authors FROM reads")
def reference_fields(spark, folder):
    r = views.reference_lines(spark, folder).withColumn("p", references.parsed("reference"))
    return r.select("result_id", "position", "p.year", "p.title", "p.journal", "p.pages", "p.doi", F.array_join("p.authors", " and ").alias("authors"))


_SKIPPED_SQL = "[" + ", ".join(f"'{w}'" for w in references.SKIPPED_WORDS) + "]"
_BIBTEX_VALUE_SQL = r"'{' || replace(replace(regexp_replace(trim({v}), '\s*[\r\n]+\s*', ' ', 'g'), '%', '\%'), '&', '\&') || '}'"


def _bibtex_field_sql(name: str, value: str) -> str:
    return f"CASE WHEN {value} IS NOT NULL THEN '  {name} = ' || " + _BIBTEX_VALUE_SQL.replace("{v}", value) + " END"


@query("WITH " + REFERENCES_READ_SQL + rf"""
    SELECT result_id, position, key, authors,
           CASE WHEN journal IS NOT NULL THEN '@article{{' ELSE '@misc{{' END || key || ',' || chr(10) || concat_ws(',' || chr(10), {_bibtex_field_sql('author', "nullif(authors, '')")}, {_bibtex_field_sql('title', 'title')},
               {_bibtex_field_sql('year', 'CAST(year AS VARCHAR)')}, {_bibtex_field_sql('journal', 'journal')}, {_bibtex_field_sql('pages', 'pages')}, {_bibtex_field_sql('doi', 'doi')}) || chr(10) || '}}' AS entry
    FROM (SELECT *, coalesce(nullif(regexp_replace(lower(split_part(first_author, ',', 1)), '[^a-z]', '', 'g'), ''), 'unknown') || coalesce(CAST(year AS VARCHAR), '') ||
                 coalesce(list_filter(list_transform(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda w: regexp_replace(w, '[^a-z]', '', 'g')), lambda w: w <> '' AND NOT list_contains({_SKIPPED_SQL}, w))[1], '') AS key FROM reads)""")
def bibtex_entries(spark, folder):
    r = views.reference_lines(spark, folder).withColumn("p", references.parsed("reference"))
    key = references.citation_key(F.col("p.authors"), F.col("p.year"), F.col("p.title"))
    entry = references.bibtex(F.col("p.authors"), F.col("p.year"), F.col("p.title"), F.col("p.journal"), F.col("p.pages"), F.col("p.doi"))
    return r.select("result_id", "position", key.alias("key"), F.array_join("p.authors", " and ").alias("authors"), entry.alias("entry"))


@query(r"""
    SELECT result_id, nullif(regexp_extract(markdown, '(?is)(?:^|\n)[ \t#]*(?:references|bibliography)[ \t]*\n(.*)$', 1), '') AS references FROM ingest_results""".replace("AS references", 'AS "references"'))
def reference_sections(spark, folder):
    return table(spark, folder, "ingest_results").select("result_id", references.references_section("markdown").alias("references"))


# Tables and boxes.


@query(r"""
    SELECT result_id, table_no, CAST(CASE WHEN len(data) > 0 THEN len(data) + 1 ELSE 0 END AS INTEGER) AS "rows", CAST(coalesce(cardinality(data[1]), 0) AS INTEGER) AS cols,
           CASE WHEN len(data) > 0 THEN array_to_string(list_transform(list_prepend(map_keys(data[1]), list_transform(data, lambda r: map_values(r))), lambda cells: array_to_string(list_transform(cells,
                lambda v: CASE WHEN v IS NULL THEN '' WHEN regexp_matches(v, '[,"\r\n]') THEN '"' || replace(v, '"', '""') || '"' ELSE v END), ',')), chr(10)) ELSE '' END AS csv
    FROM (SELECT result_id, unnest(range(1, len(tables) + 1)) AS table_no, unnest(list_transform(tables, lambda t: t.data)) AS data FROM ingest_results WHERE len(tables) > 0)""")
def grid_tables(spark, folder):
    rows = table(spark, folder, "ingest_results").where("size(tables) > 0").select("result_id", F.posexplode("tables").alias("at", "t")).select("result_id", (F.col("at") + 1).cast("bigint").alias("table_no"), "t.data")
    grid = F.when(F.size("data") > 0, F.concat(F.array(F.map_keys(F.get("data", F.lit(0)))), F.transform("data", lambda r: F.map_values(r)))).otherwise(F.array().cast("array<array<string>>"))
    return rows.withColumn("g", grid).select("result_id", "table_no", grids.row_count("g").alias("rows"), grids.column_count("g").alias("cols"), grids.csv("g").alias("csv"))


@query("""
    WITH s AS (SELECT user_id, event_id AS x0, event_id + event_id % 50 AS x1 FROM events),
    b AS (SELECT *, max(x1) OVER (PARTITION BY user_id ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 > reach + 10 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS island FROM b)
    SELECT user_id, CAST(island AS BIGINT) AS island, min(x0) AS x0, max(x1) AS x1, count(*) AS spans FROM i GROUP BY user_id, island""")
def span_merge(spark, folder):
    e = F.col("event_id")
    rows = table(spark, folder, "events").select("user_id", e.alias("x0"), (e + e % 50).alias("x1"), F.lit(0).alias("y0"), F.lit(1).alias("y1"), F.lit("").alias("text"))
    return spans.merge(rows, ["user_id"], 10).select("user_id", "island", "x0", "x1", "spans")


@query("""
    SELECT event_id, abs((x0 + x1) / 2 - 306.0) < 61.2 AND x1 - x0 < 612.0 * 0.8 AS display, value < 0.8 AS low_confidence
    FROM (SELECT event_id, value, CAST(event_id % 300 AS DOUBLE) AS x0, CAST(event_id % 300 + event_id % 400 AS DOUBLE) AS x1 FROM events)""")
def display_equations(spark, folder):
    e = F.col("event_id")
    x0, x1 = (e % 300).cast("double"), (e % 300 + e % 400).cast("double")
    return table(spark, folder, "events").select("event_id", geometry.is_display(x0, x1).alias("display"), geometry.is_low_confidence(F.lit("x"), "value").alias("low_confidence"))


@query("SELECT doc_id, coalesce(length(text) >= 2 AND regexp_matches(text, '[∀-⋿Ͱ-Ͽ℀-⅏⟀-⟯⦀-⫿]'), false) AS math FROM documents")
def math_symbols(spark, folder):
    return table(spark, folder, "documents").select("doc_id", geometry.has_math_symbols("text").alias("math"))


# Collections.


@query("""
    SELECT doc_id, coalesce(first, doc_id) AS copy_of, coalesce(n, 1) AS copies FROM documents d
    LEFT JOIN (SELECT text, min(doc_id) AS first, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text) g ON g.text = d.text""")
def exact_copies(spark, folder):
    return corpus.exact_copies(table(spark, folder, "documents"))


PAPER_GROUPS_SQL = """
    SELECT coalesce(paper_id, 'doc ' || doc_id) AS paper, string_agg({text}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id, {text}) AS joined
    FROM documents GROUP BY 1"""


def _by_paper(spark, folder) -> DataFrame:
    # Papers bound the groups; a document of no paper is a group of its own.
    return table(spark, folder, "documents").withColumn("paper", F.coalesce("paper_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string"))))


@query(PAPER_GROUPS_SQL.format(text=f"left(coalesce(text, ''), {prompts.SCHEMA_PREFIX})"))
def abstract_concat(spark, folder):
    # The beginnings that the prompt for a schema takes of each text.
    return corpus.joined_texts(_by_paper(spark, folder), "paper", "doc_id", "text", prefix=prompts.SCHEMA_PREFIX)


@query(PAPER_GROUPS_SQL.format(text="coalesce(text, '')"))
def paper_concat(spark, folder):
    return corpus.joined_texts(_by_paper(spark, folder), "paper", "doc_id", "text")


@query(r"""
    WITH l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS lines FROM documents WHERE text IS NOT NULL)),
    m AS (SELECT *, length(regexp_extract(line, '^(#{1,6})[ \t]+\S', 1)) AS level FROM l),
    n AS (SELECT *, CAST(sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS INTEGER) AS section_no FROM m)
    SELECT doc_id, section_no, CAST(max(level) AS INTEGER) AS level, max(CASE WHEN level > 0 THEN trim(regexp_replace(line, '^#{1,6}[ \t]+', '')) END) AS title,
           coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE level = 0), '') AS body FROM n GROUP BY doc_id, section_no""")
def document_sections(spark, folder):
    return corpus.sections(table(spark, folder, "documents"), "doc_id", "text")


@query("""
    SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, folder):
    return counts_by_window(table(spark, folder, "events")).withColumn("total", F.round("total", 4))


# Reports and model calls.


def _escaped_sql(column: str) -> str:
    return _replaced_sql(f"coalesce({column}, '')", latex.ESCAPES)


def _kept_math_sql(column: str) -> str:
    return rf"""array_to_string(list_transform(regexp_extract_all(regexp_replace(coalesce({column}, ''), '\$(\d)', '\\$\1', 'g'), '(?s)(\$\$[^$]+\$\$|\$[^$]+\$|[^$]+|\$)'),
        lambda p: CASE WHEN starts_with(p, '$') AND length(p) > 2 THEN p ELSE {_replaced_sql('p', latex.OUTSIDE_MATH)} END), '')"""


def _cut_sql(column: str, n: int) -> str:
    """truncate_words: cut at the last space of the second half."""
    cut = f"left({column}, {n})"
    space = f"CASE WHEN contains({cut}, ' ') THEN {n} - strpos(reverse({cut}), ' ') ELSE -1 END"
    return rf"""CASE WHEN length({column}) <= {n} THEN {column} ELSE regexp_replace(CASE WHEN {space} > {n // 2} THEN left({cut}, {space}) ELSE {cut} END, '[\s\p{{Z}}]+$', '') || '...' END"""


@query(rf"""
    SELECT row_id, concat_ws(chr(10) || chr(10),
        '\section{{' || {_cut_sql("escaped_title", 60)} || '}}' || chr(10) || '\textit{{' || {_escaped_sql("authors")} || '}} (' || {_escaped_sql("year")} || ') \hfill \textsc{{\small ' || {_escaped_sql("paper_type")} || '}}',
        CASE WHEN golden_quote <> '' THEN '\begin{{quote}}\itshape ``' || {_escaped_sql("golden_quote")} || chr(39) || chr(39) || '\end{{quote}}' END,
        '\textbf{{Context.}} ' || {_escaped_sql("context")}, CASE WHEN prior_work <> '' THEN '\textbf{{Prior Work.}} ' || {_escaped_sql("prior_work")} END, '\textbf{{Method.}} ' || {_kept_math_sql("method")},
        CASE WHEN key_equations <> '' THEN '\textbf{{Key Equation.}} ' || key_equations || CASE WHEN notation <> '' THEN chr(10) || chr(10) || '\textit{{where ' || {_kept_math_sql("notation")} || '}}' ELSE '' END END,
        '\textbf{{Results.}} ' || {_kept_math_sql("results")}, CASE WHEN limitations <> '' THEN '\textbf{{Limitations.}} ' || {_escaped_sql("limitations")} END, '\newpage') AS section
    FROM (SELECT *, {_escaped_sql("title")} AS escaped_title
          FROM (SELECT row_id, title, 'Author & Co ' || row_id AS authors, '1997' AS year, 'EMPIRICAL' AS paper_type, benchmark_task AS context, methodology AS method, effect_size AS results, notes AS golden_quote,
                       model_variant AS prior_work, CASE WHEN row_id % 3 = 0 THEN 'y = $x_1$' END AS key_equations, CASE WHEN row_id % 2 = 0 THEN '$x_1$ & 5%' END AS notation, training_compute AS limitations FROM matrix))""")
def report_sections(spark, folder):
    n = F.col("row_id")
    rows = table(spark, folder, "matrix").select(
        "row_id", "title", F.concat(F.lit("Author & Co "), n.cast("string")).alias("authors"), F.lit("1997").alias("year"), F.lit("EMPIRICAL").alias("paper_type"), F.col("benchmark_task").alias("context"),
        F.col("methodology").alias("method"), F.col("effect_size").alias("results"), F.col("notes").alias("golden_quote"), F.col("model_variant").alias("prior_work"),
        F.when(n % 3 == 0, F.lit("y = $x_1$")).alias("key_equations"), F.when(n % 2 == 0, F.lit("$x_1$ & 5%")).alias("notation"), F.col("training_compute").alias("limitations"),
    )
    return rows.select("row_id", reports.paper_section(rows.columns).alias("section"))


@query("WITH " + views.ASSIGNMENTS_SQL + rf"""
    SELECT paper_id, c_nationkey, ordinal,
           CASE WHEN lag(category) OVER w IS DISTINCT FROM category THEN '\rowcolor{{categoryblue}}' || chr(10) || '\multicolumn{{4}}{{|l|}}{{\textbf{{\textcolor{{headerblue}}{{' || {_escaped_sql("category")} || '}}}}}} \\' || chr(10) || '\hline' || chr(10) ELSE '' END ||
           CASE WHEN ordinal % 2 = 1 THEN '\rowcolor{{rowgray}}' || chr(10) ELSE '' END || '\textbf{{Author \& Co ' || paper_id || '}} (1997) says 50\% more &' || chr(10) || 'a\_b &' || chr(10) || '$x_1$ \& 5\% &' || chr(10) || '\$5 \& up \\' || chr(10) || '\hline' AS row
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY category_order, paper_order, paper_id) AS INTEGER) AS ordinal FROM assigned)
    WINDOW w AS (PARTITION BY c_nationkey ORDER BY ordinal)""")
def appendix_rows(spark, folder):
    headed = categories.headings(categories.assign(*views.assignments(spark, folder)), "paper_id", "c_nationkey")
    rows = headed.withColumns({"authors": F.concat(F.lit("Author & Co "), F.col("paper_id").cast("string")), "year": F.lit("1997"), "condensed_says": F.lit("50% more"), "condensed_theory_data": F.lit("a_b"), "condensed_estimation": F.lit("$x_1$ & 5%"), "condensed_result": F.lit("$5 & up")})
    return rows.select("paper_id", "c_nationkey", "ordinal", reports.appendix_row().alias("row"))


@query()
def chapter_fold(spark, folder):
    pages = views.pages(spark, folder)
    return models.fold(chapters.texts(pages, chapters.detect(pages)), models.EchoClient)


_PLAN_LEAD_SQL = prompts.PLAN_LEAD.replace("'", "''")


@query("WITH " + views.PAPERS_SQL + rf"""
    SELECT paper_id, CASE WHEN prompt IS NOT NULL THEN left(list_extract(string_split(regexp_replace(prompt, '[\s\x0b\x1c-\x1f\x85\p{{Z}}]+$', ''), chr(10)), -1), 60) END AS main_thesis, left(sha256(prompt), 12) AS prompt_hash, NULL AS error
    FROM (SELECT paper_id, '{_PLAN_LEAD_SQL}' || left(content, {prompts.PLAN_PREFIX}) AS prompt FROM papers)""")
def model_answers(spark, folder):
    rows = views.papers(spark, folder).select("paper_id", prompts.plan_prompt("content").alias("prompt"))
    answered = models.call(rows, "prompt", models.EchoClient)
    return models.parsed(answered, "answer", "main_thesis string, prompt_hash string, key_terms array<string>", "read").select("paper_id", "read.main_thesis", "read.prompt_hash", "error")


# Smaller operators.


@query("""
    SELECT CAST(sum(CASE WHEN s IN ('ingested', 'extracted') THEN 1 ELSE 0 END) AS BIGINT) AS done, CAST(sum(CASE WHEN s IN ('failed', 'error') THEN 1 ELSE 0 END) AS BIGINT) AS failed
    FROM (SELECT coalesce(nullif(lower(trim(status)), ''), 'pending') AS s FROM inventory)""")
def inventory_tallies(spark, folder):
    return inventory.tallies(table(spark, folder, "inventory").withColumn("status", inventory.clean_status("status")))


@query("""
    WITH chosen AS (SELECT id, max(review) AS review FROM inventory WHERE coalesce(nullif(lower(trim(status)), ''), 'pending') = 'extracted' AND id IS NOT NULL GROUP BY id),
    texts AS (SELECT paper_id AS id, arg_max(markdown, result_id) AS markdown FROM ingest_results WHERE markdown IS NOT NULL AND paper_id IS NOT NULL GROUP BY 1),
    parts AS (SELECT paper_id AS id, CAST(sum(len(tables)) AS BIGINT) AS n_tables FROM ingest_results WHERE len(tables) > 0 AND paper_id IS NOT NULL GROUP BY 1)
    SELECT id, review, markdown, CAST(coalesce(n_tables, 0) AS BIGINT) AS n_tables, CAST(0 AS INTEGER) AS n_figures FROM chosen JOIN texts USING (id) LEFT JOIN parts USING (id)""")
def papers_with_parts(spark, folder):
    clean = table(spark, folder, "inventory").withColumn("status", inventory.clean_status("status")).where("id is not null")
    chosen = inventory.with_status(clean, "extracted").groupBy("id").agg(F.max("review").alias("review"))
    ingested = table(spark, folder, "ingest_results").where("paper_id is not null").withColumnRenamed("paper_id", "id")
    texts = ingested.where("markdown is not null").groupBy("id").agg(F.max_by("markdown", "result_id").alias("markdown"))
    parts = ingested.where("size(tables) > 0").groupBy("id").agg(F.array(F.sum(F.size("tables"))).alias("tables"))
    none = parts.limit(0).withColumnRenamed("tables", "figures")
    found = documents.with_parts(chosen, texts, parts, none)
    return found.select("id", "review", "markdown", F.coalesce(F.get("tables", F.lit(0)), F.lit(0)).cast("bigint").alias("n_tables"), F.size("figures").alias("n_figures"))


@query(r"""
    SELECT result_id, coalesce(nullif(title, ''), CASE WHEN starts_with(line, '#') THEN regexp_replace(regexp_replace(regexp_replace(line, '^#+', ''), '^[\s\x0b\x1c-\x1f\x85\p{Z}]+', ''), '[\s\x0b\x1c-\x1f\x85\p{Z}]+$', '') END) AS document_title,
           coalesce(nullif(regexp_replace(regexp_replace(left(line, 100), '^[\s\x0b\x1c-\x1f\x85\p{Z}]+', ''), '[\s\x0b\x1c-\x1f\x85\p{Z}]+$', ''), ''), 'text ' || result_id) AS book_title
    FROM (SELECT *, split_part(markdown, chr(10), 1) AS line FROM ingest_results)""")
def document_titles(spark, folder):
    rows = table(spark, folder, "ingest_results")
    return rows.select("result_id", text.document_title("title", "markdown").alias("document_title"), text.book_title("markdown", F.concat(F.lit("text "), F.col("result_id").cast("string"))).alias("book_title"))


@query(r"""
    SELECT row_id, lpad(CAST(row_id % 100 AS VARCHAR), 2, '0') || '_' || regexp_replace(left(replace(lower(title), ' ', '_'), 40), '[<>:"|?*/\\]', '_', 'g') || '.txt' AS filename FROM matrix""")
def chapter_filenames(spark, folder):
    return table(spark, folder, "matrix").select("row_id", identifiers.chapter_filename(F.col("row_id") % 100, "title").alias("filename"))


_CUT_200_SQL = "CASE WHEN length(thesis) <= 205 THEN thesis ELSE CASE WHEN contains(left(thesis, 197), ' ') THEN left(thesis, 197 - strpos(reverse(left(thesis, 197)), ' ')) ELSE left(thesis, 197) END || '...' END"


@query(rf"""
    SELECT row_id, '\noindent\textbf{{' || number || '. ' || {_escaped_sql("title")} || '}} \hfill \textit{{p.\,' || (number + 2) || '}}\\' || chr(10) || '{{\small ' || {_CUT_200_SQL} || '}}' AS line, array_to_string([benchmark_task, methodology, model_variant], ', ') AS key_terms
    FROM (SELECT *, row_id % 40 + 1 AS number, {_escaped_sql("notes || ' ' || title || ' ' || methodology || ' ' || title || ' ' || title")} AS thesis FROM matrix)""")
def contents_lines(spark, folder):
    rows = table(spark, folder, "matrix").withColumns({"number": F.col("row_id") % 40 + 1, "ordinal": F.col("row_id") % 40 + 1})
    thesis = F.concat("notes", F.lit(" "), "title", F.lit(" "), "methodology", F.lit(" "), "title", F.lit(" "), "title")
    return rows.withColumn("main_thesis", thesis).select("row_id", reports.contents_line().alias("line"), F.array_join(F.array("benchmark_task", "methodology", "model_variant"), ", ").alias("key_terms"))


# The library.


def _format_sql(path: str) -> str:
    return "CASE " + " ".join(f"WHEN ends_with(lower({path}), '{suffix}') THEN '{name}'" for suffix, name in library.FORMATS.items()) + " ELSE 'text' END"


@query(f"SELECT DISTINCT markdown_path, tables_path, {_format_sql('markdown_path')} AS markdown_format, CASE WHEN review = 'csv' THEN 'csv' ELSE {_format_sql('tables_path')} END AS tables_format FROM inventory")
def output_formats(spark, folder):
    paths = table(spark, folder, "inventory").select("markdown_path", "tables_path", library.output_format("markdown_path").alias("markdown_format"), library.output_format("tables_path", F.when(F.col("review") == "csv", F.lit("csv"))).alias("tables_format"))
    return paths.distinct()


@query("WITH " + views.IDENTIFIERS_SQL + r"""
    SELECT id, CASE WHEN regexp_matches(line, '^[A-Za-z]+:.+$') THEN lower(regexp_extract(line, '^([A-Za-z]+):(.+)$', 1)) END AS source,
           CASE WHEN regexp_matches(line, '^[A-Za-z]+:.+$') THEN trim(regexp_extract(line, '^([A-Za-z]+):(.+)$', 2)) ELSE line END AS identifier
    FROM (SELECT id, trim(CASE id % 5 WHEN 0 THEN '# ' || identifier WHEN 1 THEN '  ' WHEN 2 THEN ' ' || identifier || ' ' ELSE identifier END) AS line FROM identifiers)
    WHERE line <> '' AND NOT starts_with(line, '#')""")
def batch_manifest(spark, folder):
    turn = F.col("id") % 5
    line = F.when(turn == 0, F.concat(F.lit("# "), "identifier")).when(turn == 1, F.lit("  ")).when(turn == 2, F.concat(F.lit(" "), "identifier", F.lit(" "))).otherwise(F.col("identifier"))
    return library.manifest(views.identifiers(spark, folder).select("id", line.alias("line"))).select("id", "source", "identifier")


_ABSTRACT_SQL = r"""nullif(regexp_replace(regexp_extract(text, '(?is)(?:^|\n)[ \t#*]*abstract[ \t*:.]*\n(.*?)(?:\n[ \t]*(?:#{1,6}[ \t]|(?:\d+\.?[ \t]+)?introduction[ \t]*\n)|\z)', 1), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'), '')"""


@query(rf"""
    SELECT doc_id, abstract, CAST(len(list_filter(regexp_split_to_array(abstract, '[ \t\n\r\f\x0b]+'), lambda w: w <> '')) AS INTEGER) AS words
    FROM (SELECT doc_id, {_ABSTRACT_SQL} AS abstract FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Title' || chr(10) || '## Abstract' || chr(10) || text WHEN 1 THEN 'ABSTRACT:' || chr(10) || text || chr(10) || '1. Introduction' || chr(10) || 'more' ELSE text END AS text FROM documents))""")
def abstracts(spark, folder):
    turn, body = F.col("doc_id") % 3, F.col("text")
    spliced = F.when(turn == 0, F.concat(F.lit("Title\n## Abstract\n"), body)).when(turn == 1, F.concat(F.lit("ABSTRACT:\n"), body, F.lit("\n1. Introduction\nmore"))).otherwise(body)
    found = table(spark, folder, "documents").select("doc_id", library.abstract(spliced).alias("abstract"))
    return found.select("doc_id", "abstract", F.when(F.col("abstract").isNotNull(), text.word_count("abstract")).alias("words"))


@query(r"""
    WITH lines AS (SELECT result_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM (SELECT result_id, string_split(markdown, chr(10)) AS parts FROM ingest_results WHERE length(markdown) > 0)),
    placed AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY result_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM lines),
    heads AS (SELECT result_id, begins, trim(regexp_replace(line, '^#{1,6}[ \t]+', '')) AS title FROM placed WHERE regexp_matches(line, '^#{1,6}[ \t]+\S')),
    parts AS (SELECT result_id, start, substr(markdown, start + 1, 2000) AS chunk FROM (SELECT result_id, markdown, CAST(unnest(CASE WHEN length(markdown) <= 2000 THEN [0] ELSE range(0, length(markdown) - 200, 1800) END) AS INTEGER) AS start FROM ingest_results WHERE length(markdown) > 0)),
    held AS (SELECT p.result_id, p.start, arg_max(h.title, h.begins) AS section FROM parts p JOIN heads h ON h.result_id = p.result_id AND h.begins <= p.start GROUP BY 1, 2)
    SELECT p.result_id, p.start, CAST(p.start + length(chunk) AS INTEGER) AS "end", section, chunk,
           array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(chunk, '(?i)(?:^|[^A-Za-z0-9_])((?:figure|table)[ \t]\d{1,3})(?:[^0-9]|$)', 1), lambda m: lower(replace(m, chr(9), ' '))))), ',') AS mentions
    FROM parts p LEFT JOIN held h ON h.result_id = p.result_id AND h.start = p.start""")
def annotated_chunks(spark, folder):
    found = library.annotated_chunks(table(spark, folder, "ingest_results"), "result_id", "markdown", 2000, 200)
    return found.select("result_id", "start", "end", "section", "chunk", F.array_join("mentions", ",").alias("mentions"))


@query(r"""
    SELECT result_id, CAST(len(string_split(text, chr(12))) AS INTEGER) AS pages, CAST(words AS INTEGER) AS words, CAST(ceil(words / 250.0) AS INTEGER) AS minutes, CAST(len(list_filter(lines, lambda x: regexp_matches(x, '^#{1,6}[ \t]+\S'))) AS INTEGER) AS headings,
           CAST(coalesce(len(tables), 0) AS INTEGER) AS tables, CAST(coalesce(len(figures), 0) AS INTEGER) AS figures, CAST(len(list_filter(lines, lambda x: regexp_matches(x, '\((19|20)\d\d[a-z]?\)\. '))) AS INTEGER) AS "references"
    FROM (SELECT *, string_split(text, chr(10)) AS lines, len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0b]+'), lambda w: w <> '')) AS words FROM (SELECT result_id, tables, figures, coalesce(markdown, '') AS text FROM ingest_results))""")
def document_facts(spark, folder):
    return library.facts(table(spark, folder, "ingest_results"), "result_id", "markdown")


@query("""
    SELECT row_id, authors, title, year FROM (SELECT row_id, 'Author ' || model_variant AS authors, title, CAST(year(extracted_at) AS INTEGER) AS year FROM matrix)
    WHERE contains(lower(authors), 'author') AND contains(lower(title), 'evidence') AND year BETWEEN 2000 AND 2100 ORDER BY year DESC NULLS LAST, row_id LIMIT 50""")
def paper_search(spark, folder):
    papers = table(spark, folder, "matrix").select("row_id", F.concat(F.lit("Author "), "model_variant").alias("authors"), "title", F.year("extracted_at").alias("year"))
    return library.search(papers, "Author", "EVIDENCE", (2000, 2100), 50, "row_id")


WORKS_SQL = REFERENCES_READ_SQL + """
    , works AS (SELECT *, coalesce('doi:' || lower(doi), trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || '|' || coalesce(CAST(year AS VARCHAR), '')) AS work FROM reads)
"""


def _works(spark, folder) -> DataFrame:
    read = views.reference_lines(spark, folder).withColumn("p", references.parsed("reference")).select("result_id", "position", "p.title", "p.year", "p.doi")
    return read.withColumn("work", library.work_key("doi", "title", "year"))


@query("WITH " + WORKS_SQL + """
    SELECT work, result_id, position, doi, title, year, copies FROM (SELECT *, row_number() OVER (PARTITION BY work ORDER BY result_id, position) AS n, count(*) OVER (PARTITION BY work) AS copies FROM works WHERE work IS NOT NULL) WHERE n = 1""")
def merged_bibliography(spark, folder):
    return library.merged_bibliography(_works(spark, folder), ["result_id", "position"]).select("work", "result_id", "position", "doi", "title", "year", "copies")


@query("WITH " + WORKS_SQL + """
    , edges AS (SELECT result_id, work, count(*) AS times FROM works WHERE work IS NOT NULL GROUP BY 1, 2)
    SELECT result_id, e.work, times, cited_by FROM edges e JOIN (SELECT work, count(*) AS cited_by FROM edges GROUP BY 1) n ON n.work = e.work""")
def citation_graph(spark, folder):
    edges, nodes = library.citations(_works(spark, folder), "result_id")
    return edges.join(nodes, "work").select("result_id", "work", "times", "cited_by")


@query("WITH " + REFERENCES_READ_SQL + r"""
    SELECT result_id, position, concat_ws(chr(10), 'TY  - ' || CASE WHEN journal IS NOT NULL THEN 'JOUR' ELSE 'GEN' END, CASE WHEN authors <> '' THEN 'AU  - ' || replace(authors, ' and ', chr(10) || 'AU  - ') END, 'TI  - ' || title, 'PY  - ' || year, 'JO  - ' || journal,
        'SP  - ' || regexp_extract(pages, '^(\d+)', 1), 'EP  - ' || regexp_extract(pages, '(\d+)$', 1), 'DO  - ' || doi, 'ER  - ') AS entry FROM reads""")
def ris_entries(spark, folder):
    r = views.reference_lines(spark, folder).withColumn("p", references.parsed("reference"))
    kind = F.when(F.col("p.journal").isNotNull(), F.lit("JOUR")).otherwise(F.lit("GEN"))
    entry = library.ris(kind, F.col("p.authors"), F.col("p.title"), F.col("p.year"), F.col("p.journal"), F.col("p.pages"), F.col("p.doi"))
    return r.select("result_id", "position", entry.alias("entry"))
