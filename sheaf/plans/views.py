"""Views that give the tables the shapes the operators are for, in Spark and in SQL.

Documents are spliced with front matter by doc_id, so that every layout that the metadata rules know
occurs; paragraphs of an ingested text become the pages of a book, some with chapter headings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.session import table

NAMES = ["Joshua Angrist and Victor Lavy", "David Card, Alan Krueger", "Amy Finkelstein", "Janet Currie and Rebecca Dahl"]

PAPERS_SQL = """
    papers AS (
        SELECT doc_id AS paper_id, text, flat,
               CASE doc_id % 6
                    WHEN 0 THEN text
                    WHEN 1 THEN '## ' || left(flat, 60) || chr(10) || name || chr(10) || 'Working Paper No. ' || doc_id || ', January ' || (1975 + doc_id % 60) || chr(10) || text
                    WHEN 2 THEN left(flat, 50) || ' David Card and Alan Krueger NBER Working Paper No. 5888 January 1997' || chr(10) || text
                    WHEN 3 THEN '## NBER WORKING PAPER SERIES' || chr(10) || '## ' || left(flat, 60) || chr(10) || chr(10) || name || chr(10) || 'January ' || (1975 + doc_id % 60) || chr(10) || text
                    WHEN 4 THEN repeat('/G31', 150) || text
                    ELSE '# ' || text
               END AS content
        FROM (SELECT doc_id, text, replace(replace(text, chr(13), ' '), chr(10), ' ') AS flat,
                     CASE doc_id % 4 WHEN 0 THEN 'Joshua Angrist and Victor Lavy' WHEN 1 THEN 'David Card, Alan Krueger' WHEN 2 THEN 'Amy Finkelstein' ELSE 'Janet Currie and Rebecca Dahl' END AS name
              FROM documents)
    )
"""


def papers(spark: SparkSession, folder: str) -> DataFrame:
    """paper_id, text, flat, content."""
    text = F.col("text")
    flat = F.replace(F.replace(text, F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % 4 + 1).cast("int"))
    year = (F.lit(1975) + F.col("doc_id") % 60).cast("string")
    n = F.col("doc_id").cast("string")
    content = (
        F.when(F.col("doc_id") % 6 == 0, text)
        .when(F.col("doc_id") % 6 == 1, F.concat(F.lit("## "), F.left(flat, F.lit(60)), F.lit("\n"), name, F.lit("\nWorking Paper No. "), n, F.lit(", January "), year, F.lit("\n"), text))
        .when(F.col("doc_id") % 6 == 2, F.concat(F.left(flat, F.lit(50)), F.lit(" David Card and Alan Krueger NBER Working Paper No. 5888 January 1997\n"), text))
        .when(F.col("doc_id") % 6 == 3, F.concat(F.lit("## NBER WORKING PAPER SERIES\n## "), F.left(flat, F.lit(60)), F.lit("\n\n"), name, F.lit("\nJanuary "), year, F.lit("\n"), text))
        .when(F.col("doc_id") % 6 == 4, F.concat(F.lit("/G31" * 150), text))
        .otherwise(F.concat(F.lit("# "), text))
    )
    return table(spark, folder, "documents").select(F.col("doc_id").alias("paper_id"), "text", flat.alias("flat"), content.alias("content"))


PAGES_SQL = """
    pages AS (
        SELECT book_id, page_no,
               CASE page_no % 9
                    WHEN 2 THEN page_no || chr(10) || 'Methods, Data and Results' || chr(10) || text
                    WHEN 5 THEN 'Chapter ' || page_no || ': The Long Run of ' || book_id || chr(10) || text
                    WHEN 7 THEN page_no || chr(10) || 'Part Two' || chr(10) || text
                    ELSE text
               END AS text
        FROM (SELECT result_id AS book_id, unnest(parts) AS text, CAST(unnest(range(1, len(parts) + 1)) AS INTEGER) AS page_no
              FROM (SELECT result_id, string_split(markdown, chr(10) || chr(10)) AS parts FROM ingest_results WHERE markdown IS NOT NULL))
    )
"""


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """book_id, page_no, text: the paragraphs of an ingested text as the pages of a book. Their numbers come from the
    text, so books are no larger than texts and no window numbers them."""
    numbered = table(spark, folder, "ingest_results").where("markdown is not null").select(F.col("result_id").alias("book_id"), F.posexplode(F.split("markdown", "\n\n")).alias("at", "body")).withColumn("page_no", F.col("at") + 1)
    n, body = F.col("page_no").cast("string"), F.col("body")
    text = (
        F.when(F.col("page_no") % 9 == 2, F.concat(n, F.lit("\nMethods, Data and Results\n"), body))
        .when(F.col("page_no") % 9 == 5, F.concat(F.lit("Chapter "), n, F.lit(": The Long Run of "), F.col("book_id").cast("string"), F.lit("\n"), body))
        .when(F.col("page_no") % 9 == 7, F.concat(n, F.lit("\nPart Two\n"), body))
        .otherwise(body)
    )
    return numbered.select("book_id", "page_no", text.alias("text"))


ASSIGNMENTS_SQL = """
    assignments AS (
        SELECT c_custkey AS paper_id, r_name AS category, CAST(c_custkey % 5 AS INTEGER) AS paper_order, 1 AS ordinal
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 7 <> 0
        UNION ALL SELECT c_custkey, 'EUROPE', 0, 2 FROM customer WHERE c_custkey % 10 = 3
    ),
    categories AS (
        SELECT r_name AS name, r_regionkey + 1 AS category_order FROM region WHERE r_name <> 'ASIA'
        UNION ALL SELECT 'EUROPE', 9
    ),
    assigned AS (
        SELECT c_custkey AS paper_id, c_nationkey, coalesce(a.category, 'Uncategorized') AS category, coalesce(a.paper_order, 99) AS paper_order, coalesce(c.category_order, 99) AS category_order
        FROM customer
        LEFT JOIN (SELECT paper_id, arg_max(category, ordinal) AS category, arg_max(paper_order, ordinal) AS paper_order FROM assignments GROUP BY paper_id) a ON a.paper_id = c_custkey
        LEFT JOIN (SELECT name, min(category_order) AS category_order FROM categories GROUP BY name) c ON c.name = coalesce(a.category, 'Uncategorized')
    )
"""


def assignments(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """papers, assignments and categories out of customers, nations and regions."""
    customer, nation, region = (table(spark, folder, t) for t in ("customer", "nation", "region"))
    placed = customer.where("c_custkey % 7 <> 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    first = placed.select(F.col("c_custkey").alias("paper_id"), F.col("r_name").alias("category"), (F.col("c_custkey") % 5).cast("int").alias("paper_order"), F.lit(1).alias("ordinal"))
    again = customer.where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("paper_id"), F.lit("EUROPE").alias("category"), F.lit(0).alias("paper_order"), F.lit(2).alias("ordinal"))
    groups = region.where("r_name <> 'ASIA'").select(F.col("r_name").alias("name"), (F.col("r_regionkey") + 1).alias("category_order"))
    more = spark.createDataFrame([("EUROPE", 9)], "name string, category_order int")
    return customer.select(F.col("c_custkey").alias("paper_id"), "c_nationkey"), first.unionByName(again), groups.unionByName(more)


IDENTIFIERS_SQL = """
    identifiers AS (
        SELECT o_orderkey AS id,
               CASE o_orderkey % 9
                    WHEN 0 THEN 'arXiv:' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || '.' || lpad(CAST(o_custkey % 100000 AS VARCHAR), 5, '0') || 'v2'
                    WHEN 1 THEN 'https://doi.org/10.1257/aer.' || o_orderkey
                    WHEN 2 THEN 'doi:10.1234/x' || o_custkey
                    WHEN 3 THEN 'SSRN-id' || (1000000 + o_orderkey % 9000000)
                    WHEN 4 THEN 'nber:w' || (10000 + o_orderkey % 90000)
                    WHEN 5 THEN 'https://example.com/files/Paper_' || o_orderkey || '.pdf?x=1'
                    WHEN 6 THEN 'https://example.com/download/' || o_orderkey
                    WHEN 7 THEN 'ftp://example.com/..%2F' || o_orderkey || '<a>:b.pdf'
                    ELSE 'hep-th/' || lpad(CAST(o_orderkey % 10000000 AS VARCHAR), 7, '0')
               END AS identifier
        FROM orders
    )
"""


def identifiers(spark: SparkSession, folder: str) -> DataFrame:
    """id, identifier."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda c: c.cast("string")
    cases = [
        F.concat(F.lit("arXiv:"), F.lpad(s(key % 10000), 4, "0"), F.lit("."), F.lpad(s(cust % 100000), 5, "0"), F.lit("v2")),
        F.concat(F.lit("https://doi.org/10.1257/aer."), s(key)),
        F.concat(F.lit("doi:10.1234/x"), s(cust)),
        F.concat(F.lit("SSRN-id"), s(1000000 + key % 9000000)),
        F.concat(F.lit("nber:w"), s(10000 + key % 90000)),
        F.concat(F.lit("https://example.com/files/Paper_"), s(key), F.lit(".pdf?x=1")),
        F.concat(F.lit("https://example.com/download/"), s(key)),
        F.concat(F.lit("ftp://example.com/..%2F"), s(key), F.lit("<a>:b.pdf")),
        F.concat(F.lit("hep-th/"), F.lpad(s(key % 10000000), 7, "0")),
    ]
    out = F
    for n, case in enumerate(cases):
        out = out.when(key % 9 == n, case)
    return table(spark, folder, "orders").select(key.alias("id"), out.alias("identifier"))


REFERENCES_SQL = r"""
    reference_lines AS (
        SELECT result_id, position,
               CASE (result_id + position) % 4
                    WHEN 0 THEN line || ' doi:10.1257/aer.' || result_id || '.' || position || '.'
                    WHEN 1 THEN regexp_replace(line, '^(.*\((?:19|20)\d\d[a-z]?\)\. [^.?!]+[.?!]).*$', '\1')
                    ELSE line
               END AS reference
        FROM (SELECT result_id, position, trim(line) AS line
              FROM (SELECT result_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS position
                    FROM (SELECT result_id, string_split(markdown, chr(10)) AS lines FROM ingest_results WHERE markdown IS NOT NULL)))
        WHERE regexp_matches(line, '\((19|20)\d\d[a-z]?\)\. ')
    )
"""


def reference_lines(spark: SparkSession, folder: str) -> DataFrame:
    """result_id, position, reference: the lines of ingested texts with a year as in a list of references; a quarter of
    them with a DOI, a quarter without journal and pages, so that all kinds of entries occur."""
    lines = table(spark, folder, "ingest_results").where("markdown is not null").select("result_id", F.posexplode(F.split("markdown", "\n")).alias("at", "line"))
    cited = lines.select("result_id", (F.col("at") + 1).alias("position"), F.trim("line").alias("line")).where(F.col("line").rlike(r"\((19|20)\d\d[a-z]?\)\. "))
    turn = (F.col("result_id") + F.col("position")) % 4
    reference = (
        F.when(turn == 0, F.concat("line", F.lit(" doi:10.1257/aer."), F.col("result_id").cast("string"), F.lit("."), F.col("position").cast("string"), F.lit(".")))
        .when(turn == 1, F.regexp_replace("line", r"^(.*\((?:19|20)\d\d[a-z]?\)\. [^.?!]+[.?!]).*$", "$1"))
        .otherwise(F.col("line"))
    )
    return cited.select("result_id", "position", reference.alias("reference"))
