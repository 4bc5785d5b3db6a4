"""Documents read from files: a decoder turns bytes into text, tables and figures, row by row in the workers.

A decoder is a function bytes -> Decoded that raises if it can't read the file. Decoders are tried in order;
one whose text is unreadable is kept only if no later one does better, so a missing library never fails a
file that a simpler decoder reads.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.text import document_title, is_unreadable

INGESTED = (
    "id string, filename string, markdown string, tables array<struct<page:int,data:array<map<string,string>>,caption:string>>, "
    "figures array<struct<page:int,image_path:string,caption:string>>, title string, page_count int, engine string, status string, error string"
)


@dataclass
class Decoded:
    markdown: str
    tables: list[dict] = field(default_factory=list)
    figures: list[dict] = field(default_factory=list)
    title: str | None = None
    page_count: int = 0
    #: (level, title, page from 1) of the outline.
    outline: list[tuple[int, str, int | None]] = field(default_factory=list)
    #: Text of each page, empty ones too; none if the decoder knows no pages but those that form feeds part.
    pages: list[str] = field(default_factory=list)


Decoder = Callable[[bytes], Decoded]


def joined_pages(pages: list[str]) -> str:
    """Page texts with a blank line behind each, empty pages left out."""
    return "".join(f"{p}\n\n" for p in pages if p)


def pypdf_decoder(content: bytes) -> Decoded:
    """Page texts and outline through pypdf, if it is installed."""
    import io

    from pypdf import PdfReader

    reader = PdfReader(io.BytesIO(content))
    pages = [p.extract_text() or "" for p in reader.pages]
    outline: list[tuple[int, str, int | None]] = []

    def walk(items: list, level: int) -> None:
        for item in items:
            if isinstance(item, list):
                walk(item, level + 1)
                continue
            try:
                outline.append((level, str(item.title), reader.get_page_number(item.page) + 1))
            except Exception:  # an entry that can't be read is left out
                continue

    walk(reader.outline or [], 0)
    return Decoded(joined_pages(pages), page_count=len(pages), outline=outline, pages=pages)


def text_decoder(content: bytes) -> Decoded:
    """Plain text and Markdown files; form feeds part pages."""
    text = content.decode("utf-8")
    return Decoded(text, page_count=text.count("\f") + 1)


def check_folder(path: str) -> Path:
    folder = Path(path)
    if not folder.exists():
        raise FileNotFoundError(f"{path} doesn't exist")
    if not folder.is_dir():
        raise NotADirectoryError(f"{path} is no folder")
    return folder


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """The files of a folder (not of those in it) whose name has the pattern: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def _decode(content: bytes, decoders: list[tuple[str, Decoder]]) -> tuple[str, Decoded]:
    best, errors = None, []
    for name, decoder in decoders:
        try:
            found = decoder(bytes(content))
        except Exception as e:
            errors.append(f"{name}: {e or type(e).__name__}")
            continue
        sample = found.markdown[:1000]
        marks = sum(sample.count(m) for m in ("/G", "\\x", "\x00", "�"))
        if len(found.markdown) >= 100 and marks <= len(sample) * 0.1:
            return name, found
        best = best or (name, found)
    if best is None:
        raise ValueError("; ".join(errors) or "no decoder")
    return best


def _table(element: dict) -> dict:
    rows = [{str(k): None if v is None else str(v) for k, v in row.items()} for row in element.get("data") or []]
    return {"page": _page(element), "data": rows, "caption": element.get("caption")}


def _figure(element: dict) -> dict:
    return {"page": _page(element), "image_path": str(element.get("image_path") or ""), "caption": element.get("caption")}


def _page(element: dict) -> int | None:
    return None if element.get("page") is None else int(element["page"])


def _elements(found: list, shaped: Callable[[dict], dict]) -> list[dict]:
    """The elements that have the shape of their kind, in order; a malformed one is left out, not the file."""
    out = []
    for element in found or []:
        try:
            out.append(shaped(element))
        except (AttributeError, TypeError, ValueError):
            continue
    return out


def ingest(found: DataFrame, decoders: list[tuple[str, Decoder]]) -> DataFrame:
    """One row per file (see INGESTED). A file that no decoder reads has status failed and the error; the
    others go on. Table and figure elements keep their order, malformed ones are left out; a figure without
    a saved image has path ''. The title is the decoder's, else the first line if that is a heading."""
    rows = found.select("path", "content").withColumn("filename", F.regexp_extract("path", r"([^/]*)$", 1))
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", "filename", "markdown", "tables", "figures", "title", "page_count", "engine", "status", "error"]
        for batch in batches:
            out = []
            for row in batch.itertuples():
                try:
                    engine, d = _decode(row.content, decoders)
                    out.append((row.id, row.filename, d.markdown, _elements(d.tables, _table), _elements(d.figures, _figure), d.title, d.page_count, engine, "ingested", None))
                except Exception as e:
                    out.append((row.id, row.filename, None, None, None, None, None, None, "failed", str(e)))
            yield pd.DataFrame(out, columns=names).astype({"page_count": "Int32"})

    return rows.withColumn("id", stem).mapInPandas(run, INGESTED).withColumn("title", document_title("title", "markdown"))


BOOK = "book_id string, title string, pages array<string>, outline array<struct<level:int,title:string,page_no:int>>, error string"


def books(found: DataFrame, decoders: list[tuple[str, Decoder]]) -> DataFrame:
    """One row per file (see BOOK), each decoded once: all of its pages, empty ones too, and its outline.

    Pages are the decoder's, else what form feeds part. A file that no decoder reads has the error and no
    pages. Write it, or settle it, before ``pages`` and ``outlines`` look at it.
    """
    rows = found.select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                stem = row.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    _, d = _decode(row.content, decoders)
                    outline = [{"level": level, "title": title, "page_no": page} for level, title, page in d.outline]
                    out.append((stem, d.title, d.pages or d.markdown.split("\f"), outline, None))
                except Exception as e:
                    out.append((stem, None, [], [], str(e)))
            yield pd.DataFrame(out, columns=["book_id", "title", "pages", "outline", "error"])

    return rows.mapInPandas(run, BOOK)


def outlines(books: DataFrame) -> DataFrame:
    """(book_id, position, level, title, page_no) of every outline entry."""
    return books.select("book_id", F.posexplode("outline").alias("position", "o")).select("book_id", "position", "o.level", "o.title", "o.page_no")


def pages(books: DataFrame) -> DataFrame:
    """(book_id, page_no, text) of every page."""
    return books.select("book_id", F.posexplode("pages").alias("_at", "text")).select("book_id", (F.col("_at") + 1).alias("page_no"), "text")


def readable(ingested: DataFrame) -> DataFrame:
    """Rows whose markdown a model can read; missing markdown isn't."""
    return ingested.where(F.col("markdown").isNotNull() & ~is_unreadable("markdown"))


def unreadable(ingested: DataFrame) -> DataFrame:
    return ingested.where(F.col("markdown").isNotNull() & is_unreadable("markdown"))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """JSON of one value per file; None if there is none."""
    if not Path(path).exists():
        return None
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """The papers of an extractions file, which is a list of them or an object with the list under ``papers``."""
    found = read_json(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    if "papers" in found.columns:
        return found.select(F.explode("papers").alias("p")).select("p.*")
    return found


def with_parts(inventory: DataFrame, markdown: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """Inventory rows with their markdown (rows without are left out), tables and figures (empty if missing);
    all keyed by id."""
    return (
        inventory.join(markdown, "id").join(tables, "id", "left").join(figures, "id", "left")
        .withColumns({c: F.coalesce(c, F.array().cast(dict(t.dtypes)[c])) for c, t in (("tables", tables), ("figures", figures))})
    )


def read_schema_spec(path: str) -> list[dict]:
    """The declared columns of a YAML or JSON file; ValueError if there are none."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        found = json.loads(text)
    else:
        try:
            import yaml

            found = yaml.safe_load(text)
        except ImportError:
            found = {"columns": _flat_yaml(text)}
    columns = (found or {}).get("columns") if isinstance(found, dict) else found
    if not columns:
        raise ValueError(f"{path} declares no columns")
    return columns


def _flat_yaml(text: str) -> list[dict]:
    """The list of flat mappings that a schema file is, for where no YAML library is installed."""
    columns: list[dict] = []
    for line in text.split("\n"):
        body = line.split(" #")[0].rstrip()
        if body.lstrip().startswith("- "):
            columns.append({})
            body = body.replace("- ", "  ", 1)
        if ":" in body and columns and body.startswith(" "):
            key, value = body.strip().split(":", 1)
            columns[-1][key.strip()] = value.strip().strip("\"'")
    return columns


def as_dict(decoded: Decoded) -> dict:
    return asdict(decoded)
