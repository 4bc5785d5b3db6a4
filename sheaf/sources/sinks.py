"""Results written as tables, CSV and JSON, and small documents as files."""

from __future__ import annotations

import json
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop, hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())


def write_table(df: DataFrame, path: str) -> None:
    """A Parquet table in place of what was there.

    It is written beside the old one, which steps aside only then and is deleted last: a write that fails
    leaves the old table, and so does a swap that fails (``read_table`` finds it if even putting it back failed).
    """
    beside, aside = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(beside)
    hadoop, fs = _filesystem(df.sparkSession, path)
    there = fs.exists(hadoop(path))
    if there:
        fs.delete(hadoop(aside), True)
        if not fs.rename(hadoop(path), hadoop(aside)):
            raise OSError(f"{path} can't be replaced")
    if not fs.rename(hadoop(beside), hadoop(path)):
        if there:
            fs.rename(hadoop(aside), hadoop(path))
        raise OSError(f"{beside} can't be moved to {path}")
    fs.delete(hadoop(aside), True)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table of ``write_table``; if there is none at all, no rows of the schema given.

    Any other failure to read raises: a table that can't be read now isn't an empty one. A table left
    aside by a swap that was broken off is put back first.
    """
    hadoop, fs = _filesystem(spark, path)
    if not fs.exists(hadoop(path)) and fs.exists(hadoop(f"{path}.old")):
        fs.rename(hadoop(f"{path}.old"), hadoop(path))
    if schema is not None and not fs.exists(hadoop(path)):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header, quotes doubled and empty text for null, CRLF line ends (within cells too)."""
    text = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns))
    (text.coalesce(1) if one_file else text).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("lineSep", "\r\n").csv(path)


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """One JSON object per line, nulls kept; partitioned by a column if named."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", False)
    (writer.partitionBy(by) if by else writer).json(path)


def write_text_files(df: DataFrame, folder: str, name: str, text: str) -> None:
    """A file per row in a folder that all executors share; names must be safe already."""

    def write(rows) -> None:
        for row in rows:
            target = Path(folder) / row[name]
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(row[text] or "", encoding="utf-8")

    df.select(name, text).foreachPartition(write)


def write_binary_files(df: DataFrame, folder: str, name: str, content: str) -> None:
    """A file of bytes per row (figures, images of equations) in a folder that all executors share; null bytes give none."""

    def write(rows) -> None:
        for row in rows:
            target = Path(folder) / row[name]
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(bytes(row[content]))

    df.where(F.col(content).isNotNull()).select(name, content).foreachPartition(write)


def write_document(path: str, value: object) -> None:
    """A small document of the driver: a str as it is, else JSON with non-ASCII text kept."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    beside = target.with_suffix(target.suffix + ".new")
    beside.write_text(value if isinstance(value, str) else json.dumps(value, indent=2, ensure_ascii=False), encoding="utf-8")
    beside.replace(target)


def write_pieces(df: DataFrame, column: str, path: str, head: str = "", tail: str = "", between: str = "\n\n") -> None:
    """The texts of a sorted table, in order, as one file of the driver; it holds one partition at a time."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    beside = target.with_suffix(target.suffix + ".new")
    with beside.open("w", encoding="utf-8") as out:
        out.write(head)
        for n, row in enumerate(df.select(column).toLocalIterator()):
            out.write((between if n else "") + (row[0] or ""))
        out.write(tail)
    beside.replace(target)


def compile_latex(path: str, seconds: int = 120) -> Path | None:
    """The PDF of a LaTeX file, compiled twice for its contents; None if there is no compiler or it fails."""
    source = Path(path)
    try:
        for _ in range(2):
            subprocess.run(["pdflatex", "-interaction=nonstopmode", source.name], cwd=source.parent, capture_output=True, timeout=seconds, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    for suffix in (".aux", ".log", ".out", ".toc"):
        source.with_suffix(suffix).unlink(missing_ok=True)
    return source.with_suffix(".pdf")
