"""Operations over whole collections of documents: exact copies, sections, samples, joined texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_copies(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, copy_of, copies): every document with the first of those with its text, and how many there are.

    Texts are compared by SHA-256, so only hashes are shuffled; groups are reduced before the join, so a
    text with a third of all rows is no hot group. Null texts are no copies of each other.
    """
    hashed = documents.select(key, F.when(F.col(text).isNotNull(), F.sha2(text, 256)).alias("_hash"))
    groups = hashed.where("_hash is not null").groupBy("_hash").agg(F.min(key).alias("copy_of"), F.count("*").alias("copies"))
    repeated = groups.where("copies > 1")
    joined = hashed.join(repeated, "_hash", "left")
    return joined.select(key, F.coalesce("copy_of", F.col(key)).alias("copy_of"), F.coalesce("copies", F.lit(1)).alias("copies"))


def sections(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_no, level, title, body): a text's parts under Markdown headings; 0 is what stands before the first.

    All within the row: nothing is shuffled, and rows that repeat give their sections again.
    """
    lines = documents.where(F.col(text).isNotNull()).select(key, F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n").alias("_lines"))
    level = lambda line: F.length(F.regexp_extract(line, r"^(#{1,6})[ \t]+\S", 1))
    heads = F.filter(F.transform("_lines", lambda line, i: F.struct(i.alias("at"), level(line).alias("level"))), lambda h: h["level"] > 0)
    # What stands before the first heading is a section if there is a line.
    front = F.filter(F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("level"))), lambda _: ~F.coalesce(F.get("_heads", F.lit(0))["at"] == 0, F.lit(False)))
    starts = lines.withColumn("_heads", heads).select(key, "_lines", (F.size("_heads") > 0).alias("_headed"), F.concat(front, "_heads").alias("_starts"))
    each = starts.select(key, "_lines", "_starts", F.posexplode("_starts").alias("_n", "_s"))
    end = F.coalesce(F.get("_starts", F.col("_n") + 1)["at"], F.size("_lines"))
    number = F.col("_n") + F.when(F.get("_starts", F.lit(0))["at"] < 0, 0).otherwise(1)
    title = F.when(F.col("_s.level") > 0, F.trim(F.regexp_replace(F.get("_lines", F.col("_s.at")), r"^#{1,6}[ \t]+", "")))
    body = F.array_join(F.slice("_lines", F.col("_s.at") + 2, end - F.col("_s.at") - 1), "\n")
    return each.select(key, number.cast("int").alias("section_no"), F.col("_s.level").alias("level"), title.alias("title"), body.alias("body"))


def joined_texts(documents: DataFrame, group: str, order: str, text: str, between: str = "\n\n---\n\n", prefix: int | None = None) -> DataFrame:
    """(group, joined): the texts (or their first characters) of each group in order."""
    piece = F.substring(F.coalesce(F.col(text), F.lit("")), 1, prefix) if prefix else F.coalesce(F.col(text), F.lit(""))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("t")))), lambda x: x["t"])
    return documents.groupBy(group).agg(F.array_join(parts, between).alias("joined"))


def sample(documents: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n random documents; the same ones for the same seed and rows."""
    return documents.orderBy(F.rand(seed) if seed is not None else F.rand()).limit(n)
