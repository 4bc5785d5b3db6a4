"""Oversized texts cut into overlapping pieces by content-defined landmarks.

A rolling hash over the last 32 characters marks landmarks wherever its low bits are zero, so where they
fall depends on the text near them alone. Each cut is taken at the first landmark behind the minimum
size and snapped to a natural boundary near it (heading, paragraph, line, sentence, word, in this
order). An edit therefore moves the cuts next to it and no others. Without any boundary in reach the
cut is hard.

Null and empty texts have no pieces; a text within the limit is one piece. Characters are code points.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.session import batched

LIMIT = 6000
OVERLAP = 300
#: Least new text of a piece that a landmark may end, and how far a landmark looks for a boundary.
LEAST, REACH = 2400, 700
#: A landmark every 1,024 characters on average.
MASK = np.uint32(0x3FF << 12)
WINDOW = 32

#: Kinds of boundary by strength; each match ends where the next piece would begin.
BOUNDARIES = [
    ("heading", re.compile(r"(?:^|(?<=\n)|(?<=\r))(?=#{1,6}[ \t])")),
    ("paragraph", re.compile(r"(?:\r\n|\n|\r)(?:[ \t\f]*(?:\r\n|\n|\r))+|\f")),
    ("line", re.compile(r"\r\n|\n|\r")),
    ("sentence", re.compile(r"[.!?…。！？][\"'”’»)\]]*[ \t]+")),
    ("word", re.compile(r"[ \t\f]+")),
]
BLANKS = re.compile(r"[ \t\n\r\f]")


def landmarks(text: str) -> np.ndarray:
    """Positions at which the rolling hash of the WINDOW characters before them has zero low bits."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    rolled = (points ^ np.uint32(0x9E3779B9)) * np.uint32(0x85EBCA6B)
    rolled ^= rolled >> np.uint32(13)
    rolled *= np.uint32(0xC2B2AE35)
    width = 1
    while width < WINDOW:
        # The hash of twice the width: the later half, and the earlier one shifted by the width.
        doubled = rolled.copy()
        doubled[width:] += rolled[:-width] << np.uint32(width % 31)
        rolled, width = doubled, width * 2
    return np.flatnonzero((rolled & MASK) == 0) + 1


def cuts(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the new text of each piece; kind says where the piece ends, 'end' for the last.

    A piece's text begins ``overlap`` characters before its start (the first piece's doesn't).
    """
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("the limit must be positive and the overlap less than it")
    if not text:
        return []
    size = len(text)
    if size <= limit:
        return [(0, size, "end")]
    least, reach = min(LEAST, (limit - overlap) // 2), min(REACH, limit // 4)
    marks = landmarks(text)
    bounds = [(kind, np.unique([m.end() for m in pattern.finditer(text)]).astype(np.int64)) for kind, pattern in BOUNDARIES]
    out, start = [], 0
    while True:
        held = overlap if out else 0
        most = limit - held
        if size - start <= most:
            out.append((start, size, "end"))
            return out
        low, high = start + least, start + most
        at = int(np.searchsorted(marks, low))
        mark = int(marks[at]) if at < len(marks) and marks[at] <= high else high
        # Near the landmark, then anywhere in the window, then before it (behind the overlap of the next piece).
        end, kind = high, "hard"
        first = start + (1 if out else max(1, overlap))
        for floor, ceiling in ((max(low, mark - reach), min(high, mark + reach)), (low, high), (first, high)):
            near = [(k, b[np.searchsorted(b, floor) : np.searchsorted(b, ceiling, side="right")]) for k, b in bounds]
            if found := next(((k, b) for k, b in near if len(b)), None):
                kind = found[0]
                end = int(found[1][np.abs(found[1] - mark).argmin()])
                break
        out.append((start, end, kind))
        start = end


@batched("array<struct<start:int,end:int,kind:string>>")
def _cuts(texts: pd.Series) -> pd.Series:
    return texts.map(cuts)


@batched("int")
def _longest_run(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: max(map(len, BLANKS.split(t))))


def split(texts: DataFrame, key: str = "result_id", text: str = "markdown") -> DataFrame:
    """(key, piece_no, start, end, ends_at, piece): the pieces of every text, cut in the JVM at the offsets found.

    Texts within the limit aren't sent to Python.
    """
    named = texts.select(F.col(key), F.col(text).alias("_text")).where("length(_text) > 0")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("_text").alias("end"), F.lit("end").alias("kind")))
    short = named.where(F.length("_text") <= LIMIT).withColumn("_cuts", whole)
    long = named.where(F.length("_text") > LIMIT).withColumn("_cuts", _cuts("_text"))
    pieces = short.unionByName(long).select(key, "_text", F.posexplode("_cuts").alias("_at", "_cut"))
    begin = F.greatest(F.col("_cut.start") - OVERLAP, F.lit(0))
    return pieces.select(
        key, (F.col("_at") + 1).alias("piece_no"), F.col("_cut.start").alias("start"), F.col("_cut.end").alias("end"), F.col("_cut.kind").alias("ends_at"),
        F.substring("_text", begin + 1, F.col("_cut.end") - begin).alias("piece"),
    )


def oversized(texts: DataFrame, key: str = "result_id", text: str = "markdown") -> DataFrame:
    """(key, cut) of the texts that are split: natural, or hard if a stretch without blanks exceeds the limit.

    Beside the hard cuts that such a stretch forces there are those that the overlap forces on stretches
    just under the limit; the check on the text tells them apart.
    """
    long = texts.select(F.col(key), F.col(text).alias("_text")).where(F.length("_text") > LIMIT)
    split_up = long.withColumn("_cuts", _cuts("_text")).where("size(_cuts) > 1")
    forced = F.expr("exists(_cuts, c -> c.kind = 'hard')")
    return split_up.select(key, F.when(F.when(forced, _longest_run("_text") > LIMIT).otherwise(False), "hard").otherwise("natural").alias("cut"))
