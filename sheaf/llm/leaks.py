"""Evaluation items that leak into documents: shared runs of ten words, or whole shorter items.

The hashes of the items' word n-grams form a set of bits that every worker holds, of bounded size however many
items there are; a document's windows of words are looked up in it. The windows that it lets through go to
a join with the items' n-grams, which verifies them word by word and gives their items. Words are runs of
letters and digits of the text after compatibility composition (NFKC) and lower-casing.

Null and empty texts hold no passage; an item without words can't leak. A passage shared by several
items counts for each. Repeated rows of a document give their pairs once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.operators.hashfilter import MOST_BITS, HashFilter, hash_filter, text_hash
from sheaf.session import batched, settle

LENGTH = 10
#: Words whose hash each worker remembers.
REMEMBERED = 500_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

_WORD = re.compile(r"[^\W_]+")
_CHUNK = re.compile(r"\S+")


def words(text: str | None) -> list[str]:
    """The normalised words of a text."""
    return _WORD.findall((text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()) if text else []


def grams(item_words: list[str], length: int = LENGTH) -> set[tuple[str, ...]]:
    """The windows of an item that a document must hold one of: those of ``length`` words, or all its words."""
    n = min(length, len(item_words))
    return {tuple(item_words[i : i + n]) for i in range(len(item_words) - n + 1)} if n else set()


class _Hashes(dict):
    """Word -> hash, made when it is asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        found = self[word] = text_hash(word)
        return found


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of each window of so many words, out of the words' hashes (uint64)."""
    many = len(hashes) - length + 1
    if many <= 0:
        return np.zeros(0, dtype=np.uint64)
    rolled = np.full(many, length, dtype=np.uint64)
    for k in range(length):
        rolled = rolled * _FACTOR + hashes[k : k + many]
    rolled ^= rolled >> np.uint64(29)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    return rolled ^ (rolled >> np.uint64(32))


def item_grams(items: DataFrame) -> DataFrame:
    """(item_id, n, gram, hash): the windows of every item, each once."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"], batch["text"]):
                for gram in grams(words(text)):
                    hashed = window_hashes(np.array([known[w] for w in gram], dtype=np.uint64), len(gram))
                    rows.append((item, len(gram), " ".join(gram), int(hashed.view(np.int64)[0])))
            yield pd.DataFrame(rows, columns=["item_id", "n", "gram", "hash"])

    return items.where("item_id is not null and text is not null").select("item_id", "text").mapInPandas(read, "item_id bigint, n int, gram string, hash bigint")


def _hits(batch_words: list[list[str]], known: _Hashes, lengths: list[int], wanted: HashFilter) -> Iterator[tuple[int, int, int]]:
    """(text, first word, words) of the windows that the filter lets through, texts in order of length, not of place."""
    ends = np.cumsum([len(w) for w in batch_words])
    flat = np.fromiter((known[w] for text in batch_words for w in text), dtype=np.uint64, count=int(ends[-1]) if len(ends) else 0)
    for n in lengths:
        at = np.flatnonzero(wanted.holds(window_hashes(flat, n)))
        owner = np.searchsorted(ends, at, side="right")
        # A window that reaches into the next text is none.
        inside = at + n <= ends[owner]
        for i, place in zip(owner[inside].tolist(), at[inside].tolist()):
            yield i, place - (int(ends[i - 1]) if i else 0), n


def _found(documents: DataFrame, items: DataFrame, most_bits: int) -> tuple[DataFrame, DataFrame]:
    """(windows, wanted): (doc, version, first, n, gram) of the windows of documents that the filter lets through, and the
    items' grams. doc is the doc_id as text, as it may be null; version is a hash of the text: a doc_id may have several."""
    wanted = settle(item_grams(items))
    lengths = [r[0] for r in wanted.select("n").distinct().collect()]
    shared = documents.sparkSession.sparkContext.broadcast(hash_filter(wanted, "hash", most_bits))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for batch in batches:
            texts = [words(t) for t in batch["text"]]
            ids, versions = list(batch["doc"]), list(batch["version"])
            rows = [(ids[i], versions[i], first, n, " ".join(texts[i][first : first + n])) for i, first, n in _hits(texts, known, lengths, shared.value)]
            yield pd.DataFrame(rows, columns=["doc", "version", "first", "n", "gram"]).astype({"version": "int64"})

    texts = documents.where("text is not null").select(F.col("doc_id").cast("string").alias("doc"), F.xxhash64("text").alias("version"), "text")
    return texts.mapInPandas(scan, "doc string, version bigint, first int, n int, gram string"), wanted


def leaks(documents: DataFrame, items: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, item_id) of every document that holds a passage of an item.

    most_bits bounds what is sent to the workers; fewer bits let more windows through to the join, with the
    same result.
    """
    windows, wanted = _found(documents.where("doc_id is not null"), items, most_bits)
    # The windows of a document that are alike are one row before the join.
    return windows.select(F.col("doc").cast("bigint").alias("doc_id"), "gram").dropDuplicates().join(wanted.select("gram", "item_id"), "gram").select("doc_id", "item_id").dropDuplicates()


@batched("string")
def _scrubbed(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([t if s is None or not len(s) else scrub(t, [(x["first"], x["n"]) for x in s]) for t, s in zip(texts, spans)])


def scrub(text: str, found: list[tuple[int, int]]) -> str:
    """The text without the passages given as (first word, words), cut at the white space around them."""
    spans = [chunk.span() for chunk in _CHUNK.finditer(text) for _ in words(chunk[0])]
    keep, at = [], 0
    for first, n in sorted(found):
        start, end = spans[first][0], spans[first + n - 1][1]
        if end > at:
            keep.append(text[at : max(at, start)])
            at = end
    return "".join(keep) + text[at:]


def without_passages(documents: DataFrame, items: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, text, removed): the texts without the passages of items, and how many characters went.

    Every row of documents gives one row. The passages found, verified by the join with the items' grams, are joined to
    the texts; texts without any don't leave the JVM.
    """
    windows, wanted = _found(documents, items, most_bits)
    verified = windows.join(wanted.select("gram").dropDuplicates(), "gram")
    spans = verified.groupBy("doc", "version").agg(F.collect_set(F.struct("first", "n")).alias("_spans"))
    own = F.col("doc_id").cast("string").eqNullSafe(F.col("doc")) & (F.xxhash64("text") == F.col("version"))
    joined = documents.select("doc_id", "text").join(spans, own, "left")
    held = F.col("_spans").isNotNull()
    # Only texts with passages are sent to Python.
    clean = F.when(held, _scrubbed(F.when(held, F.col("text")), "_spans")).otherwise(F.col("text"))
    return joined.select("doc_id", clean.alias("_clean"), "text").select("doc_id", F.col("_clean").alias("text"), (F.length("text") - F.length("_clean")).alias("removed")).select("doc_id", "text", F.coalesce("removed", F.lit(0)).alias("removed"))
