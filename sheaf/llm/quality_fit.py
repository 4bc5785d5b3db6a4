"""Fits the profiles of ``quality`` on labelled documents: ``python -m sheaf.llm.quality_fit FOLDER [FILE]``.

The samples are bounded by the parameters below and taken by hash, so the same tables give the same profiles
and a larger table costs no more. Labels may be wrong: a labelled block whose nearest neighbours have
another label is left out.
"""

from __future__ import annotations

import json
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import quality
from sheaf.session import local_session, table

#: Documents with a language, and labelled documents of each kind, that the fit takes at most.
MOST_DOCUMENTS, MOST_LABELLED = 10_000, 1_500
#: Function words of a language: the short words in most of its documents, less the share of labelled lists, tables and junk that hold them.
FUNCTION_WORDS, LONGEST = 60, 5
#: Share of a language's documents, beyond that of the others, which a function word is in.
USUAL = 0.02
#: Documents of a language that the fit needs to know it.
LEAST_DOCUMENTS = 20
#: Profiles by kind, in the order of KINDS: kinds with more forms have more.
PROFILES = (28, 18, 14, 20)
#: Share of a document that a block must be to have its label.
LEAST_SHARE = 0.5
NEIGHBOURS, ROUNDS = 3, 15


def _sampled(rows: DataFrame, most: int, by: str | None = None) -> pd.DataFrame:
    """At most ``most`` rows (of each value of ``by``), by hash."""
    if by is None:
        return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toPandas()
    return pd.concat([_sampled(rows.where(F.col(by) == value), most) for value in quality.KINDS])


def _function_words(texts: pd.DataFrame, others: list[str]) -> dict[str, dict[str, float]]:
    """Language -> function word -> share, out of (language, text); others are texts without running text."""
    held = Counter(w for t in others for w in set(quality._WORD.findall(t.lower())))
    out = {}
    for language, group in texts.groupby("language"):
        if len(group) < LEAST_DOCUMENTS:
            continue
        documents, words = Counter(), Counter()
        for text in group["text"]:
            found = quality._WORD.findall(text.lower())
            documents.update(set(found))
            words.update(found)
        score = {w: n / len(group) - held[w] / max(1, len(others)) for w, n in documents.items() if len(w) <= LONGEST}
        best = sorted((w for w in score if score[w] >= USUAL), key=lambda w: (-score[w], w))[:FUNCTION_WORDS]
        total = sum(words[w] for w in best)
        out[language] = {w: round(words[w] / total, 5) for w in sorted(best, key=lambda w: (-words[w], w))}
    return out


def _centres(rows: np.ndarray, many: int) -> np.ndarray:
    """Mean distributions of clusters by divergence; each new one begins at the row farthest from the others."""
    centres = rows.mean(0)[None]
    apart = quality.divergences(rows, centres)[:, 0]
    while len(centres) < min(many, len(rows)):
        centres = np.vstack([centres, rows[apart.argmax()]])
        apart = np.minimum(apart, quality.divergences(rows, centres[-1:])[:, 0])
    for _ in range(ROUNDS):
        nearest = quality.divergences(rows, centres).argmin(1)
        centres = np.array([rows[nearest == j].mean(0) if (nearest == j).any() else centres[j] for j in range(len(centres))])
    return centres


def fit(documents: DataFrame, labels: DataFrame) -> dict:
    """languages and profiles as ``quality.Profiles`` takes them. documents: doc_id, text, lang; labels: doc_id, label."""
    written = documents.where("text is not null and trim(text) != ''")
    label = labels.where(F.col("label").isin(*quality.KINDS)).groupBy("doc_id").agg(F.min("label").alias("label"))
    labelled = _sampled(written.join(label, "doc_id").select("doc_id", "text", "label"), MOST_LABELLED, "label")
    spoken = written.where("lang is not null").join(label.where("label != 'prose'"), "doc_id", "left_anti")
    languages = _function_words(_sampled(spoken.select("doc_id", "text", F.lower("lang").alias("language")), MOST_DOCUMENTS), list(labelled[labelled["label"] != "prose"]["text"]))
    known = quality.Profiles(languages, [])
    rows, kinds = [], []
    for text, kind in zip(labelled["text"], labelled["label"]):
        found = quality.blocks(text)
        sizes = [sum(map(len, b)) for b in found]
        for block, size in zip(found, sizes):
            if size >= LEAST_SHARE * sum(sizes):
                rows.append(known.distributions(block))
                kinds.append(quality.KINDS.index(kind))
    given, kinds = np.array(rows, dtype=np.float32), np.array(kinds)
    apart = quality.divergences(given, given)
    np.fill_diagonal(apart, np.inf)
    votes = kinds[np.argsort(apart, 1, kind="stable")[:, :NEIGHBOURS]]
    agreed = np.array([np.bincount(v, minlength=len(quality.KINDS)).argmax() for v in votes]) == kinds
    profiles = []
    for k, (kind, many) in enumerate(zip(quality.KINDS, PROFILES)):
        own = given[agreed & (kinds == k)]
        profiles += [{"kind": kind, "shares": [round(float(x), 4) for x in centre]} for centre in (_centres(own, many) if len(own) else [])]
    return {"languages": languages, "profiles": profiles}


def main(folder: str, file: str | None = None, spark: SparkSession | None = None) -> None:
    spark = spark or local_session()
    found = fit(table(spark, folder, "documents"), table(spark, folder, "doc_labels"))
    lines = ",\n".join(json.dumps(p) for p in found["profiles"])
    spoken = ",\n".join(f"{json.dumps(k)}: {json.dumps(v, ensure_ascii=False)}" for k, v in found["languages"].items())
    Path(file or Path(__file__).with_name("quality_profiles.json")).write_text(f'{{"languages": {{\n{spoken}\n}}, "profiles": [\n{lines}\n]}}\n', encoding="utf-8")


if __name__ == "__main__":
    main(*sys.argv[1:])
