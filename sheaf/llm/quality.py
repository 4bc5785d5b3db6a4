"""Text quality: counts of each text, and by its structure prose, list, table or junk.

A text is cut into blocks at blank lines; lines that stand alone are read together. Distributions describe
a block: how its characters spread over classes, its tokens over classes, its lines over beginnings, ends
and lengths, how its rows keep to columns, how often tokens repeat, and how near its function words are to
those of the nearest language. Structural profiles are the same distributions of labelled blocks
(``quality_fit`` fits them). A block takes the kind of the profile nearest to it by Jensen-Shannon
divergence, summed over the distributions. A text's kind is that of more than half of its characters,
prose if no other kind has that many.

Null, empty and blank texts have counts of zero (null shares) and no kind. Texts are read whole; repeated
rows give their rows again.
"""

from __future__ import annotations

import functools
import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("prose", "list", "table", "junk")

#: The distributions of a block: name, classes, weight of its divergence in the sum.
GROUPS = (
    ("characters", ("lower", "upper", "digit", "space", "stop", "separator", "sign", "control"), 1.5),
    ("tokens", ("function word", "word", "word without vowels", "letter", "number", "code", "signs", "long"), 1.5),
    ("beginnings", ("mark", "number of an item", "digit", "upper", "lower", "separator", "sign"), 1.0),
    ("ends", ("stop", "digit", "letter", "comma", "separator", "closing", "sign"), 1.0),
    ("lengths", ("1 token", "2-3", "4-6", "7-12", "13-24", "more"), 0.7),
    ("columns", ("in columns", "other cells", "no cells"), 2.0),
    ("variety", ("once", "often", "between"), 2.0),
    ("language", ("like a language's", "unlike"), 1.0),
    ("lines", ("1 line", "2-3", "more"), 0.7),
)
_WEIGHTS = np.concatenate([[weight] * len(classes) for _, classes, weight in GROUPS]).astype(np.float32)

#: Tokens whose class each worker remembers.
REMEMBERED = 200_000

_WORD = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(r"[+\-−–(]?[$€£]?\d[\d.,:/–-]*\)?[%*]*\.?")
_NUMBER_OF_ITEM = re.compile(r"\(?(?:\d{1,4}|[a-zA-Z]|[ivxlcIVXLC]{1,6})[.)]\s|\[\d{1,4}\]\s")
_GAP = re.compile(r"(?<=\S) {3,}(?=\S)")
_TIGHT_COMMA = re.compile(r",(?! )")
_VOWELS = re.compile(r"[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýœаеёиоуыэюя]", re.I)
_LATIN_CYRILLIC = re.compile(r"[A-Za-zÀ-ɏЀ-ӿ]")
_CONTROL = "\ufffd\u25a1\ufffe\uffff"
_ENDED = re.compile(r"[.!?…:;。！？][\"'”’»)\]]*\s*$")
_AROUND = ".,:;!?…'’()“”\"«»¿¡[]{}"
_WITHIN = str.maketrans("", "", "-'’")
_MARKS = "-*+•‣◦·▪–—"
#: Letters of scripts that no language with a profile is written in, and of those among them that don't part words.
_OTHER_SCRIPT = re.compile(r"[\u0370-\u03ff\u0530-\u1cff\u2d00-\u2ddf\u3040-\u9fff\ua000-\ua63f\ua700-\ud7ff\uf900-\ufaff]")
_UNPARTED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")
#: How a language without a profile counts: its function words can't be told, so they are taken to be as usual.
USUAL_SHARE, USUAL_LIKENESS = 0.35, 0.6


def divergence(p: tuple[float, ...], q: tuple[float, ...]) -> float:
    """Jensen-Shannon divergence in bits of two distributions over the same classes."""
    total = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0.0) / 2 + (b * math.log2(b / m) if b else 0.0) / 2
    return max(0.0, total)


def _entropies(p: np.ndarray) -> np.ndarray:
    """The weighted entropies, up to their sign, of rows of distributions."""
    return (p * np.log2(np.maximum(p, 1e-12, dtype=np.float32))) @ _WEIGHTS


def divergences(blocks: np.ndarray, profiles: np.ndarray) -> np.ndarray:
    """Of each block to each profile: the weighted sum of the Jensen-Shannon divergences of their distributions."""
    blocks, profiles = blocks.astype(np.float32), profiles.astype(np.float32)
    own, theirs = _entropies(blocks), _entropies(profiles)
    out = np.empty((len(blocks), len(profiles)), dtype=np.float32)
    for j, profile in enumerate(profiles):
        out[:, j] = (own + theirs[j]) / 2 - _entropies((blocks + profile) / 2)
    return out


def _class_of(char: str) -> int:
    """The place among the classes of characters."""
    if char.isalpha():
        return 1 if char.isupper() else 0
    if char.isdigit():
        return 2
    if char in " \n\r\f\xa0":
        return 3
    if char in ".,:;!?…'’()“”\"«»¿¡–-":
        return 4
    if char in "\t|&":
        return 5
    return 7 if char in _CONTROL or unicodedata.category(char) in ("Cc", "Co", "Cs") else 6


_BYTE_CLASSES = bytes(_class_of(chr(b)) for b in range(256))
_WIDE = re.compile(r"[^\x00-\xff]")


def class_shares(text: str) -> tuple[float, ...]:
    """The share of each class of characters in a text that isn't empty."""
    # Characters up to U+00FF through a byte table, the others one by one.
    narrow = text.encode("latin-1", "ignore").translate(_BYTE_CLASSES)
    seen = [narrow.count(c) for c in range(8)]
    if len(narrow) < len(text):
        for char, n in Counter(_WIDE.findall(text)).items():
            seen[_class_of(char)] += n
    return tuple(n / len(text) for n in seen)


def _shares(counts: list[int]) -> list[float]:
    total = sum(counts)
    return [n / total for n in counts] if total else [1 / len(counts)] * len(counts)


def _beginning(line: str) -> int:
    """The place among the classes of beginnings of a line without white space around it."""
    char = line[0]
    if char in _MARKS and line[1:2].isspace():
        return 0
    if (char.isalnum() or char in "([") and _NUMBER_OF_ITEM.match(line):
        return 1
    if char.isdigit() or char in "+-−–(.$" and line[1:2].isdigit():
        return 2
    if char.isalpha():
        return 3 if char.isupper() else 4
    return 5 if char in "|\"&;,#" else 6


def _end(line: str) -> int:
    char = line[-1]
    if char in ".!?…:;。！？":
        return 0
    if char.isdigit():
        return 1
    if char.isalpha():
        return 2
    return 3 if char in ",-¬" else 4 if char in "|\\&" else 5 if char in ")]%\"'”’»" else 6


def _length(tokens: int) -> int:
    return 0 if tokens <= 1 else 1 if tokens <= 3 else 2 if tokens <= 6 else 3 if tokens <= 12 else 4 if tokens <= 24 else 5


#: What can set cells apart: a test whether a block has it at all, and its number in a line.
_SEPARATORS = (
    ("|", lambda line: line.count("|")), ("\t", lambda line: line.count("\t")), (" & ", lambda line: line.count(" & ")),
    (";", lambda line: line.count(";")), (",", lambda line: len(_TIGHT_COMMA.findall(line)) if "," in line else 0), ("   ", lambda line: len(_GAP.findall(line)) if "   " in line else 0),
)


def _columns(text: str, lines: list[str]) -> tuple[float, float, float]:
    """The shares of a block's characters in rows that keep the same columns, in other rows with cells, in lines without,
    for the separator that keeps most."""
    same, some, total = 0.0, 0.0, sum(map(len, lines))
    if len(lines) > 1:
        for sign, count in _SEPARATORS:
            if sign not in text:
                continue
            many = list(map(count, lines))
            cut = [c for c in many if c]
            if len(cut) < 2:
                continue
            width = Counter(cut).most_common(1)[0][0]
            kept = sum(len(s) for s, c in zip(lines, many) if c and abs(c - width) <= width // 5) / total
            if kept > same:
                same, some = kept, sum(len(s) for s, c in zip(lines, many) if c) / total - kept
    return same, some, 1 - same - some


class Profiles:
    """The languages' function words, and the structural profiles.

    languages: language -> function word -> its share of all function words. profiles: (kind, the
    distributions of GROUPS one behind the other).
    """

    def __init__(self, languages: dict[str, dict[str, float]], profiles: list[tuple[str, list[float]]]):
        self.languages = sorted(languages)
        self.words = {w: i for i, w in enumerate(sorted({w for spread in languages.values() for w in spread}))}
        self.spread = np.zeros((len(self.words), len(self.languages)))
        for at, language in enumerate(self.languages):
            for word, share in languages[language].items():
                self.spread[self.words[word], at] = share
        self.kinds = np.array([KINDS.index(kind) for kind, _ in profiles])
        self.profiles = np.array([values for _, values in profiles], dtype=np.float32)
        self.known: dict[str, tuple[int, int]] = {}

    def language_of(self, counts: Counter) -> tuple[str | None, float]:
        """The language whose function words spread most like these (word number -> occurrences), and the divergence
        (None and 1 if there are none)."""
        if not counts:
            return None, 1.0
        p = np.fromiter(counts.values(), dtype=float, count=len(counts))
        p = (p / p.sum())[:, None]
        q = self.spread[list(counts)]
        with np.errstate(divide="ignore", invalid="ignore"):
            theirs = np.where(q > 0, q * np.log2(2 * q / (p + q)), 0.0)
        # A word on one side only gives half its share.
        apart = ((p * np.log2(2 * p / (p + q)) + theirs).sum(0) + 1 - q.sum(0)) / 2
        at = int(apart.argmin())
        return (self.languages[at], float(max(0.0, apart[at]))) if q[:, at].any() else (None, 1.0)

    def _token(self, token: str) -> tuple[int, int]:
        """(place among the classes of tokens, number of a function word or -1)."""
        bare = token.strip(_AROUND)
        if not bare:
            return 6, -1
        word = self.words.get(bare.lower())
        if word is not None:
            return 0, word
        if bare.isalpha() or bare.translate(_WITHIN).isalpha():
            if len(bare) >= 24:
                return 7, -1
            if len(bare) == 1:
                return 3, -1
            return (2 if len(bare) >= 3 and _LATIN_CYRILLIC.search(bare) and not _VOWELS.search(bare) else 1), -1
        if _NUMBER.fullmatch(bare):
            return 4, -1
        return (6 if not any(map(str.isalnum, bare)) else 7 if len(bare) >= 24 else 5), -1

    def distributions(self, lines: list[str]) -> list[float]:
        """The distributions of GROUPS of a block of lines that aren't blank."""
        text = "\n".join(lines)
        seen = Counter(text.split())
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        tokens, function_words = [0] * 8, Counter()
        once = often = 0
        total = max(1, seen.total())
        for token, n in seen.items():
            found = known.get(token)
            if found is None:
                found = known[token] = self._token(token)
            tokens[found[0]] += n
            if found[1] >= 0:
                function_words[found[1]] += n
            if n == 1:
                once += 1
            elif n > 2 and 5 * n > total:
                often += n
        near, unparted = 1 - self.language_of(function_words)[1], False
        if not text.isascii() and 2 * len(letters := _OTHER_SCRIPT.findall(text)) > sum(map(str.isalpha, text)):
            unparted = bool(_UNPARTED.search(text))
            words = max(1, tokens[1], len(letters) // 2 if unparted else 0)
            tokens = [round(words * USUAL_SHARE), round(words * (1 - USUAL_SHARE)), 0, 0, tokens[4], 0, tokens[6], 0]
            near = USUAL_LIKENESS
        starts, ends, lengths = [0] * 7, [0] * 7, [0] * 6
        for line in lines:
            bare = line.strip()
            starts[_beginning(bare)] += 1
            ends[_end(bare)] += 1
            lengths[_length(len(bare.split()) + (len(_UNPARTED.findall(bare)) // 2 if unparted else 0))] += 1
        many = len(lines)
        return [
            *class_shares(text), *_shares(tokens), *_shares(starts), *_shares(ends), *_shares(lengths), *_columns(text, lines),
            once / total, often / total, (total - once - often) / total, near, 1 - near, many == 1, 1 < many < 4, many > 3,
        ]

    def kinds_of(self, texts: list[str | None]) -> list[str | None]:
        """The kind of each text: that of more than half of its characters, None for null and blank texts."""
        rows, owner, sizes = [], [], []
        for i, text in enumerate(texts):
            for block in blocks(text):
                rows.append(self.distributions(block))
                owner.append(i)
                sizes.append(sum(map(len, block)))
        held = np.zeros((len(texts), len(KINDS)), dtype=np.int64)
        if rows:
            nearest = self.kinds[divergences(np.array(rows, dtype=np.float32), self.profiles).argmin(1)]
            np.add.at(held, (np.array(owner), nearest), np.array(sizes))
        size, most = held.sum(1), held.argmax(1)
        return [None if not n else KINDS[k] if 2 * h[k] > n else "prose" for h, n, k in zip(held.tolist(), size.tolist(), most.tolist())]


@functools.cache
def fitted() -> Profiles:
    """The profiles beside this module, which ``quality_fit`` made."""
    found = json.loads(Path(__file__).with_name("quality_profiles.json").read_text(encoding="utf-8"))
    return Profiles(found["languages"], [(p["kind"], p["shares"]) for p in found["profiles"]])


def _lines(text: str) -> list[str]:
    return (text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text).split("\n")


def blocks(text: str | None) -> list[list[str]]:
    """The lines of a text between blank ones; lines that stand alone one after another are a block."""
    out: list[list[str]] = []
    block: list[str] = []
    alone = False
    for line in [*_lines(text or ""), ""]:
        if line.strip():
            block.append(line)
        elif block:
            if len(block) == 1 and alone:
                out[-1] += block
            else:
                out.append(block)
                alone = len(block) == 1
            block = []
    return out


def kind(text: str | None) -> str | None:
    """The kind of one text."""
    return fitted().kinds_of([text])[0]


def language(words: list[str]) -> tuple[str | None, float]:
    """The language whose function words spread most like the words' own, and the divergence (1 if there are none)."""
    own = fitted().words
    return fitted().language_of(Counter(own[w] for w in words if w in own))


def counts(text: str | None, common: dict[str, int] | None = None) -> tuple:
    """(words, mean_word_length, symbol_share, punctuated_lines, common_words) of a text; null shares of nothing."""
    if not text:
        return (0, None, None, None, None)
    common = fitted().words if common is None else common
    words = _WORD.findall(text)
    lines = [s for s in _lines(text) if s.strip()]
    visible = len(text) - len(re.findall(r"\s", text))
    signs = visible - len(re.findall(r"[^\W_]", text))
    return (
        len(words),
        sum(map(len, words)) / len(words) if words else None,
        signs / visible if visible else None,
        sum(bool(_ENDED.search(s)) for s in lines) / len(lines) if lines else None,
        sum(w.lower() in common for w in words) / len(words) if words else None,
    )


def statistics(documents: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """(doc_id, words, mean_word_length, symbol_share, punctuated_lines, common_words, language, divergence, kind)."""
    schema = "doc_id bigint, words int, mean_word_length double, symbol_share double, punctuated_lines double, common_words double, language string, divergence double, kind string"
    shared = documents.sparkSession.sparkContext.broadcast(profiles or fitted())

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            texts = list(batch["text"])
            spoken = [known.language_of(Counter(known.words[w] for w in _WORD.findall(t.lower()) if w in known.words)) if t else (None, 1.0) for t in texts]
            rows = [(i, *counts(t, known.words), *of, k) for i, t, of, k in zip(batch["doc_id"], texts, spoken, known.kinds_of(texts))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"words": "int32"})

    return documents.select("doc_id", "text").mapInPandas(measure, schema)


def not_prose(documents: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """(doc_id, kind) of the documents that are lists, tables or junk. The profiles sent to the workers are a few dozen."""
    shared = documents.sparkSession.sparkContext.broadcast(profiles or fitted())

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, k) for i, k in zip(batch["doc_id"], shared.value.kinds_of(list(batch["text"]))) if k not in (None, "prose")]
            yield pd.DataFrame(found, columns=["doc_id", "kind"]).astype({"doc_id": "int64"})

    return documents.where(F.col("text").isNotNull()).select("doc_id", "text").mapInPandas(classify, "doc_id bigint, kind string")
