"""Scanned pages repaired into continuous paragraphs.

Lines of a text set in short lines are labelled by a hidden Markov model over layout features: running
text, standalone (titles, headings, chapter numbers), running header or footer, page number. Its tables
start from the beliefs below and are re-estimated by a round of Baum-Welch: how probable each state is for each
line of all scanned texts, given its features and neighbours, is summed over the corpus. On what is labelled running text, words broken across lines and misread words are found with a lexicon of the
words of all texts that aren't set in short lines; the text is then put together without the noise.

Null, empty and blank texts, and texts not set in short lines, have no noise. Lines end at line feeds and
are counted from 1. Texts are read whole; a result_id given twice gives its rows twice.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.session import settle

STATES = ("text", "standalone", "header", "page_number")
#: A word is known if this share of the texts not set in short lines holds it, and LEAST_TEXTS at least.
#: As a text holds a few hundred distinct words, the lexicon stays within a few hundred / SHARE entries.
SHARE, LEAST_TEXTS = 2e-4, 3
#: How many lines the beliefs weigh against those of the corpus.
BELIEF = 5_000

# Beliefs: how probable each value of a feature is for a line of each state (text, standalone, header, page number).
EMISSIONS = {
    "shape": {
        "dressed": (0.0005, 0.002, 0.001, 0.45), "bare": (0.002, 0.02, 0.001, 0.30), "roman": (0.0005, 0.002, 0.001, 0.24),
        "numbered": (0.002, 0.005, 0.30, 0.001), "capitals": (0.001, 0.03, 0.30, 0.001), "authors": (0.0005, 0.001, 0.20, 0.001),
        "volume": (0.0005, 0.001, 0.15, 0.001), "title": (0.02, 0.60, 0.0003, 0.001), "full": (0.70, 0.13, 0.0001, 0.0002),
        "ended": (0.20, 0.10, 0.00001, 0.00002), "short": (0.07, 0.10, 0.0005, 0.0005),
    },
    "repeats": {"once": (0.97, 0.85, 0.20, 0.35), "twice": (0.02, 0.10, 0.30, 0.20), "often": (0.01, 0.05, 0.50, 0.45)},
    "counting": {"on": (0.01, 0.03, 0.30, 0.80), "off": (0.02, 0.07, 0.05, 0.19), "none": (0.97, 0.90, 0.65, 0.01)},
    "flow": {"cut": (0.05, 0.02, 0.55, 0.55), "whole": (0.05, 0.80, 0.40, 0.40), "none": (0.90, 0.18, 0.05, 0.05)},
    "edge": {"near": (0.05, 0.06, 0.60, 0.70), "far": (0.95, 0.94, 0.40, 0.30)},
    "heading": {"same": (0.001, 0.01, 0.35, 0.001), "other": (0.999, 0.99, 0.65, 0.999)},
    "place": {"first": (0.005, 0.30, 0.002, 0.01), "last": (0.01, 0.01, 0.04, 0.10), "middle": (0.985, 0.69, 0.958, 0.89)},
}
TRANSITIONS = (
    (0.93, 0.03, 0.02, 0.02),
    (0.80, 0.12, 0.04, 0.04),
    (0.66, 0.05, 0.04, 0.25),
    (0.45, 0.05, 0.40, 0.10),
)
FEATURES = tuple(EMISSIONS)

# What scanners read for what is written (read, written).
MISREAD = [
    ("c", "e"), ("l", "i"), ("!", "i"), ("0", "o"), ("f", "t"), ("5", "s"), ("1", "l"), ("|", "l"), ("cl", "d"), ("rn", "m"), ("ii", "u"), ("q", "g"),
    ("b", "h"), ("vv", "w"), ("h", "li"), ("m", "rn"), ("d", "cl"), ("1", "i"), ("|", "i"), ("!", "l"), ("8", "b"), ("6", "b"), ("9", "g"), ("ii", "n"), ("nn", "m"),
]
MARKS = "-¬\xad‐"

_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_TOKEN = re.compile(r"[\w!|]+(?:[-‐][\w!|]+)*")
_NUMBERISH = re.compile(r"[\doOlIi|!bBsSzZq.,]*\d[\doOlIi|!bBsSzZq.,]*")
_NUMBER_LETTERS = re.compile(r"[oOlIi|!bBsSzZq]")
_ROMAN = re.compile(r"(?i)m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_DRESSED = re.compile(r"(?i)(?:[-–—~*•.]\s*(N)\s*[-–—~*•.]|\[\s*(N)\s*\]|\(\s*(N)\s*\)|(?:page|pag\.?|seite|p\.|pg\.?|стр\.?|página)\s*(N)(?:\s*(?:of|/|de|von)\s*\d+)?|(N)\s*(?:/|of)\s*\d+|\|\s*(N)\s*\|?)".replace("N", r"[\dol|!ib]{1,6}|[ivxlcdm]{1,8}"))
_NUMBERED = re.compile(r"(?i)(?:^([\dol|!]{1,5}|[ivxlc]{1,8})(?:\s{2,}|\s+\|\s+)\S.*|.*\S(?:\s{2,}|\s+\|\s+)([\dol|!]{1,5}|[ivxlc]{1,8})$)")
_AUTHORS = re.compile(r"(?i).{2,60}\bet\s+a[l1|!i]\.?$")
_VOLUME = re.compile(r"(?i).{4,80},?\s(?:vo[l1|!i]|bd|t)\.\s*[\dol|!b]+(?:[,(\s].{0,20})?$")
_ENDED = re.compile(r"[.!?…:;]['\"”’»)\]]*$")
_FOLDED = str.maketrans("cftl!1|05qb8", "eeeiiiiosghb")


_AS_DIGITS = str.maketrans({"o": "0", "O": "0", "l": "1", "I": "1", "i": "1", "|": "1", "!": "1", "b": "6", "B": "8", "s": "5", "S": "5", "z": "2", "Z": "2", "q": "9"})


def _value(text: str) -> int | None:
    """The number that a page number shows, misread digits included; None if it shows none."""
    if text.isdigit():
        return int(text)
    if _ROMAN.fullmatch(text):
        total, last = 0, 0
        for char in reversed(text.lower()):
            n = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[char]
            total += n if n >= last else -n
            last = max(last, n)
        return total
    digits = text.translate(_AS_DIGITS)
    return int(digits) if digits.isdigit() and any(map(str.isdigit, text)) else None


_ENDS = re.compile(r"^[\W\d]*\d[\W\d]*(?=\D)|(?<=\D)[\W\d]*\d[\W\d]*$")
_SIGNS = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """A line without what scanners confuse, numbers at its ends and white space: equal for one header read twice."""
    text = text.strip().lower()
    if any(map(str.isdigit, text)):
        text = _ENDS.sub("", text)
    text = text.replace("rn", "m").replace("cl", "d").replace("vv", "w").translate(_FOLDED)
    return _SIGNS.sub("", text.replace("ii", "u"))


def line_width(lengths: list[int]) -> int:
    """The width that lines are set to: what nine of ten long lines keep within (a title may be wider)."""
    long = sorted(n for n in lengths if n > 30)
    return long[(len(long) - 1) * 9 // 10] if long else 0


def in_short_lines(text: str) -> bool:
    """Whether a text is set in short lines, as scanned pages are: most of its long lines are about as long
    as the others and stop within a sentence."""
    lines = [s for s in map(str.rstrip, text.split("\n")) if len(s) > 30]
    if len(lines) < 5:
        return False
    width = line_width(list(map(len, lines)))
    if width > 120:
        return False
    full = [s for s in lines if 0.75 * width < len(s) <= 1.1 * width]
    return len(full) > 0.6 * len(lines) and sum(s[-1] in ".!?|" for s in full) < 0.5 * len(full)


def features(lines: list[str]) -> tuple[list[int], list[tuple[str, ...]]]:
    """(numbers of the lines that aren't blank, their features)."""
    at = [i for i, s in enumerate(lines) if s.strip()]
    clean = [lines[i].strip() for i in at]
    width = line_width([len(s) for s in clean]) or max(map(len, clean), default=1)
    shapes, values = [], []
    for s in clean:
        value, shape = None, None
        if len(s) <= 24 and (found := _DRESSED.fullmatch(s)):
            value, shape = _value(next(g for g in found.groups() if g)), "dressed"
        if value is None and len(s) <= 8:
            if s.isdigit() or any(map(str.isdigit, s)) and _value(s) is not None:
                value, shape = _value(s), "bare"
            elif _ROMAN.fullmatch(s):
                value, shape = _value(s), "roman"
        if value is None:
            shape = None
            if len(s) > 6 and ("  " in s or " | " in s) and (found := _NUMBERED.fullmatch(s)):
                value = _value(found[1] or found[2])
                shape = "numbered" if value is not None else None
            if shape is None:
                if sum(map(str.islower, s[:24])) < 5 and ". " not in s and sum(map(str.isupper, s)) >= max(6, 0.85 * sum(map(str.isalpha, s))):
                    shape = "capitals"
                elif len(s) <= 0.9 * width and " et " in s and _AUTHORS.fullmatch(s):
                    shape = "authors"
                elif s[-1] in "0123456789ol|!b)" and _VOLUME.fullmatch(s):
                    shape = "volume"
                elif len(s) > 0.75 * width:
                    shape = "full"
                elif _ENDED.search(s):
                    shape = "ended"
                elif s[0].isupper() and len(s.split()) <= 12:
                    shape = "title"
                else:
                    shape = "short"
        shapes.append(shape)
        values.append(value)
    # Only lines short of the full width can be headers; the first ones may be the title.
    keys = [fold(s) if len(s) < 0.85 * width or i < 3 else "" for i, s in enumerate(clean)]
    seen = Counter(k for k, s in zip(keys, clean) if k and len(s) < 0.85 * width)
    numeric = Counter(s for s in shapes if s in ("dressed", "bare", "roman"))
    marked = [s in ("dressed", "bare", "roman", "numbered", "capitals", "authors", "volume") or (k and seen[k] > 1) for s, k in zip(shapes, keys)]
    counted = [(i, v) for i, v in enumerate(values) if v is not None]
    title = next((keys[i] for i, s in enumerate(shapes[:3]) if s in ("title", "full", "ended")), "")
    fold_title = title if len(title) >= 6 else ""
    before, after = [-1] * len(clean), [-1] * len(clean)
    last = -1
    for i, m in enumerate(marked):
        before[i] = last
        if not m:
            last = i
    last = -1
    for i in range(len(clean) - 1, -1, -1):
        after[i] = last
        if not marked[i]:
            last = i
    out = []
    for i, s in enumerate(clean):
        shape = shapes[i]
        if shape in ("dressed", "bare", "roman"):
            n = numeric[shape]
        else:
            n = seen[keys[i]] if keys[i] else 0
        counting = "none"
        if values[i] is not None:
            near = any(j != i and 0 < (v - values[i]) * (1 if j > i else -1) <= max(2, abs(j - i) // 8 + 1) for j, v in counted)
            counting = "on" if near else "off"
        flow = "none"
        if marked[i]:
            p, q = before[i], after[i]
            cut = p >= 0 and q >= 0 and not _ENDED.search(clean[p]) and (clean[q][0].islower() or len(clean[p]) > 0.7 * width)
            flow = "cut" if cut else "whole"
        feed = "\f" in lines[at[i]] or (i + 1 < len(at) and "\f" in lines[at[i + 1]])
        neighbour = (i > 0 and marked[i - 1]) or (i + 1 < len(marked) and marked[i + 1])
        out.append((
            shape,
            "once" if n <= 1 else "twice" if n == 2 else "often",
            counting, flow,
            "near" if feed or (marked[i] and neighbour) else "far",
            "same" if i > 1 and fold_title and len(keys[i]) >= 6 and shape in ("capitals", "numbered", "title") and fold_title.startswith(keys[i]) else "other",
            "first" if i == 0 else "last" if i == len(clean) - 1 else "middle",
        ))
    return at, out


class Model:
    """Log probabilities of the hidden Markov model."""

    def __init__(self, counted: dict[tuple[str, str, int], float] | None = None):
        """counted: (feature or 'next', value or state, state) -> expected lines; None for the beliefs alone."""
        counted = counted or {}
        self.emit: list[dict[str, tuple[float, ...]]] = []
        per_state = [sum(counted.get(("shape", v, s), 0.0) for v in EMISSIONS["shape"]) for s in range(len(STATES))]
        for name in FEATURES:
            table = EMISSIONS[name]
            totals = [sum(p[s] for p in table.values()) for s in range(len(STATES))]
            self.emit.append({v: tuple(math.log((BELIEF * p[s] / totals[s] + counted.get((name, v, s), 0.0)) / (BELIEF + per_state[s])) for s in range(len(STATES))) for v, p in table.items()})
        self.follow = []
        for s, row in enumerate(TRANSITIONS):
            n = [counted.get(("next", str(s), t), 0.0) for t in range(len(STATES))]
            self.follow.append(tuple(math.log((BELIEF * p + c) / (BELIEF + sum(n))) for p, c in zip(row, n)))

        self.known: dict[tuple[str, ...], list[float]] = {}

    def emission(self, line: tuple[str, ...]) -> list[float]:
        """The log probability of a line's features in each state; kept, as there are a few thousand combinations."""
        here = self.known.get(line)
        if here is None:
            here = self.known[line] = [sum(self.emit[f][v][s] for f, v in enumerate(line)) for s in range(len(STATES))]
        return here

    def expected(self, lines: list[tuple[str, ...]]) -> tuple[list[list[float]], list[list[float]]]:
        """(probability of each state for each line, expected number of each transition) by the forward-backward algorithm."""
        states = range(len(STATES))
        if not hasattr(self, "chance"):
            self.chance = [[math.exp(x) for x in row] for row in self.follow]
        chance = self.chance
        emitted = []
        for line in lines:
            here = self.emission(line)
            top = max(here)
            emitted.append([math.exp(x - top) for x in here])
        forward: list[list[float]] = []
        for e in emitted:
            before = forward[-1] if forward else None
            now = [e[s] * (sum(before[r] * chance[r][s] for r in states) if before else 0.25) for s in states]
            total = sum(now)
            forward.append([x / total for x in now])
        after = [1.0] * len(STATES)
        posteriors: list[list[float]] = [[]] * len(lines)
        moves = [[0.0] * len(STATES) for _ in states]
        for i in range(len(lines) - 1, -1, -1):
            both = [forward[i][s] * after[s] for s in states]
            total = sum(both)
            posteriors[i] = [x / total for x in both]
            if i:
                coming = [emitted[i][s] * after[s] for s in states]
                pairs = [[forward[i - 1][r] * chance[r][s] * coming[s] for s in states] for r in states]
                total = sum(map(sum, pairs))
                for r in states:
                    for s in states:
                        moves[r][s] += pairs[r][s] / total
                after = [sum(chance[r][s] * coming[s] for s in states) for r in states]
                top = max(after)
                after = [x / top for x in after]
        return posteriors, moves

    def label(self, lines: list[tuple[str, ...]]) -> list[int]:
        """The most probable states of the lines."""
        if not lines:
            return []
        follow, states = self.follow, range(len(STATES))
        score, back = None, []
        for line in lines:
            here = self.emission(line)
            if score is None:
                score = [h + math.log(0.25) for h in here]
                continue
            origin, new = [], []
            for s in states:
                best = max(states, key=lambda r: score[r] + follow[r][s])
                origin.append(best)
                new.append(score[best] + follow[best][s] + here[s])
            back.append(origin)
            score = new
        path = [max(states, key=score.__getitem__)]
        for origin in reversed(back):
            path.append(origin[path[-1]])
        return path[::-1]


class Lexicon:
    """Known words, and what a misread word was."""

    def __init__(self, words: frozenset[str]):
        self.words = words
        self.corrections: dict[str, str | None] = {}

    def correct(self, token: str) -> str | None:
        """The known word that was misread as an unknown token (lower case), None if none is; up to two confusions."""
        if token not in self.corrections:
            if len(self.corrections) > 200_000:
                self.corrections.clear()
            self.corrections[token] = self._correct(token)
        return self.corrections[token]

    def _correct(self, token: str) -> str | None:
        front = {token}
        for _ in range(2):
            after = set()
            for word in front:
                for read, written in MISREAD:
                    at = word.find(read)
                    while at >= 0:
                        after.add(word[:at] + written + word[at + len(read) :])
                        at = word.find(read, at + 1)
            if found := sorted(w for w in after if w in self.words):
                return found[0]
            if len(token) < 4:
                return None
            front = after
        return None

    def is_misread(self, token: str) -> bool:
        """Whether a token of running text has a misread character."""
        bare = token.strip("!|")
        low = token.lower()
        if low in self.words or bare.lower() in self.words and not (token[0] in "!|" or "|" in token):
            return False
        if any(map(str.isdigit, token)) or "!" in bare or "|" in token:
            if _NUMBERISH.fullmatch(token):
                letters = len(_NUMBER_LETTERS.findall(token))
                return 0 < letters <= max(1, len(token) // 2)
            if re.search(r"[^\W\d_][0158!|]+[^\W\d_]", token) and sum(map(str.isalpha, token)) >= 3:
                return True
        if not any(map(str.isalpha, token)):
            return False
        if "-" in low or "‐" in low:
            return any(self.is_misread(p) for p in re.split("[-‐]", token) if p)
        return self.correct(low) is not None or (bare != token and token[0] in "!|" and self.correct(low) is not None)


def _broken(first: str, mark: str, rest: str, lexicon: Lexicon) -> bool:
    """Whether a word was broken at a mark that isn't its own, given its two parts."""
    joined, compound = (first + rest).lower(), f"{first}-{rest}".lower()
    if not first[-1].isalpha() or not rest[0].isalpha():
        return False
    if mark != "-":
        return True
    words = lexicon.words
    # Longer words around the mark may hold hyphens of their own.
    if compound in words:
        return joined in words and len(first) < 3
    if joined in words:
        return True
    tail, head = first.lower().rsplit("-", 1)[-1], rest.lower().split("-", 1)[0]
    if f"{tail}-{head}" in words and tail + head not in words:
        return False
    if tail + head in words:
        return True
    if lexicon.correct(tail + head) is not None:
        return True
    return not (tail in words and head in words and len(tail) > 2 and len(head) > 2) and head[0].islower()


_LAST = re.compile(rf"([\w!|]+(?:[-‐][\w!|]+)*)([{MARKS}])$")
_FIRST = re.compile(r"[\w!|]+(?:[-‐][\w!|]+)*")


def noise(text: str, model: Model, lexicon: Lexicon, join: bool = True) -> tuple[list[tuple[int, str]], list[str]]:
    """((line, noise) of a text set in short lines, its paragraphs without the noise, none unless join)."""
    lines = [s.rstrip("\r") for s in text.split("\n")]
    at, seen = features(lines)
    states = model.label(seen)
    found: set[tuple[int, str]] = set()
    for i, s in zip(at, states):
        if s == 2:
            found.add((i + 1, "header"))
        elif s == 3:
            found.add((i + 1, "page_number"))
    # Lines within a paragraph run on even if they look like a heading.
    running = [i for i, s, f in zip(at, states, seen) if s == 0 or s == 1 and f[0] in ("full", "ended", "short")]
    follower = dict(zip(running, running[1:]))
    skip: dict[int, int] = {}
    rests: dict[int, tuple[str, str]] = {}
    for i in running:
        line = lines[i].rstrip()
        j = follower.get(i)
        if j is None or not line or line[-1] not in MARKS or not (last := _LAST.search(line)) or not (first := _FIRST.match(lines[j].lstrip(" \t\f"))):
            continue
        mark = last[2]
        if not any(map(str.isalpha, last[1])) or not any(map(str.isalpha, first[0])):
            continue
        if _broken(last[1], mark, first[0], lexicon):
            found.add((i + 1, "hyphen"))
        # Either way the two parts are read as one word.
        word = last[1] + ("" if (i + 1, "hyphen") in found else "-") + first[0]
        rests[i] = (last[1], first[0])
        skip[j] = 1
        if lexicon.is_misread(word) and word.lower() not in lexicon.words:
            right = lexicon.correct(word.lower())
            cut = len(last[1])
            if right is not None:
                same = next((k for k, (a, b) in enumerate(zip(word.lower(), right)) if a != b), len(right))
                found.add(((i if same < cut else j) + 1, "ocr"))
            else:
                for part, where in ((last[1], i), (first[0], j)):
                    if re.search(r"[^\W\d_][0158!|]+[^\W\d_]", part):
                        found.add((where + 1, "ocr"))
    for i in running:
        line = lines[i].rstrip()
        tokens = _TOKEN.findall(line)
        if i in rests and tokens:
            tokens.pop()
        for word in tokens[1:] if skip.get(i) else tokens:
            if word.lower() in lexicon.words:
                continue
            if word.endswith(("!", "|")) and not word[:-1].isdigit() and word.rstrip("!|").lower() in lexicon.words:
                word = word.rstrip("!|")
            if word and lexicon.is_misread(word):
                found.add((i + 1, "ocr"))
                break
    return sorted(found), _paragraphs(lines, at, states, found, lexicon) if join else []


def _mended(line: str, lexicon: Lexicon) -> str:
    """A line with its misread words corrected."""

    def mend(token: re.Match) -> str:
        word = token[0]
        if not lexicon.is_misread(word):
            return word
        if _NUMBERISH.fullmatch(word):
            return word.translate(_AS_DIGITS)
        right = lexicon.correct(word.lower())
        if right is None:
            return word
        return right.capitalize() if word[0].isupper() or (word[0] in "501l|!" and len(word) > 1 and word[1:].islower() and line.startswith(word)) else right

    return _TOKEN.sub(mend, line)


def _paragraphs(lines: list[str], at: list[int], states: list[int], found: set[tuple[int, str]], lexicon: Lexicon) -> list[str]:
    out: list[str] = []
    open_line: int | None = None
    for i, s in zip(at, states):
        if s in (2, 3):
            continue
        line = lines[i].strip(" \t\f\r")
        if s == 1:
            out.append(_mended(line, lexicon))
            open_line = None
            continue
        if open_line is not None:
            between = range(open_line + 1, i)
            blank = any(not lines[k].strip() for k in between)
            page = any(lines[k].strip() for k in between)
            # A page's end doesn't end a paragraph whose last line stops within a sentence.
            if not blank or (page and not _ENDED.search(lines[open_line].strip())):
                previous = out[-1]
                broken = (open_line + 1, "hyphen") in found
                own = previous[-1:] in MARKS and _LAST.search(previous) is not None
                out[-1] = previous[:-1] + line if broken else previous + line if own else f"{previous} {line}"
                open_line = i
                continue
        out.append(line)
        open_line = i
    return [_mended(p, lexicon) for p in out]


def words_of(text: str) -> set[str]:
    """The distinct words of a text, hyphenated ones whole and in parts."""
    found = set(_WORD.findall(text.lower()))
    for word in [w for w in found if "-" in w]:
        found.update(word.split("-"))
    return found


def _read(texts: DataFrame, key: str, text: str) -> DataFrame:
    """One pass over all texts: those set in short lines, and from the others in how many each word occurs."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            rows, plain = [], 0
            for i, value in zip(batch[key], batch[text]):
                if in_short_lines(value):
                    rows.append(("page", i, value, 1))
                else:
                    plain += 1
                    counts.update(words_of(value))
            rows += [("word", None, w, n) for w, n in counts.items()]
            rows.append(("texts", None, None, plain))
            yield pd.DataFrame(rows, columns=["row", key, "content", "n"]).astype({key: "Int64", "n": "int64"})

    named = texts.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, text)
    return named.mapInPandas(read, f"row string, {key} bigint, content string, n bigint")


def repaired(texts: DataFrame, key: str = "result_id", text: str = "markdown", join: bool = True) -> DataFrame:
    """(key, noise array<struct<line_no,noise>>, paragraphs array<string>) of the texts set in short lines; no paragraphs unless join."""
    spark = texts.sparkSession
    read = settle(_read(texts, key, text))
    plain = read.where("row = 'texts'").agg(F.sum("n")).first()[0] or 0
    known = read.where("row = 'word'").groupBy("content").agg(F.sum("n").alias("n")).where(F.col("n") >= max(LEAST_TEXTS, SHARE * plain))
    # Bounded by SHARE: see there.
    lexicon = frozenset(r[0] for r in known.select("content").collect())
    pages = read.where("row = 'page'").select(key, "content").repartition(key)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model()
        for batch in batches:
            counts: Counter = Counter()
            for value in batch["content"]:
                _, seen = features([s.rstrip("\r") for s in value.split("\n")])
                each, moves = model.expected(seen)
                for line, chances in zip(seen, each):
                    for s, chance in enumerate(chances):
                        # What is all but impossible adds nothing but time.
                        if chance > 1e-4:
                            for name, v in zip(FEATURES, line):
                                counts[name, v, s] += chance
                for s, row in enumerate(moves):
                    for t, many in enumerate(row):
                        counts["next", str(s), t] += many
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["feature", "value", "state", "n"])

    counted = pages.select("content").mapInPandas(count, "feature string, value string, state int, n double").groupBy("feature", "value", "state").agg(F.sum("n").alias("n"))
    # A row per feature, value and state: a few hundred, whatever the texts.
    model = Model({(r["feature"], r["value"], r["state"]): r["n"] for r in counted.collect()})
    shared = spark.sparkContext.broadcast((model, lexicon))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted, words = shared.value
        book = Lexicon(words)
        for batch in batches:
            done = [noise(value, fitted, book, join) for value in batch["content"]]
            yield pd.DataFrame({key: batch[key], "noise": [[{"line_no": i, "noise": n} for i, n in d[0]] for d in done], "paragraphs": [d[1] for d in done]})

    return pages.mapInPandas(clean, f"{key} bigint, noise array<struct<line_no:int,noise:string>>, paragraphs array<string>")


def noisy_lines(texts: DataFrame, key: str = "result_id", text: str = "markdown") -> DataFrame:
    """(key, line_no, noise): a row for each kind of noise of each line."""
    return repaired(texts, key, text, join=False).select(key, F.explode("noise").alias("n")).select(key, "n.line_no", "n.noise")


def paragraphs(texts: DataFrame, key: str = "result_id", text: str = "markdown") -> DataFrame:
    """(key, paragraph_no, paragraph): the texts set in short lines as continuous paragraphs."""
    return repaired(texts, key, text).select(key, F.posexplode("paragraphs").alias("_at", "paragraph")).select(key, (F.col("_at") + 1).alias("paragraph_no"), "paragraph")
