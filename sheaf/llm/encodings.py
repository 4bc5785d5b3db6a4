"""Text decoded with the wrong encoding, found line by line and restored.

A latent chain of wrong decodings lies behind each line: none, or one or more steps, each of them "bytes of
A read as B". Every chain that can be undone on a line is a candidate; its weight is how much more
probable the undone text is than the text as it stands, by the pairs of neighbouring characters in the
corpus, times how often the chain occurs in the line's pool, its source and field. Expectation-maximization
estimates these shares: lines are weighed by the present shares, the shares are summed from the weights,
and again. So what is certain on many lines of a pool decides its doubtful ones. Each line then takes its
most probable chain.

A line with a replacement character, or with one left after undoing, is lost. Null and empty texts have
no cases; lines are read whole; a result_id given twice gives its rows twice. Codes of unreadable fonts
are plain characters and no cases.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.session import batched, settle

#: Steps that read the bytes of UTF-8 as one of these.
UTF8_READ_AS = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850")
#: Steps that read the bytes of one single-byte encoding as another: (written as, read as).
SINGLE_BYTE = (("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("koi8_r", "cp1252"), ("cp866", "cp1251"))
MOST_STEPS = 8
#: Character pairs rarer than this share of all pairs count as unseen; at most 1 / RAREST pairs remain.
RAREST = 1e-6
ROUNDS = 6
#: Log weight that a character costs in each of its pairs if no line that the pairs are counted on has it.
STRANGE = 10.0
#: Pools (a source and field) with shares of their own, those with most suspect lines; the lines of all others are one pool.
#: What comes to the driver is as large as pools times chains.
POOLS = 1_000
#: Half a line for every chain keeps those possible that a pool hasn't shown.
UNSHOWN = 0.5
#: Weight of a character that a whole-line chain would have changed but left.
LEFT_OUT = {"cp1252": 0.5, "cp1250": 0.5, "cp1251": 8.0}

_WIDE = re.compile(r"[^\x00-\x7f]+")
_WIDE_RUN = re.compile(r"[^\x00-\x7f]{2,}")
_LOST = re.compile("[�\x80-\x84\x86-\x9f]")


@functools.cache
def _decoded(codec: str) -> tuple[str, ...]:
    """The character of each byte; bytes that the encoding leaves free give the control character of their number."""
    return tuple(bytes([b]).decode(codec, "replace").replace("�", chr(b)) for b in range(256))


@functools.cache
def _bytes_of(codec: str) -> dict[str, int]:
    """Byte of each character above the ASCII range; control characters stand for their own byte as well."""
    own = {chr(b): b for b in range(0x80, 0xA0)} if codec.startswith("cp125") else {}
    return own | {c: b for b, c in enumerate(_decoded(codec)) if b > 0x7F}


@functools.cache
def _sequences(codec: str) -> re.Pattern:
    """Characters that spell one UTF-8 sequence in the encoding."""
    of = _bytes_of(codec)

    def chars(low: int, high: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in of.items() if low <= b <= high) + "]"

    rest = chars(0x80, 0xBF)
    return re.compile(f"{chars(0xC2, 0xDF)}{rest}|{chars(0xE0, 0xEF)}{rest}{{2}}|{chars(0xF0, 0xF4)}{rest}{{3}}")


@functools.cache
def _any_sequence() -> re.Pattern:
    lead = {c for codec in UTF8_READ_AS for c, b in _bytes_of(codec).items() if 0xC2 <= b <= 0xF4}
    rest = {c for codec in UTF8_READ_AS for c, b in _bytes_of(codec).items() if 0x80 <= b <= 0xBF}
    return re.compile("[" + "".join(map(re.escape, sorted(lead))) + "][" + "".join(map(re.escape, sorted(rest))) + "]")


#: Control characters that stand where Windows encodings have signs, and those signs.
_CONTROLS = {chr(b): _decoded("cp1252")[b] for b in range(0x80, 0xA0) if ord(_decoded("cp1252")[b]) > 0x9F}
_CONTROL = re.compile("[" + "".join(map(re.escape, _CONTROLS)) + "]")
_LATIN_RUN = re.compile("[¨¸À-ÿ]{3}")
_TURNED_CASE = re.compile("[а-яё][А-ЯЁ]{2}|[А-ЯЁ]{4}")
#: Small letters of cp866 read as cp1251 are signs up to п, and small letters behind it; neither stand like this in words.
_SIGNS = "ЎЈҐЁЄЇ¤¦§©«¬®"
_SIGNED = re.compile(f"[{_SIGNS}\xad]{{2}}|[а-яё][{_SIGNS}]")
#: Where each single-byte step can have been, by the characters that it leaves.
_GATES = {step: _LATIN_RUN if step[1] == "cp1252" else _TURNED_CASE for step in SINGLE_BYTE} | {("cp866", "cp1251"): _SIGNED}
_ACCENTED_WORD = re.compile(r"(?<![A-Za-z])[^\x00-\x7f\s]+(?![A-Za-z])")
#: The same where letters became signs, one of them the space that doesn't break.
_SIGNED_WORD = re.compile(r"(?<![A-Za-z])(?:[^\x00-\x7f\s]|\xa0)+(?![A-Za-z])")


def undo_utf8(text: str, codec: str, model: Pairs | None = None) -> tuple[str, int]:
    """The text with the UTF-8 sequences that were read as codec decoded, and how many there were.

    With a model, a sequence whose characters are usual neighbours stays if it would become a character
    that no text has.
    """
    of, n = _bytes_of(codec), 0

    def decode(found: re.Match) -> str:
        nonlocal n
        try:
            char = bytes(of[c] for c in found[0]).decode("utf-8")
        except UnicodeDecodeError:
            return found[0]
        if model is not None and char.lower() not in model.chars and found[0][:2].lower() in model.seen:
            return found[0]
        n += 1
        return char

    return _sequences(codec).sub(decode, text), n


def undo_single(text: str, written: str, read: str) -> tuple[str, int]:
    """The text with its words of letters outside ASCII taken back to bytes and decoded as written."""
    of, to, n = _bytes_of(read), _decoded(written), 0
    signed = _GATES[written, read] is _SIGNED

    def decode(found: re.Match) -> str:
        nonlocal n
        word = found[0]
        # Of the letters' bytes two are × and ÷ in cp1252, one of them a word of its own.
        if not signed and not any(c.isalpha() or c in _CONTROLS or read == "cp1252" and c in "×÷" for c in word):
            return word
        back = "".join(to[of[c]] if c in of else c for c in word)
        letters = [c for c in back if c.isalpha()]
        if len(letters) < sum(c.isalpha() for c in word):
            return word
        n += 1
        return back

    return (_SIGNED_WORD if signed else _ACCENTED_WORD).sub(decode, text), n


def is_suspect(line: str) -> bool:
    """Whether some chain could be undone on the line, or a character is lost."""
    runs = _runs(line)
    return bool("�" in line or _CONTROL.search(line) or runs and (_any_sequence().search(runs) or _turned(runs)))


def _turned(runs: str) -> bool:
    """Whether some single-byte step can have been there."""
    return any(gate.search(runs) for gate in (_LATIN_RUN, _TURNED_CASE, _SIGNED))


def _runs(text: str) -> str:
    """The runs of two or more characters outside ASCII: what sequences and foreign words are made of."""
    return " ".join(_WIDE_RUN.findall(text))


#: Characters of European texts, and those that these become when garbled twice; sequences that become others may as well stand as they are.
_USUAL = ((0xA0, 0x2FF), (0x370, 0x4FF), (0x2000, 0x25FF))


def is_garbled(line: str) -> bool:
    """Whether a suspect line holds what clean ones hardly do, so that its pairs mustn't count as clean."""
    runs = _runs(line)
    if "�" in line or _CONTROL.search(line) or _turned(runs):
        return True
    for codec in UTF8_READ_AS:
        of = _bytes_of(codec)
        for found in _sequences(codec).findall(runs):
            try:
                char = ord(bytes(of[c] for c in found).decode("utf-8"))
            except UnicodeDecodeError:
                continue
            if any(low <= char <= high for low, high in _USUAL):
                return True
    return False


def _pairs(line: str) -> Iterator[tuple[str, str]]:
    """Neighbouring characters, letters lowered, of which one at least isn't ASCII."""
    padded = f" {line.lower()} "
    for run in _WIDE.finditer(padded):
        part = padded[max(0, run.start() - 1) : run.end() + 1]
        yield from zip(part, part[1:])


class Pairs:
    """Log probabilities of neighbouring characters."""

    def __init__(self, counts: dict[str, int]):
        self.total = sum(counts.values()) + 1.0
        self.seen = {pair: math.log((n + 0.05) / self.total) for pair, n in counts.items() if n > 0}
        self.unseen = math.log(0.05 / self.total)
        self.chars = {c for pair in self.seen for c in pair}

    def weigh(self, line: str) -> float:
        seen, chars, total = self.seen, self.chars, 0.0
        for a, b in _pairs(line):
            known = seen.get(a + b)
            if known is None:
                # A character that no clean line has is less likely than a new pair of known ones.
                known = self.unseen - STRANGE * ((a not in chars and not a.isascii()) + (b not in chars and not b.isascii()))
            total += known
        return total


def _steps(text: str, model: Pairs) -> Iterator[tuple[str, str, float]]:
    """(step, undone text, cost) of each single step that can be undone."""
    runs = _runs(text)
    if _any_sequence().search(runs):
        for codec in UTF8_READ_AS:
            if not _sequences(codec).search(runs):
                continue
            back, n = undo_utf8(text, codec, model)
            if n:
                cost = 0.0
                if per := LEFT_OUT.get(codec):
                    # Letters that the step would have made of bytes but that are in no sequence.
                    of = _bytes_of(codec)
                    cost = per * sum(c.isalpha() and c in of for run in _WIDE.findall(_sequences(codec).sub("", text)) for c in run)
                yield codec, back, cost
    if _CONTROL.search(text):
        yield "cp1252>latin_1", _CONTROL.sub(lambda m: _CONTROLS[m[0]], text), 0.0
    for written, read in SINGLE_BYTE:
        if _GATES[written, read].search(runs):
            back, n = undo_single(text, written, read)
            if n and back != text:
                yield f"{written}>{read}", back, 0.0


def candidates(line: str, model: Pairs) -> list[tuple[str, float, str]]:
    """(chain, log weight against the line as it stands, undone text) of the chains that can be undone.

    Behind the first step a further one is followed only from where the last left the text more probable, and of a
    round's texts only from the two best; MOST_STEPS bounds the rounds.
    """
    if line.isascii():
        return []
    base = None
    out: dict[str, tuple[str, float, str]] = {}
    front = [("", 0.0, 0.0, line)]
    for _ in range(MOST_STEPS):
        after = []
        for chain, before, cost, text in front:
            for step, back, more in _steps(text, model):
                if back in out:
                    continue
                base = model.weigh(line) if base is None else base
                weight = model.weigh(back) - base - cost - more
                out[back] = (f"{chain}+{step}" if chain else step, weight, back)
                if weight > before or not chain:
                    after.append((out[back][0], weight, cost + more, back))
        front = sorted(after, key=lambda x: -x[1])[:2]
        if not front:
            break
    return list(out.values())


def _sifted(texts: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """One pass over the texts: suspect lines (n is 1 if garbled), and the counts of character pairs of lines
    that aren't garbled.

    Only lines outside ASCII matter. Counts are summed within each batch before they leave Python.
    """

    def sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            rows = []
            for i, value, origin in zip(batch[key], batch[text], batch["_source"]):
                if value.isascii():
                    continue
                for number, line in enumerate(value.split("\n"), 1):
                    if line.isascii():
                        continue
                    suspect = is_suspect(line)
                    garbled = suspect and is_garbled(line)
                    if suspect:
                        rows.append((i, number, origin, line, int(garbled)))
                    if not garbled:
                        counts.update(map("".join, _pairs(line)))
            rows += [(None, None, None, pair, n) for pair, n in counts.items()]
            frame = pd.DataFrame(rows, columns=[key, "line_no", "source", "content", "n"])
            yield frame.astype({key: "Int64", "line_no": "Int32", "n": "int64"})

    pool = F.concat_ws("/", F.lit(text), F.coalesce(F.col(source).cast("string"), F.lit("")))
    named = texts.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, text, pool.alias("_source"))
    return named.mapInPandas(sift, f"{key} bigint, line_no int, source string, content string, n bigint")


@batched("map<string,bigint>")
def _pair_counts(lines: pd.Series) -> pd.Series:
    return lines.map(lambda line: dict(Counter(map("".join, _pairs(line)))))


def _known(counts: DataFrame) -> dict[str, int]:
    """The counts of pairs with a share of at least RAREST: 1 / RAREST entries at most."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return {r[0]: r[1] for r in counts.where(F.col("n") >= total * RAREST).collect()}


def _weighed(suspect: DataFrame, known: dict[str, int], key: str) -> DataFrame:
    """The suspect lines with their candidates."""
    shared = suspect.sparkSession.sparkContext.broadcast(known)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Pairs(shared.value)
        for batch in batches:
            batch["candidates"] = [[{"chain": c, "weight": w, "text": t} for c, w, t in candidates(line, model)] for line in batch["content"]]
            yield batch

    # Suspect lines are few but unevenly spread.
    spread = suspect.repartition(key, "line_no")
    return spread.mapInPandas(weigh, f"{key} bigint, line_no int, source string, content string, candidates array<struct<chain:string,weight:double,text:string>>")


def repairs(texts: DataFrame, key: str = "result_id", text: str = "markdown", source: str = "engine") -> DataFrame:
    """(key, line_no, outcome, repaired) of every line with characters that wrong decoding put there."""
    sifted = settle(_sifted(texts, key, text, source))
    suspect = sifted.where("line_no is not null").select(key, "line_no", "source", "content", "n")
    counts = sifted.where("line_no is null").groupBy("content").agg(F.sum("n").alias("n"))
    # Those that no chain makes more probable are clean after all: their pairs count when the lines are weighed at last.
    first = _weighed(suspect.where("n = 1").drop("n"), _known(counts), key).where("not exists(candidates, c -> c.weight > 0) and not contains(content, '\ufffd')")
    cleared = first.select(_pair_counts("content").alias("m")).select(F.explode("m").alias("content", "n")).groupBy("content").agg(F.sum("n").alias("n"))
    clean = counts.unionByName(cleared).groupBy("content").agg(F.sum("n").alias("n"))
    weighed = settle(_weighed(suspect.drop("n"), _known(clean), key))
    shared = texts.sparkSession.sparkContext.broadcast(estimated(weighed))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, number, pool, line, found in zip(batch[key], batch["line_no"], batch["source"], batch["content"], batch["candidates"]):
                # Among equal scores the last text in code-point order stays.
                best, undone = max(((c["weight"] + shared.value.log(pool, c["chain"]), c["text"]) for c in found), default=(-math.inf, None))
                if best <= shared.value.log(pool, ""):
                    undone = None
                if undone is not None or "\ufffd" in line:
                    after = line if undone is None else undone
                    rows.append((i, number, "lost" if _LOST.search(after) else "restored", after))
            yield pd.DataFrame(rows, columns=[key, "line_no", "outcome", "repaired"]).astype({key: "int64", "line_no": "int32"})

    return weighed.mapInPandas(decide, f"{key} bigint, line_no int, outcome string, repaired string")


class Shares:
    """The share of each chain ('' for none) among a pool's suspect lines."""

    def __init__(self, chains: list[str], pools: list[str], sums: dict[tuple[str | None, str], float] | None = None):
        """sums: (pool, chain) -> lines; None before the first round, when no chain is half as likely as all others."""
        self.chains, self.pools = chains, frozenset(pools)
        self.logs: dict[tuple[str | None, str], float] = {}
        # A pool is None if it has no shares of its own.
        for pool in (*pools, None):
            if sums is None:
                lines = {"": 0.5} | dict.fromkeys(chains, 0.5 / max(1, len(chains)))
                total = 1.0
            else:
                lines = {c: sums.get((pool, c), 0.0) + UNSHOWN for c in ("", *chains)}
                total = sum(lines.values())
            self.logs.update({(pool, c): math.log(n / total) for c, n in lines.items()})

    def pool(self, name: str) -> str | None:
        return name if name in self.pools else None

    def log(self, name: str, chain: str) -> float:
        return self.logs[self.pool(name), chain]

    def posterior(self, name: str, candidates: list[tuple[str, float]]) -> list[tuple[str, float]]:
        """(chain, probability) of no chain and of each candidate (chain, weight)."""
        logs = [("", self.log(name, "")), *((c, w + self.log(name, c)) for c, w in candidates)]
        top = max(x for _, x in logs)
        each = [(c, math.exp(x - top)) for c, x in logs]
        total = sum(x for _, x in each)
        return [(c, x / total) for c, x in each]


def estimated(weighed: DataFrame, rounds: int = ROUNDS) -> Shares:
    """Expectation-maximization of the shares of the chains in each pool.

    A round weighs every line by the present shares and sums the weights in the cluster, first within a
    batch; only the sums, pools times chains, come back.
    """
    chains = sorted(r[0] for r in weighed.select(F.explode("candidates.chain").alias("c")).distinct().collect())
    pools = [r[0] for r in weighed.groupBy("source").count().orderBy(F.desc("count"), "source").limit(POOLS).collect()]
    shares = Shares(chains, pools)
    lines = weighed.select("source", F.col("candidates.chain").alias("chains"), F.col("candidates.weight").alias("weights"))
    for _ in range(rounds):
        shared = weighed.sparkSession.sparkContext.broadcast(shares)

        def weigh(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                sums: Counter = Counter()
                for name, of, weights in zip(batch["source"], batch["chains"], batch["weights"]):
                    for chain, p in shared.value.posterior(name, list(zip(of, weights))):
                        sums[shared.value.pool(name), chain] += p
                yield pd.DataFrame([(*k, n) for k, n in sums.items()], columns=["source", "chain", "n"])

        summed = lines.mapInPandas(weigh, "source string, chain string, n double").groupBy("source", "chain").agg(F.sum("n").alias("n"))
        shares = Shares(chains, pools, {(r["source"], r["chain"]): r["n"] for r in summed.collect()})
    return shares


@batched("string")
def _mended(texts: pd.Series, lines: pd.Series) -> pd.Series:
    def one(value: str, found) -> str:
        if found is None or len(found) == 0:
            return value
        parts = value.split("\n")
        for x in found:
            parts[x["line_no"] - 1] = x["repaired"]
        return "\n".join(parts)

    return pd.Series([one(*x) for x in zip(texts, lines)])


def restored(texts: DataFrame, key: str = "result_id", text: str = "markdown", source: str = "engine") -> DataFrame:
    """(key, text): the texts of all rows as they were written, as far as it can be told."""
    per_text = repairs(texts, key, text, source).groupBy(key).agg(F.collect_list(F.struct("line_no", "repaired")).alias("_lines"))
    joined = texts.select(key, text).join(per_text, key, "left")
    return joined.select(key, F.when(F.col("_lines").isNotNull() & F.col(text).isNotNull(), _mended(text, "_lines")).otherwise(F.col(text)).alias(text))
