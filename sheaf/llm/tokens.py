"""Token ids of a public byte-level BPE vocabulary, through a sentencepiece model made from it.

The vocabulary's entries become the pieces of a sentencepiece BPE model, serialised here field by field:
text in the byte alphabet (each byte a printable character), score the negative rank, identity
normalisation. Texts are cut into pre-tokens by the vocabulary's pattern, each pre-token is spelled in
the byte alphabet and encoded; the inverse mapping decodes.

Null and empty texts have an empty list of ids. Strings of special tokens are ordinary text. Texts of
any length are encoded whole. A doc_id given twice gives two rows.
"""

from __future__ import annotations

import array
import base64
import functools
import hashlib
import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens that one worker remembers; beyond it the memory starts afresh.
REMEMBERED = 400_000


@functools.cache
def byte_alphabet() -> str:
    """The character of each byte: itself if printable, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b if b in printable else next(rest)) for b in range(256))


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Where a vocabulary file lies: in folder, else in the installed package of public tokenizers."""
    if folder is not None:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, of a file with a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _field(number: int, kind: int, payload: bytes) -> bytes:
    return _varint(number << 3 | kind) + payload


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(number: int, payload: bytes) -> bytes:
    return _field(number, 2, _varint(len(payload)) + payload)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the ranks; one unknown piece behind them.

    Ranks must be 0, 1, 2, ...; every byte must be a token, so that the unknown piece never occurs.
    """
    by_rank = sorted(ranks, key=ranks.get)
    if sorted(ranks.values()) != list(range(len(ranks))) or not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("ranks must be without gaps and hold every byte")
    letters = byte_alphabet()
    out = bytearray()
    for rank, token in enumerate(by_rank):
        text = "".join(letters[b] for b in token).encode()
        out += _message(1, _message(1, text) + _field(2, 5, struct.pack("<f", -float(rank))))
    out += _message(1, _message(1, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, _varint(2)))
    trainer = _field(3, 0, _varint(2))  # the kind of model: BPE
    normalizer = _message(1, b"identity") + b"".join(_field(n, 0, _varint(0)) for n in (3, 4, 5))
    return bytes(out + _message(2, trainer) + _message(3, normalizer))


#: Fixed value: the pattern of pre-tokens (contractions, words, numbers, signs, white space).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def _patterns() -> tuple[Callable[[str], list[str]], Callable[[str], list[str]]]:
    """The pattern's findall for texts within the basic plane, and for all others.

    The standard module is three times as fast but lacks the classes, so they are written out as
    ranges, which it turns into lookup tables as long as they end within the basic plane.
    """
    import regex

    # All characters but the surrogates, which no decoded text holds.
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def ranges(name: str) -> str:
        runs = (m[0] for m in regex.finditer(f"{name}+", plane))
        return "".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for run in runs)

    names = {r"\s": ranges(r"\s"), r"\p{L}": ranges(r"\p{L}"), r"\p{N}": ranges(r"\p{N}")}
    plain = PATTERN.replace(r"(?!\S)", r"(?![^\s])")
    inside = re.compile(r"\[\^?[^]]*\]")
    # Within brackets the ranges stand by themselves, elsewhere they need brackets.
    out, at = [], 0
    for found in [*inside.finditer(plain), None]:
        outer = plain[at : found.start() if found else len(plain)]
        inner = found[0] if found else ""
        for name, written in names.items():
            outer, inner = outer.replace(name, f"[{written}]"), inner.replace(name, written)
        out += [outer, inner]
        at = found.end() if found else at
    return re.compile("".join(out)).findall, regex.compile(PATTERN).findall


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text; joined they give it back."""
    basic, general = _patterns()
    return basic(text) if text.isascii() or max(text) < "\U00010000" else general(text)


class Encoder:
    """Encodes texts; made once in each worker."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.encode_piece = sentencepiece.SentencePieceProcessor(model_proto=model).encode
        self.letters = byte_alphabet()
        self.known: dict[str, array.array] = {}

    def _spelled(self, token: str) -> str:
        return token.encode("utf-8", "replace").decode("latin-1").translate(self.letters)

    def encode(self, text: str, into: array.array) -> None:
        known = self.known
        for token in pre_tokens(text):
            ids = known.get(token)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = known[token] = array.array("i", self.encode_piece(self._spelled(token)))
            into += ids


def decode(ids: list[int], ranks: dict[bytes, int]) -> str:
    """The text of ids, by the inverse mapping."""
    tokens = {rank: token for token, rank in ranks.items()}
    return b"".join(tokens[i] for i in ids).decode("utf-8", "replace")


#: By the model's digest.
_encoders: dict[str, Encoder] = {}


def encode_texts(texts: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): the ids of each text, without special tokens.

    The model is made once on the driver and sent to the workers; its size is the vocabulary's, about
    1.5 MB, whatever the texts.
    """
    model = sentencepiece_model(read_ranks(path or vocabulary_path()))
    shared = texts.sparkSession.sparkContext.broadcast((hashlib.sha256(model).hexdigest(), model))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, content = shared.value
        encoder = _encoders.get(key) or _encoders.setdefault(key, Encoder(content))
        for batch in batches:
            flat, offsets = array.array("i"), array.array("i", [0])
            for value in batch.column(1).to_pylist():
                if value:
                    encoder.encode(value, flat)
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(memoryview(offsets), pa.int32()), pa.array(memoryview(flat), pa.int32()) if flat else pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    kept = texts.select(F.col(key), F.col(text))
    return kept.mapInArrow(encode, f"{key} {kept.dtypes[0][1]}, ids array<int>")
