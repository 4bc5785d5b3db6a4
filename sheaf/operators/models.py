"""Calls of a text model as an operator, and what comes back read as JSON.

A client is any object with ``complete(prompt, temperature) -> str``, made in each worker by a function so
that it need not be sent there. Calls aren't deterministic: write what they give, or settle it, before
it is used twice.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.operators import prompts
from sheaf.session import batched


class ModelClient(Protocol):
    def complete(self, prompt: str, temperature: float) -> str: ...


class AuthenticationError(Exception):
    """The model refuses the caller; raised by clients so that a batch stops instead of failing row by row."""


class EchoClient:
    """A client without a model for tests: JSON with the prompt's hash, and a thesis from its last line."""

    def complete(self, prompt: str, temperature: float) -> str:
        last = prompt.strip().rsplit("\n", 1)[-1]
        return json.dumps({"main_thesis": last[:60], "prompt_hash": hashlib.sha256(prompt.encode()).hexdigest()[:12], "key_terms": sorted(set(re.findall(r"[a-z]{6,}", last.lower())))[:5]})


def call(rows: DataFrame, prompt: str, make: Callable[[], ModelClient], temperature: float = 0.1, answer: str = "answer", error: str = "error") -> DataFrame:
    """rows with the model's answer to the prompt column, or the error that a call raised.

    Null prompts aren't sent. How many calls run at once is the number of partitions: repartition before.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", {answer} string, {error} string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for batch in batches:
            answers, errors = [], []
            for text in batch[prompt]:
                got, wrong = None, None
                if text is not None:
                    try:
                        got = client.complete(text, temperature)
                    except AuthenticationError:
                        raise
                    except Exception as e:
                        wrong = str(e) or type(e).__name__
                answers.append(got)
                errors.append(wrong)
            batch[answer], batch[error] = answers, errors
            yield batch

    return rows.mapInPandas(run, schema)


def without_fences(text: Column | str) -> Column:
    """A text without the marks of a code block."""
    text = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(text, r"```(?:yaml|json)?", ""))


def repair_json(text: str | None) -> str | None:
    """JSON out of nearly JSON: code fences and text around it, trailing commas, single quotes, bare Python
    constants, an end that is cut off. None if nothing can be read."""
    if text is None:
        return None
    body = re.sub(r"```(?:json|yaml)?", "", text).strip()
    start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    out, stack, quote, i = [], [], "", start
    while i < len(body):
        c = body[i]
        if quote:
            if c == "\\" and i + 1 < len(body):
                out.append(c + body[i + 1])
                i += 2
                continue
            if c == quote:
                out.append('"')
                quote = ""
            else:
                out.append({"\n": "\\n", "\t": "\\t", "\r": "\\r"}.get(c, '\\"' if c == '"' else c))
        elif c in "\"'":
            quote = c
            out.append('"')
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            out.append(c)
        elif c in "}]":
            while out and out[-1].strip() in ("", ","):
                out.pop()
            out.append(c)
            if stack:
                stack.pop()
            if not stack:
                break
        else:
            out.append(c)
        i += 1
    if quote:
        out.append('"')
    joined = re.sub(r"[,:\s]+$", "", "".join(out)) if stack else "".join(out)
    for close in reversed(stack):
        joined += close
    joined = re.sub(r",(\s*[}\]])", r"\1", joined)
    joined = re.sub(r"(?<=[:\[,\s])(True|False|None)(?=[\s,}\]])", lambda m: {"True": "true", "False": "false", "None": "null"}[m[1]], joined)
    try:
        return json.dumps(json.loads(joined), ensure_ascii=False)
    except ValueError:
        return None


@batched("string")
def _repaired(texts: pd.Series) -> pd.Series:
    return texts.map(repair_json)


def parsed(rows: DataFrame, answer: str, schema: str, into: str) -> DataFrame:
    """rows with the answer read by a schema (DDL), null if nothing can be read; each row once.

    One pass: Python sees the text only of answers that Spark can't read as they stand, so calls that
    stand behind ``rows`` are made once.
    """
    text = F.col(answer)
    valid = F.try_parse_json(text).isNotNull()
    mended = _repaired(F.when(text.isNotNull() & ~valid, text))
    return rows.withColumn(into, F.from_json(F.when(valid, text).otherwise(mended), schema))


def _said(answer: str | None) -> tuple[str, list[str]]:
    """(thesis, key terms) of a chapter's answer, whatever it holds."""
    read = json.loads(repair_json(answer) or "{}")
    read = read if isinstance(read, dict) else {}
    terms = read.get("key_terms")
    return str(read.get("main_thesis") or ""), [str(t) for t in terms if t is not None] if isinstance(terms, list) else []


def fold(chapters: DataFrame, make: Callable[[], ModelClient], group: str = "book_id", temperature: float = 0.1) -> DataFrame:
    """(group, number, context, answer, error): each chapter is summarised knowing the answers to those before it.

    Calls of one book depend on each other, so a book is a task; books run beside each other. What a
    task holds of a book are the prompts' parts, made before the shuffle: a title and at most the first
    and last characters of a text that a prompt takes. A chapter whose call fails has its error and
    tells the later ones nothing. chapters: group, number, title, text.
    """
    kind = dict(chapters.dtypes)[group]
    parts = chapters.select(group, F.col("number").cast("int").alias("number"), prompts.chapter_lead("title").alias("lead"), prompts.chapter_body("text").alias("body"))

    def run(book: pd.DataFrame) -> pd.DataFrame:
        client, rows, told = make(), [], []
        for chapter in book.sort_values("number").itertuples():
            context = "PREVIOUS CHAPTERS (for context):\n" + "\n".join(told) if told else "PREVIOUS CHAPTERS: This is the first chapter."
            answer, error = None, None
            try:
                answer = client.complete(chapter.lead + context + chapter.body, temperature)
            except AuthenticationError:
                raise
            except Exception as e:
                error = str(e) or type(e).__name__
            if error is None:
                thesis, terms = _said(answer)
                told.append(f"  Ch {chapter.number}: {thesis}")
                if terms:
                    told.append(f"    Key terms: {', '.join(terms[:5])}")
            rows.append((getattr(chapter, group), chapter.number, context, answer, error))
        return pd.DataFrame(rows, columns=[group, "number", "context", "answer", "error"])

    return parts.groupBy(group).applyInPandas(run, f"{group} {kind}, number int, context string, answer string, error string")
