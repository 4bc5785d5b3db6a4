"""Nested records turned into related flat tables by interval labels.

``label_nodes`` walks each record depth first and labels every node with an interval, from its own
pre-order number to that at which its walk ends (its post-order mark):
a node lies within another exactly if its interval [pre, post] does. Nodes of a kind make one table;
children are linked to the node of the parent kind whose interval holds theirs (``within``), summaries
outside of chapters to the first chapter of their number.

Nodes are the record (item_no 0), chapters, summaries, syntheses, terms and themes, and beside these every
object and array element under any other field, with the field's name as their kind: fields that nobody
foresaw become tables of their own. Values of other fields are attributes, containers among them as JSON too.

The walk reads the same part in all its shapes: a list, an object keyed by number (in the order of the
numbers), an object with the list under ``items``, JSON inside a string, a single object. A null,
unreadable or non-object record has no nodes; neither have null and blank terms or themes. A term given
as an object is its ``term``; a text with semicolons or line breaks holds several. Repeats all count.
Records of any length are walked whole. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.session import settle

NODES = "record_id bigint, kind string, pre int, post int, depth int, item_no int, number int, attributes map<string,string>"


def _opened(part: object) -> object:
    """A part as it is, or as the JSON in its text says."""
    if isinstance(part, str) and part.lstrip()[:1] in ("[", "{"):
        try:
            return json.loads(part)
        except (ValueError, RecursionError):
            return part
    return part


def whole_number(value: object) -> int | None:
    """The number in 3, 3.0, "03", " 3 ", "Ch 3" or "Chapter 3"; None if there is none."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, int | float):
        return int(value) if value == value and abs(value) < 2**31 and value == int(value) else None
    if isinstance(value, str) and (found := re.fullmatch(r"\D*?(-?\d{1,9})(?:\.0+)?\D*", value)):
        return int(found[1])
    return None


def _items(part: object) -> Iterator[tuple[int | None, object]]:
    """(key as a number, item) of a part in any of its shapes, in order; nulls are no items."""
    part = _opened(part)
    if isinstance(part, dict):
        if part and all(whole_number(k) is not None for k in part):
            for key in sorted(part, key=whole_number):
                if part[key] is not None:
                    yield whole_number(key), part[key]
        elif isinstance(part.get("items"), list | dict | str):
            yield from _items(part["items"])
        elif part:
            yield None, part
    elif isinstance(part, list):
        for item in part:
            if item is not None:
                yield None, item


def texts(part: object) -> list[str]:
    """The terms or themes of a part, blanks left out."""
    part = _opened(part)
    if isinstance(part, str):
        return [t for t in map(str.strip, re.split(r"[;\n]", part)) if t]
    if isinstance(part, dict):
        if isinstance(part.get("items"), list):
            return texts(part["items"])
        for name in ("term", "theme", "name"):
            if name in part:
                return texts(part[name])
        if part and all(whole_number(k) is not None for k in part):
            return [t for k in sorted(part, key=whole_number) for t in texts(part[k])]
        return []
    if isinstance(part, list):
        return [t for item in part for t in texts(item)]
    return [] if part is None or isinstance(part, bool) else [str(part)]


def _plain(fields: dict, skip: tuple[str, ...]) -> dict[str, str]:
    return {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in fields.items() if v is not None and k not in skip}


def _parts(value: object) -> list[tuple[int, object]]:
    """(position, part) of what makes nodes of a field, last first: an object, or the elements of an array; values make none."""
    if isinstance(value, dict):
        return [(1, value)]
    return [(n, x) for n, x in reversed(list(enumerate(value, 1))) if x is not None] if isinstance(value, list) else []


def walk(record: str | None) -> list[tuple]:
    """Nodes of a record: (kind, pre, post, depth, item_no, number, attributes)."""
    try:
        top = json.loads(record) if record is not None else None
    except (ValueError, RecursionError):
        return []
    if not isinstance(top, dict):
        return []
    nodes: list[list] = []
    clock = {"pre": 0}
    counts = {"chapter": 0, "summary": 0, "synthesis": 0, "key_theme": 0}

    def enter(kind: str, depth: int, item_no: int, number: int | None, attributes: dict[str, str]) -> list:
        clock["pre"] += 1
        nodes.append([kind, clock["pre"], 0, depth, item_no, number, attributes])
        return nodes[-1]

    def leave(node: list) -> None:
        # The interval ends at the last pre-order number given out inside the node.
        node[2] = clock["pre"]

    def summary(part: object, key: int | None, depth: int) -> None:
        part = _opened(part)
        if not isinstance(part, dict):
            return
        counts["summary"] += 1
        number = whole_number(part["chapter_num"]) if part.get("chapter_num") is not None else key
        node = enter("summary", depth, counts["summary"], number, _plain(part, ("key_terms",)))
        for n, term in enumerate(texts(part.get("key_terms")), 1):
            leave(enter("key_term", depth + 1, n, None, {"text": term}))
        others(part, ("key_terms",), depth + 1)
        leave(node)

    def others(fields: dict, known: tuple[str, ...], depth: int) -> None:
        """The nodes under the fields of an object that no kind above reads, depth first without recursion."""
        todo: list = [(name, part, depth, n) for name, value in reversed(fields.items()) if name not in known for n, part in _parts(value)]
        while todo:
            item = todo.pop()
            if len(item) == 1:
                leave(item[0])
                continue
            name, part, at, n = item
            inner = part if isinstance(part, dict) else {}
            node = enter(name, at, n, None, _plain(inner, ()) if isinstance(part, dict) else {"text": part if isinstance(part, str) else json.dumps(part, ensure_ascii=False)})
            todo.append((node,))
            if isinstance(part, list):
                todo += [(name, x, at + 1, k) for k, x in _parts(part)]
            todo += [(field, x, at + 1, k) for field, value in reversed(inner.items()) for k, x in _parts(value)]

    root = enter("record", 0, 0, None, _plain(top, ("chapters", "summaries", "synthesis")))
    for name, part in top.items():
        if name == "chapters":
            for key, item in _items(part):
                item = _opened(item)
                if not isinstance(item, dict):
                    continue
                counts["chapter"] += 1
                number = whole_number(item["number"]) if item.get("number") is not None else key
                node = enter("chapter", 1, counts["chapter"], number, _plain(item, ("summary", "summaries")))
                for inner in ("summary", "summaries"):
                    inside = _opened(item.get(inner))
                    for k, s in [(None, inside)] if isinstance(inside, dict) and "main_thesis" in inside else _items(inside):
                        summary(s, k, 2)
                others(item, ("summary", "summaries"), 2)
                leave(node)
        elif name == "summaries":
            for key, item in _items(part):
                summary(item, key, 1)
        elif name == "synthesis":
            for _, item in _items(part):
                item = _opened(item)
                if not isinstance(item, dict):
                    continue
                counts["synthesis"] += 1
                node = enter("synthesis", 1, counts["synthesis"], None, _plain(item, ("key_themes",)))
                for theme in texts(item.get("key_themes")):
                    counts["key_theme"] += 1
                    leave(enter("key_theme", 2, counts["key_theme"], None, {"text": theme}))
                others(item, ("key_themes",), 2)
                leave(node)
        else:
            others({name: part}, (), 1)
    leave(root)
    return [tuple(n) for n in nodes]


def label_nodes(records: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """A row per node of every record (record_id, record), with interval labels; see NODES. kinds: only these leave Python,
    without their attributes."""

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in NODES.split(", ")]
        for batch in batches:
            nodes = ((i, *node) for i, r in zip(batch["record_id"], batch["record"]) for node in walk(r))
            kept = list(nodes) if kinds is None else [(*n[:7], None) for n in nodes if n[1] in kinds]
            yield pd.DataFrame(kept, columns=names).astype({"number": "Int32"})

    return records.where("record is not null").select("record_id", "record").mapInPandas(label, NODES)


def within(nodes: DataFrame, **parents: str) -> DataFrame:
    """nodes with a column for each parent kind given (column=kind): the item_no of the node of that kind whose interval
    holds theirs, null if none does.

    Nodes of a parent kind don't nest, so the holder can only be the last one that began before: one window by
    pre-order number serves all kinds, instead of joins on ranges.
    """
    order = Window.partitionBy("record_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    holder = lambda kind: F.last(F.when(F.col("kind") == kind, F.struct("pre", "post", "item_no")), ignorenulls=True).over(order)
    both = nodes.withColumns({f"_{column}": holder(kind) for column, kind in parents.items()})
    inside = lambda column: (F.col(f"_{column}.pre") < F.col("pre")) & (F.col("post") <= F.col(f"_{column}.post"))
    return both.withColumns({c: F.when(inside(c), F.col(f"_{c}.item_no")) for c in parents}).drop(*(f"_{c}" for c in parents))


def chapters(nodes: DataFrame) -> DataFrame:
    """record_id, chapter_no, number, title, start_page, end_page, confidence."""
    a = F.col("attributes")
    return nodes.where("kind = 'chapter'").select(
        "record_id", F.col("item_no").alias("chapter_no"), "number", a["title"].alias("title"),
        a["start_page"].try_cast("int").alias("start_page"), a["end_page"].try_cast("int").alias("end_page"), a["confidence"].try_cast("double").alias("confidence"),
    )


def _placed(held: DataFrame) -> DataFrame:
    """The summaries among nodes (with in_chapter) with chapter_no: the chapter that holds them, else the first of their number, else 0."""
    first = held.where("kind = 'chapter' and number is not null").groupBy("record_id", "number").agg(F.min("item_no").alias("_first"))
    joined = held.where("kind = 'summary'").join(first, ["record_id", "number"], "left")
    return joined.withColumn("chapter_no", F.coalesce("in_chapter", "_first", F.lit(0)).cast("int")).drop("_first")


def summaries(nodes: DataFrame) -> DataFrame:
    """record_id, summary_no, chapter_no (0 if none) and the text fields."""
    text = [F.col("attributes")[c].alias(c) for c in ("main_thesis", "unique_insight", "key_evidence", "counterexample", "how_to", "practical_implications", "builds_on", "golden_quote")]
    return _placed(within(nodes, in_chapter="chapter")).select("record_id", F.col("item_no").alias("summary_no"), "chapter_no", *text)


def key_terms(nodes: DataFrame) -> DataFrame:
    """record_id, summary_no, term_no, term."""
    held = within(nodes, in_summary="summary").where("kind = 'key_term'")
    return held.select("record_id", F.col("in_summary").alias("summary_no"), F.col("item_no").alias("term_no"), F.col("attributes")["text"].alias("term"))


def key_themes(nodes: DataFrame) -> DataFrame:
    """record_id, theme_no, theme."""
    return nodes.where("kind = 'key_theme'").select("record_id", F.col("item_no").alias("theme_no"), F.col("attributes")["text"].alias("theme"))


#: Parent kind of each relation; a record is parent number 0.
PARENTS = {"chapter": "record", "summary": "chapter", "key_term": "summary", "key_theme": "record"}


def links(records: DataFrame) -> DataFrame:
    """One row per child: record_id, relation, parent_no, item_no. The records are walked once; each parent is the node
    whose interval holds the child's, but for summaries outside of chapters."""
    nodes = label_nodes(records, ("record", *PARENTS)).drop("attributes")
    held = settle(within(nodes, in_record="record", in_chapter="chapter", in_summary="summary"))
    parent = F.when(F.col("kind") == "key_term", F.col("in_summary")).otherwise(F.col("in_record"))
    flat = held.where("kind in ('chapter', 'key_term', 'key_theme')").select("record_id", F.col("kind").alias("relation"), parent.alias("parent_no"), "item_no")
    placed = _placed(held).select("record_id", F.lit("summary").alias("relation"), F.col("chapter_no").alias("parent_no"), "item_no")
    return flat.unionByName(placed)
