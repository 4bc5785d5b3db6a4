"""Drifting schemas: one table out of files whose fields are renamed, retyped, added and removed.

``field_changes`` compares each file of a series with the file before it. Both schemas are graphs: a node
for every path (fields, the fields of objects within them, the elements of arrays), one for every JSON
type, edges from parent to child and from path to type. Similarity flooding over the pairs of nodes
proposes which names that vanish and names that appear belong together, by names, types and nesting alone;
the values of the papers in both files are read for what it proposes, and of the pairs that hold the same
values for most papers the highest are bound one to one. ``unified_table`` merges all names that some series
renames into each other into one column, casts each column to its declared type and unions all lines.

Null, empty, cut off or non-object lines count for nothing. Repeated lines count once. A field that is
null everywhere has no type, so it can't be retyped. An empty input gives an empty result.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.operators.hashfilter import HashFilter, hash_filter, text_hash
from sheaf.session import batched, settle

#: Rounds of flooding at most; it stops when nothing moves by more than STILL.
ROUNDS, STILL = 60, 1e-4
#: A pair is proposed if its similarity is at least this share of the best that either of its names has.
LEAST_RELATIVE = 0.02
#: Bits of the filter of names whose values are read: at most this power of two (2 MB). A fuller filter lets more values
#: through, which are dropped later; it never holds one back.
FILTER_BITS = 24
#: Values that a task holds back to merge repeats before they are shuffled.
HELD = 100_000
#: Columns of a unified table for names that no key declares; the fields under rarer names go into one map.
MOST_COLUMNS = 2_000

_NUMBER = re.compile(r"^(?:n\s*=\s*)?([+-]?\d+(?:,\d{3})*(?:\.\d+)?(?:e[+-]?\d+)?)$")


def _json_type(value: object) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list) else "object"


def _leaves(value: object) -> Iterator[str]:
    if isinstance(value, dict):
        for part in value.values():
            yield from _leaves(part)
    elif isinstance(value, list):
        for part in value:
            yield from _leaves(part)
    elif value is not None:
        yield str(value).lower() if isinstance(value, bool) else str(value)


def spelling_free(value: object) -> str | None:
    """A value without its spelling: the leaves of a container in order, case and spaces folded,
    numbers without separators, label or needless decimals. None if nothing is left."""
    if value is None:
        return None
    text = " ".join((value if isinstance(value, str) else " ".join(_leaves(value))).lower().split())
    if not text:
        return None
    # Words that begin with a letter other than the label's are no numbers.
    if text[0].isalpha() and text[0] != "n":
        return text
    if found := _NUMBER.match(text):
        number = float(found[1].replace(",", ""))
        return str(int(number)) if number == int(number) and abs(number) < 1e15 else repr(number)
    return text


def _not_json(token: str) -> None:
    raise ValueError(token)


_decode = json.JSONDecoder(parse_constant=_not_json).decode


def fields_of(record: str | None) -> dict | None:
    """The fields of a JSON object; None if a record isn't one.

    Python's parser is used as Spark's accepts text after the object and drops whether a number had a
    decimal point.
    """
    if record is None:
        return None
    try:
        fields = _decode(record)
    except (ValueError, RecursionError):
        return None
    return fields if isinstance(fields, dict) else None


def _name_words(name: str) -> set[str]:
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name)
    return set(re.split(r"[\W_]+", spaced.lower())) - {""}


@functools.lru_cache(maxsize=65_536)
def name_similarity(a: str, b: str) -> float:
    """Dice coefficient of the words of two names, and of their letter pairs, whichever is larger."""
    words_a, words_b = _name_words(a), _name_words(b)
    pairs_a, pairs_b = ({x[i : i + 2] for i in range(len(x) - 1)} for x in ("".join(sorted(words_a)), "".join(sorted(words_b))))
    dice = lambda p, q: 2 * len(p & q) / (len(p) + len(q)) if p or q else 0.0
    return max(dice(words_a, words_b), dice(pairs_a, pairs_b))


#: Between the steps of a path below a field. A name that holds it blurs the graph below that field and nothing else.
STEP = "\x1f"

Node = tuple[str, str, str | None]


def _below(name: str, path: str, value: object, out: set[Node]) -> None:
    """The nodes of a container and of what it holds, as (field, path below it, type)."""
    out.add((name, path, _json_type(value)))
    if isinstance(value, dict):
        for key, part in value.items():
            _below(name, f"{path}{STEP}{key}", part, out)
    elif isinstance(value, list):
        for part in value:
            _below(name, f"{path}{STEP}[]", part, out)


_TYPES = {type(None): None, bool: "boolean", int: "integer", float: "number", str: "string"}


def flood(before: list[Node], after: list[Node]) -> list[tuple[str, str, float]]:
    """Similarity flooding of two schemas given as nodes: (old, new, similarity) of every pair of a name that
    vanishes and one that appears.

    The nodes of the propagation graph are pairs: of the roots, of fields (names that stay are bound to
    themselves, each of the others may meet each), of the paths below a pair of fields, of types. An edge
    runs where both schemas have one of the same label: from parent to child, from path to type. Along an
    edge a pair gives its similarity to its neighbours, shared equally among those of a label, in both
    directions. A round adds to each pair its first similarity (that of the names; 1 for equal types) and
    what its neighbours give, and divides all by the largest, until nothing moves.
    """
    shape: list[dict[str, dict[str, set[str]]]] = [{}, {}]
    for fields, nodes in zip(shape, (before, after)):
        for name, path, kind in nodes:
            types = fields.setdefault(name, {}).setdefault(path, set())
            if kind:
                types.add(kind)
    a, b = shape
    gone, come = sorted(a.keys() - b.keys()), sorted(b.keys() - a.keys())
    if not gone or not come:
        return []
    first: list[float] = [1.0]
    kinds: dict[tuple[str, str], int] = {}
    edges: list[tuple[int, int, bool]] = []

    def pair(parent: int, similarity: float, of_a: dict[str, set[str]], of_b: dict[str, set[str]], path_a: str, path_b: str) -> int:
        at = len(first)
        first.append(similarity)
        edges.append((parent, at, False))
        for x in of_a[path_a]:
            for y in of_b[path_b]:
                kind = kinds.get((x, y))
                if kind is None:
                    kind = kinds[x, y] = len(first)
                    first.append(1.0 if x == y else 0.1)
                edges.append((at, kind, True))
        if len(of_a) > 1 and len(of_b) > 1:
            for p in _children(of_a, path_a):
                for q in _children(of_b, path_b):
                    pair(at, name_similarity(p.rsplit(STEP, 1)[1], q.rsplit(STEP, 1)[1]), of_a, of_b, p, q)
        return at

    for name in a.keys() & b.keys():
        pair(0, 1.0, a[name], b[name], "", "")
    where = [[pair(0, name_similarity(x, y), a[x], b[y], "", "") for y in come] for x in gone]
    size = len(first)
    outgoing, incoming = Counter((x, label) for x, _, label in edges), Counter((y, label) for _, y, label in edges)
    flow = np.zeros((size, size))
    for x, y, label in edges:
        flow[y, x] += 1 / outgoing[x, label]
        flow[x, y] += 1 / incoming[y, label]
    start = np.array(first)
    now = start
    for _ in range(ROUNDS):
        given = start + now
        new = given + flow @ given
        new /= new.max()
        moved = np.abs(new - now).max()
        now = new
        if moved < STILL:
            break
    return [(x, y, float(now[where[i][j]])) for i, x in enumerate(gone) for j, y in enumerate(come)]


def _children(paths: dict[str, set[str]], path: str) -> list[str]:
    return [p for p in paths if p.startswith(path + STEP) and STEP not in p[len(path) + 1 :]]


def proposed(similarities: list[tuple[str, str, float]], least: float = LEAST_RELATIVE) -> list[tuple[str, str, float]]:
    """The pairs whose similarity isn't far below the best that either name has, highest first."""
    best_old, best_new = defaultdict(float), defaultdict(float)
    for old, new, score in similarities:
        best_old[old], best_new[new] = max(best_old[old], score), max(best_new[new], score)
    kept = [(old, new, score) for old, new, score in similarities if score >= least * max(best_old[old], best_new[new])]
    return sorted(kept, key=lambda p: (-p[2], p[0], p[1]))


@batched("array<struct<old:string,new:string,score:double,old_hash:bigint,new_hash:bigint>>")
def _proposals(names_a: pd.Series, paths_a: pd.Series, types_a: pd.Series, names_b: pd.Series, paths_b: pd.Series, types_b: pd.Series) -> pd.Series:
    signed = lambda text: int(np.uint64(text_hash(text)).astype(np.int64))

    def one(*parts):
        if parts[0] is None:
            return None
        found = proposed(flood(list(zip(*parts[:3])), list(zip(*parts[3:]))))
        return [{"old": a, "new": b, "score": s, "old_hash": signed(a), "new_hash": signed(b)} for a, b, s in found]

    return pd.Series([one(*row) for row in zip(names_a, paths_a, types_a, names_b, paths_b, types_b)])


def schemas(lines: DataFrame) -> DataFrame:
    """(series_id, file_no, nodes): the schema graph of each file with a line, settled.

    Nodes come from the lines of a batch once, however many lines hold them, and are merged before the
    shuffle. A file counts if it has a line at all, so one whose lines are all unreadable has no nodes.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # Most records of a file have the same names and types: those are looked at once.
            shapes: dict[tuple[int, int], set] = defaultdict(set)
            nodes: dict[tuple[int, int], set[Node]] = defaultdict(set)
            for series, number, record in zip(batch["series_id"], batch["file_no"], batch["record"]):
                file = (series, number)
                fields = fields_of(record)
                if fields is None:
                    shapes[file]
                    continue
                types = tuple(map(type, fields.values()))
                shapes[file].add((tuple(fields), types))
                if dict in types or list in types:
                    for name, value in fields.items():
                        if isinstance(value, dict | list):
                            _below(name, "", value, nodes[file])
            rows = []
            for file, seen in shapes.items():
                found = nodes[file]
                for names, types in seen:
                    found.update((n, "", _TYPES[t]) for n, t in zip(names, types) if t is not dict and t is not list)
                rows += [(*file, *node) for node in found] or [(*file, None, None, None)]
            yield pd.DataFrame(rows, columns=["series_id", "file_no", "name", "path", "type"])

    named = lines.where("series_id is not null and file_no is not null").select("series_id", "file_no", "record")
    nodes = named.mapInPandas(read, "series_id bigint, file_no int, name string, path string, type string")
    node = F.when(F.col("name").isNotNull(), F.struct("name", "path", "type"))
    return settle(nodes.groupBy("series_id", "file_no").agg(F.collect_set(node).alias("nodes")))


def _steps(files: DataFrame) -> DataFrame:
    """A row for each file that differs from the one before it (file_no - 1): series_id, file_no, gone, come, retyped
    (names that stay), proposals (each with retyped). Settled: as large as the schemas' changes."""
    top = F.array_sort(F.filter("nodes", lambda n: n["path"] == ""))
    names = F.array_sort(F.array_distinct(F.transform(top, lambda n: n["name"])))
    shaped = files.select("series_id", "file_no", "nodes", names.alias("names"), top.alias("top"))
    later = shaped.where("file_no > 1").select("series_id", "file_no", *(F.col(c).alias(f"{c}_b") for c in ("nodes", "names", "top")))
    earlier = shaped.select("series_id", (F.col("file_no") + 1).alias("file_no"), *(F.col(c).alias(f"{c}_a") for c in ("nodes", "names", "top")))
    both = later.join(earlier, ["series_id", "file_no"]).withColumns({"gone": F.array_except("names_a", "names_b"), "come": F.array_except("names_b", "names_a")})
    types = lambda side, name: f"transform(filter(top_{side}, t -> t.name = {name} and t.type is not null), t -> t.type)"
    differ = lambda x, y: f"size({types('a', x)}) > 0 and size({types('b', y)}) > 0 and {types('a', x)} != {types('b', y)}"
    both = both.withColumn("retyped", F.expr(f"filter(array_intersect(names_a, names_b), n -> {differ('n', 'n')})")).where("size(gone) + size(come) + size(retyped) > 0")
    # Matching is dear for its size, so it's spread over tasks by number, not by size.
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = both.repartition(tasks, "series_id", "file_no")
    is_open = F.expr("size(gone) > 0 and size(come) > 0")
    part = lambda side, of: F.when(is_open, F.transform(f"nodes_{side}", lambda n: n[of]))
    matched = spread.withColumn("proposals", _proposals(*(part(side, of) for side in "ab" for of in ("name", "path", "type"))))
    checked = F.expr(f"transform(coalesce(proposals, array()), p -> struct(p.old, p.new, p.old_hash, p.new_hash, {differ('p.old', 'p.new')} as retyped))")
    return settle(matched.select("series_id", "file_no", "gone", "come", "retyped", checked.alias("proposals")))


def _file_key(series: int, number: int) -> str:
    return f"{series}/{number}"


def _name_key(series: int, number: int, is_new: bool, name: str) -> str:
    return f"{series}/{number}/{int(is_new)}/{name}"


def _name_filter(steps: DataFrame) -> HashFilter:
    """The filter of the names (and their files) whose values the steps' proposals need."""
    before, after = F.concat_ws("/", F.col("series_id"), F.col("file_no") - 1), F.concat_ws("/", F.col("series_id"), F.col("file_no"))
    named = F.concat(F.transform("proposals", lambda p: F.concat(before, F.lit("/0/"), p["old"])), F.transform("proposals", lambda p: F.concat(after, F.lit("/1/"), p["new"])))
    keys = steps.where("size(proposals) > 0").select(F.explode(F.array_distinct(F.concat(F.array(before, after), named))).alias("key"))
    return hash_filter(keys.select(F.xxhash64("key").alias("hash")), "hash", FILTER_BITS)


def _values(lines: DataFrame, steps: DataFrame) -> DataFrame:
    """(series_id, step, paper, is_new, name, line_no, value) of the values that the steps' proposals need, and a few
    more; papers, names and values as 64-bit hashes. Lines of files without proposals aren't parsed."""
    shared = lines.sparkSession.sparkContext.broadcast(_name_filter(steps))
    columns = ["series_id", "step", "paper", "is_new", "name", "line_no", "value"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = shared.value
        held: dict[tuple, tuple[int, int]] = {}

        def given() -> pd.DataFrame:
            keys, found = list(zip(*held)) or [()] * 5, list(zip(*held.values())) or [()] * 2
            hashes = lambda x: np.array(x, dtype=np.uint64).view(np.int64)
            frame = pd.DataFrame(dict(zip(columns, (keys[0], keys[1], hashes(keys[2]), np.array(keys[3], dtype=bool), hashes(keys[4]), found[0], hashes(found[1])))))
            held.clear()
            return frame.astype({"series_id": "int64", "step": "int32", "line_no": "int32"})

        for batch in batches:
            # Per file: the names met, each with its hash and whether the file is looked at as the earlier and as the later one.
            files: dict[tuple[int, int], dict[str, tuple[int, bool, bool] | None] | None] = {}
            for series, number, line, record in zip(batch["series_id"], batch["file_no"], batch["line_no"], batch["record"]):
                file = (series, number)
                if file not in files:
                    files[file] = {} if text_hash(_file_key(series, number)) in wanted else None
                names = files[file]
                if names is None or (fields := fields_of(record)) is None or (paper := spelling_free(fields.get("paper_id"))) is None:
                    continue
                paper = text_hash(paper)
                for name, value in fields.items():
                    if name not in names:
                        as_old, as_new = (text_hash(_name_key(series, number, is_new, name)) in wanted for is_new in (False, True))
                        names[name] = (text_hash(name), as_old, as_new) if as_old or as_new else None
                    roles = names[name]
                    if roles is None or (spelled := spelling_free(value)) is None:
                        continue
                    found = (line, text_hash(spelled))
                    for is_new, step in ((False, number + 1), (True, number)):
                        if roles[1 + is_new]:
                            key = (series, step, paper, is_new, roles[0])
                            if key not in held or held[key][0] <= line:
                                held[key] = found
                if len(held) >= HELD:
                    yield given()
        yield given()

    named = lines.where("record is not null and series_id is not null and file_no is not null").select("series_id", "file_no", F.coalesce("line_no", F.lit(0)).alias("line_no"), "record")
    return named.mapInPandas(read, "series_id bigint, step int, paper bigint, is_new boolean, name bigint, line_no int, value bigint")


def _agreeing(values: DataFrame) -> DataFrame:
    """(series_id, file_no, agreeing array<struct<old,new>>): the pairs of names that hold the same value for most
    papers in both files that have both. Of a paper given twice in a file, the last line counts."""
    # One shuffle by paper serves both aggregates: no paper is hot, as its repeats are merged before.
    last = values.repartition("series_id", "step", "paper").groupBy("series_id", "step", "paper", "is_new", "name").agg(F.max_by("value", "line_no").alias("value"))
    # A paper has at most one value per name and role: the lists are as long as the schemas.
    side = lambda is_new: F.filter("all", lambda x: x["is_new"] == F.lit(is_new))
    per_paper = last.groupBy("series_id", "step", "paper").agg(F.collect_list(F.struct("is_new", "name", "value")).alias("all"))
    pairs = per_paper.select("series_id", "step", F.explode(side(False)).alias("o"), side(True).alias("news")).select("series_id", "step", "o", F.explode("news").alias("n"))
    counted = pairs.groupBy("series_id", "step", F.col("o.name").alias("old"), F.col("n.name").alias("new")).agg(
        F.count("*").alias("both"), F.sum((F.col("o.value") == F.col("n.value")).cast("long")).alias("same")
    )
    same = counted.where("same * 2 > both")
    return same.groupBy("series_id", F.col("step").alias("file_no")).agg(F.collect_list(F.struct("old", "new")).alias("agreeing"))


def transitions(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """A row for each file with file_no above 1 that differs from the one before: gone, come, retyped, renames.

    A file whose predecessor (file_no - 1) is missing is compared with nothing and left out. The lines are
    parsed twice: for the schemas (``files``, if they have been read already), then for the values under the
    names that flooding proposes.
    """
    steps = _steps(schemas(lines) if files is None else files)
    joined = steps.join(_agreeing(_values(lines, steps)), ["series_id", "file_no"], "left")
    # The exact check, then one to one: proposals come highest first.
    agree = "filter(proposals, p -> exists(coalesce(agreeing, array()), e -> e.old = p.old_hash and e.new = p.new_hash))"
    bound = f"aggregate({agree}, slice(proposals, 1, 0), (bound, p) -> if(exists(bound, q -> q.old = p.old or q.new = p.new), bound, concat(bound, array(p))))"
    return joined.withColumn("renames", F.expr(bound)).select("series_id", "file_no", "gone", "come", "retyped", "renames")


def field_changes(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The report: series_id, file_no, field, change (renamed, removed, added, retyped), renamed_to."""
    row = lambda name, change, to="''": f"named_struct('field', {name}, 'change', '{change}', 'renamed_to', {to})"
    changes = F.expr(f"""concat(
        transform(renames, r -> {row('r.old', 'renamed', 'r.new')}),
        transform(filter(gone, g -> not exists(renames, r -> r.old = g)), g -> {row('g', 'removed')}),
        transform(filter(come, g -> not exists(renames, r -> r.new = g)), g -> {row('g', 'added')}),
        transform(retyped, n -> {row('n', 'retyped')}),
        transform(filter(renames, r -> r.retyped), r -> {row('r.old', 'retyped')})
    )""")
    return transitions(lines, files).select("series_id", "file_no", F.explode(changes).alias("c")).select("series_id", "file_no", "c.field", "c.change", "c.renamed_to")


def correspondences(changes: DataFrame, declared: list[str], limit: int = 100_000) -> dict[str, str]:
    """Each name that some series renames -> the column that takes it.

    Only pairs of names come to the driver: a schema's size, whatever the lines. ``limit`` bounds them;
    beyond it the call fails instead of dropping pairs. A group of names goes to the declared key in
    it, else to its most often renamed name. Pairs of two declared keys don't merge groups.
    """
    pairs = changes.where("change = 'renamed'").groupBy("field", "renamed_to").count().limit(limit + 1).collect()
    if len(pairs) > limit:
        raise ValueError(f"more than {limit} pairs of names")
    group: dict[str, str] = {}

    def top(name: str) -> str:
        while group.setdefault(name, name) != name:
            name = group[name]
        return name

    seen: dict[str, int] = {}
    for a, b, n in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        seen[a], seen[b] = seen.get(a, 0) + n, seen.get(b, 0) + n
        x, y = top(a), top(b)
        if x == y or (x in declared and y in declared):
            continue
        if y in declared or (x not in declared and (-seen[y], y) < (-seen[x], x)):
            x, y = y, x
        group[y] = x
    return {name: top(name) for name in group}


_CASTS = {
    "integer": lambda v: F.coalesce(F.try_to_number(v, F.lit("999999999999999999")), v.try_cast("decimal(38,6)")).cast("bigint"),
    "float": lambda v: v.try_cast("double"),
    "string": lambda v: v,
}


def _columns(names: list[str], into: dict[str, str]) -> dict[str, list[str]]:
    """Field of the table -> the names that it takes, in name order."""
    columns: dict[str, list[str]] = {}
    for name in sorted(names):
        columns.setdefault(into.get(name, name), []).append(name)
    return columns


def unified_table(lines: DataFrame, declared: dict[str, str]) -> DataFrame:
    """One row per readable line (repeats once), one column per field, declared types kept.

    declared: key -> string, integer or float. A value that can't be cast is null in its column. Fields
    that are no declared key become string columns; where several names of one column occur in a
    record, the first in name order with a value counts. Columns: series_id, file_no,
    line_no (the first of the repeats), then by name, then other_fields. Names that clash with an earlier column
    (declared keys come first, case doesn't count) get a number. Of the names that no key declares the MOST_COLUMNS in most files are columns;
    fields under rarer ones are kept in the map other_fields, which is null where there are none.
    """
    files = schemas(lines)
    into = correspondences(field_changes(lines, files), list(declared))
    # Declared and renamed names come first; what comes to the driver is as many names as the table has columns for.
    chosen = sorted({*declared, *into})
    first = lines.sparkSession.createDataFrame([(n, True) for n in chosen], "name string, chosen boolean")
    names = files.select(F.explode(F.expr("array_distinct(transform(nodes, n -> n.name))")).alias("name")).groupBy("name").count()
    found = names.join(first, "name", "left").orderBy(F.desc_nulls_last("chosen"), F.desc("count"), "name").limit(len(chosen) + MOST_COLUMNS)
    columns = _columns([r["name"] for r in found.collect()], into)
    order = sorted(columns)
    taken = {n: 1 for n in ("series_id", "file_no", "line_no", "other_fields")}
    titles = {}
    for target in sorted(order, key=lambda t: t not in declared):
        n = taken[target.lower()] = taken.get(target.lower(), 0) + 1
        titles[target] = target if n == 1 else f"{target}_{n}"
    plain = [(columns[t], declared.get(t, "string") == "string") for t in order]
    held = {n for of in columns.values() for n in of}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for series, number, line, record in zip(batch["series_id"], batch["file_no"], batch["line_no"], batch["record"]):
                fields = fields_of(record)
                if fields is None:
                    continue
                cells = []
                for of, raw in plain:
                    found = None
                    for name in of:
                        if name in fields and (spelled := spelling_free(fields[name])) is not None:
                            found = _text(fields[name]) if raw else spelled
                            break
                    cells.append(found)
                more = {n: _text(v) for n, v in fields.items() if n not in held and spelling_free(v) is not None} if len(fields.keys() - held) else None
                rows.append((series, number, line, *cells, more or None))
            # By position: titles of fields may repeat those of other columns.
            frame = pd.DataFrame(rows, columns=range(len(order) + 4))
            frame.columns = ["series_id", "file_no", "line_no", *(f"c{i}" for i in range(len(order))), "other_fields"]
            yield frame

    once = lines.where("record is not null").groupBy("series_id", "file_no", "record").agg(F.min("line_no").alias("line_no"))
    # Whole numbers with nulls would pass through Python as fractions: they go as text.
    whole = {"series_id": "bigint", "file_no": "int", "line_no": "int"}
    schema = "series_id string, file_no string, line_no string, " + "".join(f"c{i} string, " for i in range(len(order))) + "other_fields map<string,string>"
    cells = once.select(*(F.col(c).cast("string").alias(c) for c in whole), "record").mapInPandas(read, schema)
    typed = [_CASTS[declared.get(t, "string")](F.col(f"c{i}")).alias(titles[t]) for i, t in enumerate(order)]
    return cells.select(*(F.col(c).cast(t).alias(c) for c, t in whole.items()), *typed, "other_fields")


def _text(value: object) -> str | None:
    """A value as text: a string as it is, else the text of its leaves."""
    return value if isinstance(value, str) else " ".join(_leaves(value)) or None
