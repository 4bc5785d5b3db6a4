"""Drifting schemas, nested records and units against brute force and on awkward input."""

import json
import random
from fractions import Fraction

import numpy as np
import pytest

from sheaf.operators import drift, nested, units
from sheaf.plans import training

LINES = "series_id bigint, review string, file_no int, line_no int, record string, name string, cells string"


def changes_by_hand(lines):
    files = {}
    for series, number, record in lines:
        seen = files.setdefault((series, number), {})
        if (fields := drift.fields_of(record)) is not None:
            seen[fields.get("paper_id")] = fields
    out = set()
    for (s, f), after in files.items():
        before = files.get((s, f - 1))
        if f == 1 or before is None:
            continue
        kinds = lambda d: {k: {drift._json_type(o[k]) for o in d.values() if k in o} - {None} for o in d.values() for k in o}
        a, b = kinds(before), kinds(after)
        gone, come = set(a) - set(b), set(b) - set(a)
        out |= {(s, f, k, "retyped", "") for k in set(a) & set(b) if a[k] and b[k] and a[k] != b[k]}
        for x in sorted(gone):
            for y in sorted(come):
                both = [(drift.spelling_free(before[p][x]), drift.spelling_free(after[p][y])) for p in before if p in after and x in before[p] and y in after[p]]
                both = [v for v in both if None not in v]
                if both and 2 * sum(p == q for p, q in both) > len(both):
                    out.add((s, f, x, "renamed", y))
                    gone.discard(x)
                    come.discard(y)
                    if a[x] and b[y] and a[x] != b[y]:
                        out.add((s, f, x, "retyped", ""))
                    break
        out |= {(s, f, x, "removed", "") for x in gone} | {(s, f, y, "added", "") for y in come}
    return out


def test_changes_on_the_tables(spark, folder):
    lines = spark.read.parquet(f"{folder}/matrix_files.parquet")
    want = changes_by_hand([tuple(r) for r in lines.orderBy("series_id", "file_no", "line_no").select("series_id", "file_no", "record").collect()])
    assert want and {tuple(r) for r in drift.field_changes(lines).collect()} == want


def test_changes_of_all_kinds(spark):
    def file(number, *objects):
        return [(1, "r", number, i, o if isinstance(o, str) else json.dumps(o), "clash", "clash") for i, o in enumerate(objects)]

    rows = (
        file(1, *[{"paper_id": f"p{i}", "n": i * 10, "old": f"Alpha {i}", "x": None, "gone": 1} for i in range(5)])
        + file(2, *[{"paper_id": f"p{i}", "n": f"N = {i * 10}", "new": [f"alpha {i}"], "x": None, "Old": "no"} for i in range(5)], '{"cut', "NaN", "[1]", '{"paper_id": "p0", "n": NaN}')
        + file(2, {"paper_id": "p0", "n": "N = 0", "new": ["alpha 0"], "x": None, "Old": "no"})
        + [(None, None, None, None, None, None, None), (2, None, 1, 1, "", None, None), (2, None, 2, 1, '{"a": 1}', None, None)]
    )
    got = {tuple(r) for r in drift.field_changes(spark.createDataFrame(rows, LINES)).collect()}
    assert got == {
        (1, 2, "old", "renamed", "new"), (1, 2, "old", "retyped", ""), (1, 2, "n", "retyped", ""), (1, 2, "gone", "removed", ""), (1, 2, "Old", "added", ""), (2, 2, "a", "added", ""),
    }
    table = drift.unified_table(spark.createDataFrame(rows[:11], LINES).where("file_no is not null"), {"n": "integer", "old": "string"})
    assert {"n", "old", "gone", "paper_id", "x"} <= set(table.columns) and "new" not in table.columns
    assert sorted(r["n"] for r in table.where("file_no = 2").collect()) == [0, 10, 20, 30, 40]


def test_every_declared_key_counts(spark, tmp_path):
    spec = spark.range(1500).selectExpr("'r' AS review", "'k' || id AS key", "'' AS description", "if(id % 2 = 0, 'integer', 'string') AS type")
    spec.write.parquet(str(tmp_path / "schema_spec.parquet"))
    assert training.declared(spark, str(tmp_path)) == {f"k{i}": "string" if i % 2 else "integer" for i in range(1500)}


def test_no_changes_of_nothing(spark):
    empty = spark.createDataFrame([], LINES)
    assert drift.field_changes(empty).count() == 0
    assert drift.unified_table(empty, {"n": "integer"}).count() == 0


def nodes(schema):
    """The nodes of a schema given as field -> type, or as field -> {path below: type}."""
    return [(n, p, t) for n, below in schema.items() for p, t in (below.items() if isinstance(below, dict) else [("", below)])]


def test_flooding_uses_types_and_nesting():
    best = lambda a, b: {x[:2] for x in [max((p for p in drift.flood(nodes(a), nodes(b)) if p[0] == old), key=lambda p: p[2]) for old in a.keys() - b.keys()]}
    # Names without a word in common: types alone tell them apart.
    before = {"methodology": "string", "sample": "integer", "title": "string", "year": "integer"}
    after = {"approach": "string", "n": "integer", "title": "string", "year": "integer"}
    assert best(before, after) == {("methodology", "approach"), ("sample", "n")}
    # Equal types: what lies below tells them apart.
    before = {"alpha": {"": "object", "\x1fvalue": "string", "\x1fnote": "string"}, "beta": {"": "object", "\x1flow": "number", "\x1fhigh": "number"}}
    after = {"gamma": {"": "object", "\x1flow": "number", "\x1fhigh": "number"}, "delta": {"": "object", "\x1fvalue": "string", "\x1fnote": "string"}}
    assert best(before, after) == {("alpha", "delta"), ("beta", "gamma")}
    assert drift.flood([], nodes(after)) == [] and drift.flood(nodes(before), nodes(before)) == []
    # What flooding leaves far below the best isn't proposed.
    assert drift.proposed([("a", "x", 1.0), ("a", "y", 0.01), ("b", "y", 0.5), ("b", "x", 0.4)]) == [("a", "x", 1.0), ("b", "y", 0.5), ("b", "x", 0.4)]


def test_only_what_flooding_proposes_is_renamed(spark, folder, monkeypatch):
    """Without propagation names without a likeness get nothing, and their renames are lost."""
    lines = spark.read.parquet(f"{folder}/matrix_files.parquet")
    rows = [tuple(r) for r in lines.select("series_id", "file_no", "record").collect()]
    want = {(x[2], x[4]) for x in changes_by_hand(rows) if x[3] == "renamed"}
    alike = {p for p in want if drift.name_similarity(*p) > 0}
    assert alike < want
    every = {}
    for s, f, record in rows:
        for name, value in (drift.fields_of(record) or {}).items():
            every.setdefault((s, f), set()).add((name, "", drift._json_type(value)))
    proposals = {p[:2] for (s, f), after in every.items() if (s, f - 1) in every for p in drift.proposed(drift.flood(sorted(every[s, f - 1], key=str), sorted(after, key=str)))}
    assert want <= proposals


def test_the_name_filter_holds_nothing_back(spark):
    steps = spark.createDataFrame([(s, f, [(f"o{s}", f"n{f}")]) for s in range(200) for f in (2, 3)], "series_id bigint, file_no int, proposals array<struct<old:string,new:string>>")
    held = drift._name_filter(steps)
    h = drift.text_hash
    assert all(h(drift._name_key(s, f - 1, False, f"o{s}")) in held and h(drift._name_key(s, f, True, f"n{f}")) in held and h(drift._file_key(s, f)) in held for s in range(200) for f in (2, 3))
    assert sum(h(drift._name_key(s, 9, True, "other")) in held for s in range(2000)) < 100
    assert h("x") not in drift._name_filter(steps.limit(0))
    # Spark and Python hash alike, and many hashes are looked up as one is.
    texts = ["", "a", "ä/1", "x" * 1000, "\U0001f600"]
    assert [r[0] & (2**64 - 1) for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("xxhash64(t)").collect()] == list(map(h, texts))
    hashes = [h(str(i)) for i in range(5000)] + [h(drift._file_key(3, 2))]
    assert held.holds(np.array(hashes, dtype=np.uint64)).tolist() == [x in held for x in hashes]


def test_wide_and_clashing_fields(spark, monkeypatch):
    monkeypatch.setattr(drift, "MOST_COLUMNS", 3)
    rows = [(1, "r", 1, i, json.dumps({"paper_id": f"p{i}", "a": i, "A": [i, "x"], **{f"rare{i}_{k}": k for k in range(3)}, "series_id": "clash", "n": f"{i}"}), None, None) for i in range(4)]
    rows += [(None, "r", None, None, '{"paper_id": "q", "n": 2, "unseen": {"k": true}}', None, None), (2**60 + 1, "r", 1, 7, '{"n": "x"}', None, None)]
    table = drift.unified_table(spark.createDataFrame(rows, LINES), {"n": "integer"})
    got = [r.asDict() for r in table.collect()]
    assert len(got) == 6 and len({c.lower() for c in table.columns}) == len(table.columns)
    lone = next(r for r in got if r["series_id"] is None)
    assert lone["n"] == 2 and lone["other_fields"]["unseen"] == "true"
    assert next(r for r in got if r["series_id"] == 2**60 + 1)["line_no"] == 7
    # Nothing is lost: each field is in a column or in the map.
    zero = next(r for r in got if r["line_no"] == 0)
    values = [v for c, v in zero.items() if v is not None and c not in ("series_id", "file_no", "line_no", "other_fields")] + list(zero["other_fields"].values())
    assert sorted(map(str, values)) == sorted(["p0", "0", "0 x", "0", "1", "2", "clash", "0"])


def test_spelling():
    assert {drift.spelling_free(v) for v in (137, 137.0, "137", "N = 137", [137], {"value": 137, "note": None})} == {"137"}
    assert drift.spelling_free("10,962") == "10962" and drift.spelling_free(None) is None and drift.spelling_free("  ") is None
    assert drift.spelling_free(["kernel", "smoothing"]) == drift.spelling_free("Kernel  smoothing")


def links_by_hand(record):
    """Straight from the statement, without intervals."""

    def opened(v):
        if isinstance(v, str) and v.strip()[:1] in ("[", "{"):
            return json.loads(v)
        return v

    def items(v):
        v = opened(v)
        if isinstance(v, dict) and "items" in v:
            v = v["items"]
        if isinstance(v, dict):
            return [(int(k), v[k]) for k in sorted(v, key=int)]
        return [(None, x) for x in v or [] if x is not None]

    def terms(v):
        v = opened(v)
        if isinstance(v, str):
            return [t for t in v.split(";") if t.strip()]
        return [t for x in v or [] for t in ([x.get("term")] if isinstance(x, dict) else [x]) if t and t.strip()]

    try:
        top = json.loads(record)
    except (ValueError, TypeError):
        return []
    out, numbers, held = [], [], []
    for i, (key, chapter) in enumerate(items(top.get("chapters")), 1):
        chapter = opened(chapter)
        out.append(("chapter", 0, i))
        numbers.append(nested.whole_number(chapter.get("number")) if chapter.get("number") is not None else key)
        if chapter.get("summary") is not None:
            held.append((i, opened(chapter["summary"])))
    for key, s in items(top.get("summaries")):
        s = opened(s)
        n = nested.whole_number(s.get("chapter_num")) if s.get("chapter_num") is not None else key
        held.append((numbers.index(n) + 1 if n is not None and n in numbers else 0, s))
    for j, (parent, s) in enumerate(held, 1):
        out.append(("summary", parent, j))
        out += [("key_term", j, k) for k in range(1, len(terms(s.get("key_terms"))) + 1)]
    synthesis = opened(top.get("synthesis"))
    entries = synthesis if isinstance(synthesis, list) else [synthesis] if synthesis else []
    out += [("key_theme", 0, k) for k in range(1, sum(len(terms(e.get("key_themes"))) for e in entries) + 1)]
    return out


def test_links_on_the_tables(spark, folder):
    records = spark.read.parquet(f"{folder}/book_inventory.parquet")
    want = sorted((r["record_id"], *x) for r in records.collect() for x in links_by_hand(r["record"]))
    assert want and sorted(tuple(r) for r in nested.links(records).collect()) == want


def test_awkward_records(spark):
    rows = [
        (1, json.dumps({"chapters": {"10": {"title": "b"}, "2": {"title": "a", "summary": {"main_thesis": "t", "key_terms": " a ; ;b;"}}}, "summaries": [{"chapter_num": " Ch 10 ", "key_terms": [None, " ", {"term": "x"}, "y;z"]}, None], "synthesis": [{"key_themes": "m"}]})),
        (2, None), (3, "{"), (4, "[]"), (5, '{"chapters": null, "summaries": "", "synthesis": 3}'), (6, "1"),
    ]
    df = spark.createDataFrame([(*r, "k", 0) for r in rows], "record_id bigint, record string, kind string, pre int")
    assert sorted(tuple(r) for r in nested.links(df).collect()) == [
        (1, "chapter", 0, 1), (1, "chapter", 0, 2), (1, "key_term", 1, 1), (1, "key_term", 1, 2), (1, "key_term", 2, 1), (1, "key_term", 2, 2), (1, "key_term", 2, 3),
        (1, "key_theme", 0, 1), (1, "summary", 1, 1), (1, "summary", 2, 2),
    ]
    nodes = nested.label_nodes(df).where("record_id = 1").collect()
    for a in nodes:
        for b in nodes:
            inside = a["pre"] < b["pre"] <= a["post"]
            assert not inside or b["post"] <= a["post"]
    assert nested.links(df.limit(0)).count() == 0


def test_every_node_is_labelled(spark):
    """Objects and elements under fields that no kind reads are nodes too, within the node that holds them."""
    record = {"title": "t", "chapters": [{"title": "a", "evidence": [{"kind": "survey", "rows": [1, [2, None, 3]]}, "text"], "summary": {"main_thesis": "m", "sources": {"a": {"b": 1}}}}], "extra": {"deep": {"er": []}}, "synthesis": {"notes": ["n"]}}
    df = spark.createDataFrame([(1, json.dumps(record)), (2, "[" * 50_000)], "record_id bigint, record string")
    nodes = sorted(nested.label_nodes(df).collect(), key=lambda n: n["pre"])
    assert [(n["kind"], n["depth"], n["item_no"]) for n in nodes] == [
        ("record", 0, 0), ("chapter", 1, 1), ("summary", 2, 1), ("sources", 3, 1), ("a", 4, 1), ("evidence", 2, 1), ("rows", 3, 1), ("rows", 3, 2), ("rows", 4, 1), ("rows", 4, 3), ("evidence", 2, 2), ("extra", 1, 1), ("deep", 2, 1),
        ("synthesis", 1, 1), ("notes", 2, 1),
    ]
    assert [n["pre"] for n in nodes] == list(range(1, len(nodes) + 1))
    holder = {n["pre"]: max((m["pre"] for m in nodes if m["pre"] < n["pre"] and n["post"] <= m["post"]), default=0) for n in nodes}
    depth = {0: -1} | {n["pre"]: n["depth"] for n in nodes}
    assert all(depth[holder[n["pre"]]] == n["depth"] - 1 for n in nodes)
    assert nodes[5]["attributes"] == {"kind": "survey", "rows": "[1, [2, null, 3]]"} and nodes[10]["attributes"] == {"text": "text"}
    held = nested.within(nested.label_nodes(df), in_chapter="chapter", in_summary="summary").where("kind = 'sources'").first()
    assert (held["in_chapter"], held["in_summary"]) == (1, 1)


def test_conversions_compose_and_agree():
    composed = units.conversions()
    assert composed["week", "minute"] == (Fraction(7 * 24 * 60), 0) and composed["fraction", "hundredth"] == (10000, 0)
    assert all(composed[b, a] == (1 / f, -o / f) for (a, b), (f, o) in composed.items())
    assert units.conversions([("c", "f", Fraction(9, 5), Fraction(32)), ("k", "c", Fraction(1), Fraction(-27315, 100))])["k", "f"] == (Fraction(9, 5), Fraction(32) - Fraction(27315, 100) * Fraction(9, 5))
    with pytest.raises(ValueError):
        units.conversions([*units.EDGES, ("week", "hour", Fraction(100), Fraction(0))])


CELLS = [
    ("effect_size", "0.8786", None, 8786, False), ("effect_size", "84,36 %", None, 8436, True), ("effect_size", "764.3 per thousand", None, 7643, False), ("effect_size", "F1 = 8,288 bp", None, 8288, False),
    ("effect_size", "64.55", "effect size given in percent", 6455, True), ("effect_size", "713.4", "see table; effect size quoted per thousand", 7134, False), ("effect_size", "0,9604 ± 0.003", None, 9604, False),
    ("effect_size", "29.7 BLEU", None, None, None), ("effect_size", "d = 0.56", None, None, None), ("effect_size", "n/a", None, None, None), ("effect_size", "–", None, None, None),
    ("performance_improvement", "−1,36 per cent", None, -136, True), ("performance_improvement", "gain of 33.4‰", None, 334, False), ("performance_improvement", "-0.0134 (0-1)", None, -134, False),
    ("performance_improvement", "+3.1 points", None, 310, True), ("performance_improvement", "130", "improvement in basis points", 130, False), ("performance_improvement", "7 ppl lower", None, None, None),
    ("training_compute", "188 GPU hours", None, 11280, True), ("training_compute", "approx. 1,635 accelerator-hours", None, 98100, True), ("training_compute", "10 h", None, 600, False),
    ("training_compute", "2 GPUs, 10 hours plus 2 TPU cores for 0.1 wk", None, 3216, False), ("training_compute", "sixteen GPUs for 4 d", None, 92160, False), ("training_compute", "single NPU, 9,720 sec", None, 162, False),
    ("training_compute", "4 Kestrel A4 GPUs, 18 days", None, 103680, False), ("training_compute", "19,5 GPU-days", None, 28080, False), ("training_compute", "22 petaflop/s-days", None, None, None),
    ("training_compute", "5.8e17 FLOP", None, None, None), ("training_compute", "549 k steps", None, None, None), ("training_compute", "a small cluster", None, None, None), ("training_compute", "", None, None, None),
    ("effect_size", "x" * 5000 + " 12.5%", None, 1250, True),
]


def test_cells(spark):
    rows = []
    for i, (field, cell, notes, _, _) in enumerate(CELLS):
        rows.append((i, "rv", notes, *(cell if f == field else None for f in units.TARGETS), "clash", "clash"))
    rows.append((None, None, None, None, None, None, None, None))
    matrix = spark.createDataFrame(rows, "row_id bigint, review string, notes string, effect_size string, performance_improvement string, training_compute string, key string, unit string")
    schema = spark.createDataFrame([("rv", "effect_size", "Primary score between 0 and 1", "float", 1), ("rv", "performance_improvement", None, "float", 1)], "review string, key string, description string, type string, row_id int")
    got = {(r["row_id"], r["field"]): (r["amount"], r["common"]) for r in units.amounts(matrix, schema).collect()}
    for i, (field, cell, _, amount, common) in enumerate(CELLS):
        assert got.get((i, field), (None, None)) == (amount, common), cell
    assert units.restated(matrix.limit(0), schema).count() == 0
    assert units.restated(matrix, schema.limit(0)).count() > 0


def test_rows_given_twice_and_without_id(spark):
    rows = [(1, "2 GPUs, 3 hours"), (1, "2 GPUs, 3 hours"), (None, "1 h"), (None, "2 h plus 1 day"), (2, "99999999999999 GPUs for 9999999 weeks")]
    matrix = spark.createDataFrame([(i, "rv", None, None, None, t) for i, t in rows], "row_id bigint, review string, notes string, effect_size string, performance_improvement string, training_compute string")
    schema = spark.createDataFrame([], "review string, key string, description string")
    got = sorted(((r["row_id"], r["amount"]) for r in units.amounts(matrix, schema).collect()), key=str)
    assert got == [(1, 360), (1, 360), (None, 1560), (None, 60)]


def test_offsets_are_applied(spark):
    """Temperatures: an affine conversion with an offset, before the multiplication by a count."""
    edges = [("celsius", "fahrenheit", Fraction(9, 5), Fraction(32)), ("kelvin", "celsius", Fraction(1), Fraction(-27315, 100))]
    terms = spark.createDataFrame([(1, 7, "t", "20", 1, "celsius", True), (2, 7, "t", "300.15", 1, "kelvin", True), (3, None, "t", "10", 2, "celsius", True)], "_cell bigint, row_id bigint, field string, number string, times int, unit string, single boolean")
    terms = terms.withColumns({"number": terms["number"].cast("decimal(24,8)"), "times": terms["times"].cast("decimal(10,0)")})
    got = sorted(((r["row_id"], r["amount"]) for r in units._converted(terms, units.conversion_table(spark, edges), {"t": "fahrenheit"}).collect()), key=str)
    assert got == [(7, 68), (7, 81), (None, 100)]
    # Factors of a million and more.
    big = units._converted(terms.where("_cell = 1"), units.conversion_table(spark, [("celsius", "fahrenheit", Fraction(3_000_000), Fraction(0))]), {"t": "fahrenheit"})
    assert [r["amount"] for r in big.collect()] == [60_000_000]
    with pytest.raises(ValueError):
        units.conversions([("a", "b", Fraction(10**13), Fraction(0))])


def test_spellings_of_numbers(spark):
    cases = {"1,234": 1234, "0,123": 0.123, "12,5": 12.5, "1.234.567": 1234567, "1,234.5": 1234.5, "1.234,5": 1234.5, "1 340": 1340, "7": 7, "x": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r[0]: None if r[1] is None else float(r[1]) for r in df.select("t", units.plain_number(df["t"])).collect()}
    assert got == cases


def test_hot_series_gives_the_same(spark):
    random.seed(1)
    rows = [(7, "r", f, i, json.dumps({"paper_id": f"p{i}", ("size" if f < 2 else "n"): i}), None, None) for f in (1, 2) for i in range(3000)]
    assert {tuple(r) for r in drift.field_changes(spark.createDataFrame(rows, LINES)).collect()} == {(7, 2, "size", "renamed", "n")}
