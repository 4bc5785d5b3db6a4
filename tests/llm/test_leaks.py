import random

import pytest

from sheaf.llm import leaks

ITEMS = "item_id bigint, text string, suite string"
DOCS = "doc_id bigint, text string, item_id bigint"


def by_hand(documents, items):
    out = set()
    for i, item in items:
        w = leaks.words(item)
        n = min(10, len(w))
        if not n:
            continue
        wanted = [" " + " ".join(w[k : k + n]) + " " for k in range(len(w) - n + 1)]
        out |= {(d, i) for d, t in documents if t and any(g in " " + " ".join(leaks.words(t)) + " " for g in wanted)}
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 9, 10, 11, 25])))) for i in range(40)] + [(90, None), (91, ""), (92, "…!"), (93, "Ｆｕｌｌ—Width ﬁne"), (94, "w1 w2 w3")]
    documents = []
    for d in range(300):
        text = rng.choices(vocabulary, k=rng.randint(0, 60))
        if d % 3 == 0:
            part = leaks.words(rng.choice(items)[1])
            cut = rng.randint(0, max(0, len(part) - 8))
            text[len(text) // 2 : 0] = [w.upper() + rng.choice([",", "\n", "_", ""]) for w in part[cut : cut + rng.randint(5, 20)]]
        documents.append((d, " ".join(text)))
    return documents + [(900, None), (901, ""), (902, "FULL width fine"), (902, "FULL width fine"), (903, "w1 w2́ w3")], items


def test_leaks_by_hand(spark, case):
    documents, items = case
    d = spark.createDataFrame([(*x, 1) for x in documents], DOCS)
    i = spark.createDataFrame([(*x, "s") for x in items], ITEMS)
    want = by_hand(documents, items)
    assert len(want) > 50 and (902, 93) in want
    assert sorted(map(tuple, leaks.leaks(d, i).collect())) == sorted(want)
    # However full the filter is, the join gives the same result.
    assert sorted(map(tuple, leaks.leaks(d, i, most_bits=6).collect())) == sorted(want)


def test_leaks_on_the_tables(spark, folder):
    d, i = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "test_items"))
    want = by_hand([tuple(r) for r in d.select("doc_id", "text").collect()], [tuple(r) for r in i.select("item_id", "text").collect()])
    assert want and set(map(tuple, leaks.leaks(d, i).collect())) == want


def test_clean_texts_leak_nothing(spark, case):
    documents, items = case
    d, i = spark.createDataFrame([(*x, 1) for x in documents], DOCS), spark.createDataFrame([(*x, "s") for x in items if x[0] < 40 and len(leaks.words(x[1])) >= 10], ITEMS)
    clean = leaks.without_passages(d, i)
    assert leaks.leaks(clean, i).count() == 0 and clean.count() == len(documents)
    key = lambda df: sorted((r["doc_id"], r["text"] or "", r["removed"]) for r in df.collect())
    assert key(leaks.without_passages(d, i, most_bits=6)) == key(clean)
    assert sum(r["removed"] for r in clean.collect()) == sum(len(t or "") for _, t in documents) - sum(len(r["text"] or "") for r in clean.collect()) > 0


def test_many_items(spark, case):
    """More items than any worker is given: the same rows as by hand."""
    documents, items = case
    rng = random.Random(4)
    many = items + [(1000 + k, " ".join(f"z{rng.randint(0, 5000)}" for _ in range(12))) for k in range(25_000)]
    d, i = spark.createDataFrame([(*x, 1) for x in documents], DOCS), spark.createDataFrame([(*x, "s") for x in many], ITEMS)
    assert sorted(map(tuple, leaks.leaks(d, i).collect())) == sorted(by_hand(documents, items))
    assert leaks.without_passages(d, i).count() == len(documents)


def test_texts_of_one_id_are_told_apart(spark):
    passage = " ".join(f"p{k}" for k in range(12))
    d = spark.createDataFrame([(1, f"before {passage} after", 0), (1, f"{passage}, then more", 0), (1, f"before {passage} after", 0), (None, f"x {passage}", 0), (2, None, 0)], DOCS)
    i = spark.createDataFrame([(5, passage, "s")], ITEMS)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in leaks.without_passages(d, i).collect()) == [(0, "x "), (1, " then more"), (1, "before  after"), (1, "before  after"), (2, "")]


def test_empty_tables(spark):
    d, i = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", "s")], ITEMS)
    assert leaks.leaks(d, i).count() == 0 and leaks.leaks(spark.createDataFrame([(1, "a b", 1)], DOCS), i.limit(0)).count() == 0
