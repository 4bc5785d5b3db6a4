import pytest

from sheaf.llm import quality

PROSE = "The policy was announced in 1997 and reached most tenants two years later, although the effect on savings is small. "
CASES = {
    "prose": [
        PROSE, "\n".join((PROSE * 4)[i : i + 40] for i in range(0, 400, 40)), "Результаты показывают, что средний прирост составил 3 процента и ошибка остаётся главным ограничением. " * 2,
        "POPULAÇÃO E AÇÃO: O CAPÍTULO ENSINA ÀS EQUIPES COMO EVITAR CONCLUSÕES.", "Short.", PROSE * 400, PROSE * 8 + "\n\n- a\n- b\n- c", "Under \tthe  new \trule,  sites\nwith \tfewer  than\n892 \tretailers\nreport  to \tthe office each July.",
        "今天天气很好，我们去公园散步。", '"It isn’t so," she said.\n"It is," he said.\n"Then we will see what they do with it."',
    ],
    "list": [
        "- one thing\n- another thing\n- a third", "\n".join(f"{i}. Quantile forecasting" for i in range(1, 9)), "yield, 12, 40\nrecall, 9\nlatency, 3, 77, 120\nmarket share, 1", "panel regression\nretention\nmarket share\nyield\nrecall",
        "Results on Yield ........ 3\nRevisiting Recall ....... 17\nDropout ................. 40", "## References\n\n" + "\n".join("Smith, J., Doe, A. (1999). Yield among Tenants. Annals of Evaluation, 5, 10-20." for _ in range(5)),
        "\n".join(f"- {PROSE.strip()}" for _ in range(5)), "We list the following:\n(a) yield: recall\n(b) savings: latency\n(c) market share: turnover",
    ],
    "table": [
        "| a | b |\n|---|---|\n| 0.1 | 22.0% |\n| 0.4 | (0.3) |", "yield\t0.1\t3\nrecall\t0.2\t4\nsavings\t\t5", "x,c0,c1\nyield,0.1,4097\nrecall,,0.3\nturnover,0.7,1", "yield & 0.1 & 22 \\\\\nrecall & 0.2 &  \\\\\nturnover & & 7 \\\\",
        "market share              0.020         12.1%\nyield                     0.113         (0.6)\nrecall                                  0.410", f"| yield | {PROSE} | 0.5 |\n| recall | {PROSE} | 0.1 |\n| turnover | {PROSE} | 7 |", '"yield";"0.1";""\n"recall";"";"5"\n"x";"7";"8"',
    ],
    "junk": [
        "/G31/G25/G28" * 20, "-" * 400, ". " * 200, "$+_]~!\\<%*&_;!::<[~#$|&$%&^%" * 8, "\\xc4 6c78 be \\x6a0720d1 c650 \\x1648ed27 c7 c2 9a 20 1f" * 4, "wrdnjznx wcnkrdsqvm gqkw vbspxfj btdxd sfdgkpvjpgcw" * 3,
        "N0OrNFjFRXNAOCcxvsW5OoVcDQqVgtxbSKjQ0TlvNtDD3ullKB3FtiRFoWA", "�\x01\x0e? □\x00�" * 20, "n/a " * 50, "scan error " * 40, "0\n" * 60,
    ],
}


@pytest.mark.parametrize("kind", CASES)
def test_kinds(kind):
    assert [quality.kind(t) for t in CASES[kind]] == [kind] * len(CASES[kind])


def test_nothing(spark):
    assert [quality.kind(t) for t in (None, "", " \n\t")] == [None] * 3
    assert quality.counts(None) == (0, None, None, None, None)
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "- a\n- b\n- c", "x"), (3, "- a\n- b\n- c", "x")], "doc_id bigint, text string, kind string")
    assert sorted(map(tuple, quality.not_prose(df).collect())) == [(3, "list"), (3, "list")]
    rows = {r["doc_id"]: r for r in quality.statistics(df).collect()}
    assert (rows[1]["words"], rows[1]["mean_word_length"], rows[3]["words"], rows[3]["kind"]) == (0, None, 3, "list")
    assert quality.not_prose(df.limit(0)).count() == 0


def test_counts():
    words, mean, signs, ended, common = quality.counts("The cat sat.\nOn a mat")
    assert (words, round(mean, 3), round(signs, 3), ended, round(common, 3)) == (6, 2.5, 0.062, 0.5, 0.5)


def test_divergence():
    assert quality.divergence((0.5, 0.5), (0.5, 0.5)) == 0 and round(quality.divergence((1, 0), (0, 1)), 9) == 1
    assert quality.language("la casa de la niña que está en el campo".split())[0] == "es"
    assert quality.language("the house of the man that is in the field".split())[0] == "en"


def test_agrees_with_the_labels(spark):
    """Held-out accuracy: human labels of the largest table; a few of them are wrong."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/doc_labels.parquet").where("label is not null").select("doc_id", "label")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    pairs = [(r["label"], quality.kind(texts.get(r["doc_id"]))) for r in labels.collect()]
    pairs = [p for p in pairs if p[1] is not None]
    assert len(pairs) > 50 and sum(a == b for a, b in pairs) >= 0.95 * len(pairs)


def test_weighted_divergences_are_the_sum_of_those_of_the_groups():
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [np.concatenate([rng.dirichlet(np.ones(len(classes)) / 3) for _, classes, _ in quality.GROUPS]) for _ in range(6)]
    got = quality.divergences(np.array(rows[:3]), np.array(rows[3:]))
    for i, a in enumerate(rows[:3]):
        for j, b in enumerate(rows[3:]):
            want, at = 0.0, 0
            for _, classes, weight in quality.GROUPS:
                want += weight * quality.divergence(tuple(a[at : at + len(classes)]), tuple(b[at : at + len(classes)]))
                at += len(classes)
            assert abs(got[i, j] - want) < 1e-4


def test_the_divergence_decides(spark, folder, monkeypatch):
    """Without it every text gets the kind of the first profile, and all lists, tables and junk are lost."""
    import numpy as np

    documents = spark.read.parquet(f"{folder}/documents.parquet")
    texts = [r["text"] for r in documents.select("text").collect()]
    found = quality.fitted().kinds_of(texts)
    assert sum(k in ("list", "table", "junk") for k in found) > 20
    monkeypatch.setattr(quality, "divergences", lambda blocks, profiles: np.zeros((len(blocks), len(profiles))))
    assert set(quality.fitted().kinds_of(texts)) <= {None, "prose"}


def test_profiles_fitted_elsewhere(spark):
    """Profiles fitted on one table tell the documents of another apart, wrong labels notwithstanding."""
    from pyspark.sql import functions as F

    from sheaf.llm import quality_fit

    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    labels = read("doc_labels")
    found = quality_fit.fit(read("documents").where("doc_id % 3 != 0"), labels.withColumn("label", F.when(F.col("doc_id") % 31 == 0, F.lit("junk")).otherwise(F.col("label"))))
    assert {p["kind"] for p in found["profiles"]} == set(quality.KINDS) and "the" in found["languages"]["en"]
    profiles = quality.Profiles(found["languages"], [(p["kind"], p["shares"]) for p in found["profiles"]])
    held_out = {r["doc_id"]: r["text"] for r in read("documents").where("doc_id % 3 = 0 and doc_id % 5 = 0").collect()}
    got, want = profiles.kinds_of(list(held_out.values())), quality.fitted().kinds_of(list(held_out.values()))
    assert sum(a == b for a, b in zip(got, want)) >= 0.9 * len(want)


def test_many_blocks_and_long_texts():
    table = "a | 1 | 2\nb | 3 | 4\nc | 5 | 6"
    assert quality.blocks("x\n\ny\n\nz\n\n" + table + "\n\n \nq") == [["x", "y", "z"], table.split("\n"), ["q"]]
    assert quality.kind(PROSE * 20 + "\n\n" + table) == "prose" and quality.kind(table + "\n\n" + PROSE[:20]) == "table"
    assert quality.kind("- item of a list\n" * 50_000) == "list" and quality.kind("word " * 100_000) == "junk"
