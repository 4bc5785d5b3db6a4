import random

import pytest

from sheaf.llm import encodings

SENTENCES = [
    "La razón está en la información disponible y los niños de la región.", "Après 4 mois, l’écart entre les deux groupes disparaît complètement à Paris.",
    "Außerdem prüfen wir, ob die Wirkung über die Jahre hinweg beständig bleibt.", "A avaliação não mostra diferenças após a correção das observações em falta.",
    "В этой главе объясняется, почему случайное назначение повышает доверие к выводам.", "Мы изучаем влияние обучения на занятость в хозяйствах и почему ошибка остаётся.",
    "As one put it, “the effect isn’t small” – about €5 per head — and 22 °C, 7 µg, α = 0.05 and β₁.", "Выборка охватывает три региона и период до конца года.",
]
CODECS = ["cp1252", "cp1250", "cp1251", "mac_roman", "cp437"]


def misread(text, codec):
    table = encodings._decoded(codec)
    return "".join(table[b] for b in text.encode("utf-8"))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    rows, truth = [], {}
    for i in range(400):
        lines = []
        for n in range(1, 9):
            line = " ".join(rng.sample(SENTENCES, 2))
            if rng.random() < 0.08:
                way = rng.choice([*CODECS, "twice", "single", "lost"])
                if way == "twice":
                    bad = misread(misread(line, "cp1252"), "cp1252")
                elif way == "single":
                    line = rng.choice([s for s in SENTENCES if s[0] in "ВМ"])
                    bad = line.encode("cp1251").decode("latin-1")
                elif way == "lost":
                    bad = line.encode("latin-1", "replace").decode("latin-1").replace("?", "�")
                    bad = bad if "�" in bad else bad + " �"
                else:
                    bad = misread(line, way)
                truth[i, n] = ("lost" if way == "lost" else "restored", line)
                line = bad
            lines.append(line)
        rows.append((i, "\n".join(lines), rng.choice(["a", "b"]), "clash", "clash"))
    return rows, truth


def test_found_and_restored(spark, texts):
    rows, truth = texts
    df = spark.createDataFrame(rows, "result_id bigint, markdown string, engine string, content string, source string")
    got = {(r["result_id"], r["line_no"]): (r["outcome"], r["repaired"]) for r in encodings.repairs(df).collect()}
    assert set(got) == set(truth)
    assert all(got[k][0] == truth[k][0] for k in truth)
    restored = [k for k in truth if truth[k][0] == "restored"]
    assert sum(got[k][1] == truth[k][1] for k in restored) >= 0.99 * len(restored)
    whole = {r[0]: r[1] for r in encodings.restored(df).collect()}
    assert len(whole) == len(rows)
    for i, text, *_ in rows:
        lines = text.split("\n")
        for n, line in enumerate(whole[i].split("\n"), 1):
            assert line == (got[i, n][1] if (i, n) in got else lines[n - 1])


def test_nothing_to_find(spark):
    kinds = "result_id bigint, markdown string, engine string"
    assert encodings.repairs(spark.createDataFrame([], kinds)).count() == 0
    plain = [(1, None, None), (2, "", "a"), (3, "plain ascii\n/G31/G25", "a"), (4, "POPULAÇÃO E AÇÃO é à ñ", None), (4, "POPULAÇÃO E AÇÃO é à ñ", None), (None, "x", "a"), (5, "ПРОПИСНЫЕ БУКВЫ. Рёбра и счёт.", "a")]
    df = spark.createDataFrame(plain * 3, kinds)
    assert encodings.repairs(df).count() == 0
    assert encodings.restored(df).where("result_id = 4").select("markdown").distinct().first()[0] == "POPULAÇÃO E AÇÃO é à ñ"


def test_steps():
    for codec in CODECS:
        for line in SENTENCES:
            assert encodings.undo_utf8(misread(line, codec), codec)[0] == line
    assert encodings.undo_single("Ìû èçó÷àåì âëèÿíèå", "cp1251", "cp1252")[0] == "Мы изучаем влияние"
    assert encodings.undo_single("нЩ ЙЪХЮБЕН", "koi8_r", "cp1251")[0] == "Мы изучаем"


RUSSIAN = [s for s in SENTENCES if s[0] in "ВМ"] + ["Но и не он один: у них была своя цена, а она росла.", "Ёлка и объём: подъезд, шум, цех."]


def chains():
    """(chain, line, what wrong decoding makes of it) for each chain that the module lists."""
    for codec in encodings.UTF8_READ_AS:
        yield from ((codec, line, misread(line, codec)) for line in SENTENCES)
    for written, read in encodings.SINGLE_BYTE:
        yield from ((f"{written}>{read}", line, "".join(encodings._decoded(read)[b] for b in line.encode(written))) for line in RUSSIAN)
    quoted = "As one put it, “the effect isn’t small”."
    yield "cp1252>latin_1", quoted, quoted.encode("cp1252").decode("latin-1")


def test_every_chain_from_garbling_to_outcome(spark):
    cases = list(chains())
    assert all(encodings.is_suspect(bad) and encodings.is_garbled(bad) for _, _, bad in cases)
    rng = random.Random(3)
    clean = [" ".join(rng.sample([*SENTENCES, *RUSSIAN], 3)) for _ in range(300)]
    df = spark.createDataFrame([(1, "\n".join([*clean, *(bad for _, _, bad in cases)]), "a")], "result_id bigint, markdown string, engine string")
    got = {r["line_no"]: (r["outcome"], r["repaired"]) for r in encodings.repairs(df).collect()}
    assert got == {n: ("restored", line) for n, (_, line, _) in enumerate(cases, len(clean) + 1)}


def test_a_doubtful_line_is_decided_by_its_pool(spark, monkeypatch):
    """A line that several chains undo equally well: the one that the sure lines of its source show wins, none without EM."""
    rng = random.Random(9)
    clean = [" ".join(rng.sample([*SENTENCES, *RUSSIAN], 2)) for _ in range(200)]
    sure = [misread(rng.choice(SENTENCES[:4]), "cp1252") for _ in range(40)]
    doubtful = misread("a ê b", "cp1252")
    df = spark.createDataFrame([(1, "\n".join([*clean, *sure, doubtful]), "a"), (2, "\n".join([*clean, "x"]), "b")], "result_id bigint, markdown string, engine string")
    at = len(clean) + len(sure) + 1
    of = lambda: {(r["result_id"], r["line_no"]): r["repaired"] for r in encodings.repairs(df).collect()}
    found = of()
    assert found[1, at] == "a ê b" and len(found) == len(sure) + 1
    estimated = encodings.estimated
    monkeypatch.setattr(encodings, "estimated", lambda weighed: estimated(weighed, rounds=0))
    assert of()[1, at] != "a ê b"


def test_many_pools(spark, monkeypatch):
    """Pools beyond the bound share their lines' weights; nothing is left out."""
    monkeypatch.setattr(encodings, "POOLS", 3)
    rows = [(i, "\n".join([*SENTENCES, misread(SENTENCES[i % 4], "cp1252")]), f"engine {i}") for i in range(12)]
    df = spark.createDataFrame(rows, "result_id bigint, markdown string, engine string")
    got = {r["result_id"]: r["repaired"] for r in encodings.repairs(df).collect()}
    assert got == {i: SENTENCES[i % 4] for i in range(12)}
    shares = encodings.Shares(["x", "y"], ["p"], {("p", "x"): 30.0, ("p", ""): 10.0, (None, "y"): 5.0})
    assert shares.log("p", "x") > shares.log("p", "") > shares.log("p", "y") and shares.log("other", "y") > shares.log("other", "x")
    assert abs(sum(p for _, p in shares.posterior("p", [("x", 1.0), ("y", -1.0)])) - 1) < 1e-9
