import random
import textwrap

import pytest

from sheaf.llm import scans

WORDS = "the method of estimating effects under weak instruments shows that larger samples reduce variance while regional differences remain robust and further testing is required before deployment to hospitals or schools whenever baseline records are missing".split()


def prose(rng, sentences):
    return " ".join((lambda w: w[0].capitalize() + " " + " ".join(w[1:]) + ".")(rng.sample(WORDS, 12)) for _ in range(sentences))


@pytest.fixture(scope="module")
def pages():
    """Texts set in short lines with noise put in, and what was put where."""
    rng = random.Random(3)
    rows, truth = [(i, prose(rng, 30)) for i in range(1000, 1040)], set()
    for i in range(30):
        out, number = ["A Title of Some Length", ""], rng.randint(20, 90)
        for page in range(5):
            body = textwrap.wrap(prose(rng, 22), 60)
            if page < 4:
                body[-1] = body[-1].rstrip(".")
            for at, line in enumerate(body):
                if rng.random() < 0.08 and "effects" in line:
                    line = line.replace("effects", "effccts")
                    truth.add((i, len(out) + 1, "ocr"))
                elif rng.random() < 0.1 and at + 1 < len(body) and line.endswith(("variance", "samples")):
                    line, rest = line[:-4] + "-", line[-4:]
                    body[at + 1] = rest + " " + body[at + 1]
                    truth.add((i, len(out) + 1, "hyphen"))
                out.append(line)
            out.append(f"- {number + page} -")
            truth.add((i, len(out), "page_number"))
            out.append("A TITLE OF SOME LENGTH" if i % 2 else "Somebody et al.")
            truth.add((i, len(out), "header"))
        rows.append((i, "\n".join(out)))
    return rows, truth


def test_noise_found(spark, pages):
    rows, truth = pages
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "result_id bigint, markdown string, content string, n int")
    got = {tuple(r) for r in scans.noisy_lines(df).collect()}
    for kind in ("ocr", "hyphen", "page_number", "header"):
        a, b = ({x for x in s if x[2] == kind} for s in (got, truth))
        assert b and len(a & b) >= 0.95 * len(b) and len(a & b) >= 0.95 * len(a), kind
    text = " ".join(r["paragraph"] for r in scans.paragraphs(df).where("result_id = 1").orderBy("paragraph_no").collect())
    assert "effccts" not in text and "TITLE OF" not in text and "- " not in text


def test_awkward_texts(spark):
    kinds = "result_id bigint, markdown string"
    assert scans.noisy_lines(spark.createDataFrame([], kinds)).count() == 0
    rows = [(1, None), (2, ""), (3, "\n\n \n"), (4, "one long line " * 300), (4, "one long line " * 300), (None, "x"), (5, "short\nlines\nonly")]
    assert scans.noisy_lines(spark.createDataFrame(rows, kinds)).count() == 0


def test_broken_words():
    book = scans.Lexicon(frozenset("second language second-language estimation pre-registered registered pre".split()))
    broken = lambda a, b, mark="-": scans._broken(a, mark, b, book)
    assert broken("estim", "ation") and broken("estim", "ation", "¬")
    assert not broken("second", "language") and not broken("pre", "registered") and not broken("12", "15")


def test_misread_words():
    book = scans.Lexicon(frozenset("effect with most model used link in".split()))
    assert all(map(book.is_misread, ("cffect", "w!th", "rnost", "rnodel", "usecl", "hnk", "4l", "2o18", "ln", "Ostv0lin")))
    assert not any(map(book.is_misread, ("effect", "With", "2018", "Fenlin", "A4", "1st", "β")))


def test_page_values():
    assert [scans._value(t) for t in ("12", "xiv", "1O3", "lii", "abc")] == [12, 14, 103, 52, None]


RUNNING = ("full", "once", "none", "none", "far", "other", "middle")
NUMBER = ("bare", "often", "on", "cut", "near", "other", "middle")
CAPITALS = ("capitals", "once", "none", "whole", "far", "other", "middle")


def test_neighbours_decide(monkeypatch):
    """A line in capitals is a heading among text and a running header beside a page number; without transitions it's one thing."""
    labels = lambda model: [scans.STATES[model.label(x)[2]] for x in ([RUNNING, RUNNING, CAPITALS, RUNNING], [RUNNING, NUMBER, CAPITALS, RUNNING])]
    assert labels(scans.Model()) == ["standalone", "header"]
    monkeypatch.setattr(scans, "TRANSITIONS", ((0.25,) * 4,) * 4)
    assert len(set(labels(scans.Model()))) == 1


def test_the_corpus_shifts_the_tables():
    """Expected counts of many lines outweigh the beliefs: what is a header throughout the corpus is likelier one elsewhere."""
    page = [RUNNING, RUNNING, NUMBER, CAPITALS, RUNNING]
    each, moves = scans.Model().expected(page)
    assert all(abs(sum(p) - 1) < 1e-9 for p in each) and abs(sum(map(sum, moves)) - (len(page) - 1)) < 1e-9
    assert [p.index(max(p)) for p in each] == scans.Model().label(page)
    counted = {}
    for line, chances in zip(page, each):
        for s, chance in enumerate(chances):
            for name, v in zip(scans.FEATURES, line):
                counted[name, v, s] = counted.get((name, v, s), 0.0) + 100_000 * chance
    alone = [RUNNING, RUNNING, CAPITALS, RUNNING]
    believed, shifted = (m.expected(alone)[0][2][scans.STATES.index("header")] for m in (scans.Model(), scans.Model(counted)))
    assert shifted > 2 * believed > 0
    assert scans.Model().expected([]) == ([], [[0.0] * 4] * 4)


def test_expectations_by_brute_force():
    import itertools
    import math

    model = scans.Model()
    lines = [RUNNING, NUMBER, CAPITALS, RUNNING]
    paths = {}
    for path in itertools.product(range(4), repeat=4):
        log = math.log(0.25) + sum(model.emission(x)[s] for x, s in zip(lines, path)) + sum(model.follow[a][b] for a, b in zip(path, path[1:]))
        paths[path] = math.exp(log)
    total = sum(paths.values())
    each, moves = model.expected(lines)
    for i in range(4):
        for s in range(4):
            assert abs(each[i][s] - sum(p for path, p in paths.items() if path[i] == s) / total) < 1e-9
    for a in range(4):
        for b in range(4):
            assert abs(moves[a][b] - sum(p * sum((x, y) == (a, b) for x, y in zip(path, path[1:])) for path, p in paths.items()) / total) < 1e-9
