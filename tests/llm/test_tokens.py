import random

import pytest

from sheaf.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def ranks():
    return tokens.read_ranks(tokens.vocabulary_path())


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    made.encode_special_tokens = True
    return lambda texts: [e.ids for e in made.encode_batch(texts, add_special_tokens=False)]


def awkward():
    rng = random.Random(7)
    alphabet = "ab'sStTlLve \t\n\r\x0b\x1c\x85\xa0 1²½x!é中​　😀🏽ǅ֑ͅ0"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(500)]
    return [*texts, "<|endoftext|> and <|endoftext|>", "\x00\x01", "-" * 20_000, "word " * 20_000, "don't we'll THEY'D", "\n\n \n x"]


def test_same_ids_as_the_public_library(spark, ranks, reference, folder):
    texts = awkward() + [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").where("text != ''").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_texts(df).collect()}
    for i, want in enumerate(reference(texts)):
        assert got[i] == want, texts[i][:80]
        assert tokens.decode(got[i], ranks) == texts[i]


def test_every_character(ranks, reference):
    encoder = tokens.Encoder(tokens.sentencepiece_model(ranks))
    for start in range(0, 0x110000, 16):
        if not 0xD800 <= start < 0xE000 and start % 4096 < 1024:
            text = "a".join(map(chr, range(start, start + 16))) + " 1"
            import array

            got = array.array("i")
            encoder.encode(text, got)
            assert list(got) == reference([text])[0], hex(start)


def test_defined_for_nothing(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a", 0), (3, "a", 0)], "doc_id bigint, text string, ids int")
    assert sorted((r["doc_id"], r["ids"]) for r in tokens.encode_texts(df).collect()) == [(1, []), (2, []), (3, [64]), (3, [64])]
    assert tokens.encode_texts(df.limit(0)).count() == 0


def test_vocabulary_must_be_whole(ranks):
    with pytest.raises(ValueError):
        tokens.sentencepiece_model({k: v for k, v in ranks.items() if v != 7})
