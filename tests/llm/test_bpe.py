import random

import public_tokenizers
import pytest
import sentencepiece

from corvane.llm.bpe import Encoder, PieceModel, encode_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return PieceModel(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rnd = random.Random(3)
    parts = [*"aaabetthinog   \n\t.,▁éß中文😀\x00<>0x", "  ", "the", "ing", " " * 20, "\r\n"]
    made = ["".join(rnd.choices(parts, k=rnd.randint(0, 50))) for _ in range(400)]
    return ["", " ", "a", *made, "a" * 333, " " * 777, "th" * 2000, "日本語" * 300, "<s></s><0x41><unk>"]


def test_same_ids_and_text_as_the_library(model, library):
    given = texts()
    flat, sizes = Encoder(model).encode(given)
    at = 0
    for text, n in zip(given, sizes.tolist(), strict=True):
        ids = flat[at : at + n].tolist()
        at += n
        assert ids == library.encode(text)
        assert model.decode(ids) == library.decode(ids)


def test_long_words_have_the_same_ids_in_few_rounds(model, library, monkeypatch):
    rnd = random.Random(9)
    vocabulary = [p.lstrip("▁") for p in model.pieces[300:20_000:7]]
    given = ["".join(rnd.choices(letters, k=n)) for letters in ("ab", "then", "abcdefghijklmnopqrstuvwxyz", "=-_", "0123456789+/AbZ", "日本語中文") for n in (40, 300, 5_000)]
    given += ["".join(rnd.choices(vocabulary, k=n)) for n in (5, 50, 500) for _ in range(12)]
    given += [c * n + d * n for c, d in ("ab", "-=", "ww", "  ", "ta") for n in (19, 64, 1001)] + ["x" * 100_000, "".join(rnd.choices("etaoin", k=100_000)), "".join(rnd.choices(vocabulary, k=20_000))]
    for c in "#▁ -*":
        given += ["ab" + c * n + "cd the" + c * (n // 2) + "x" for n in (109, 300, 1000, 5003, 100_001)]
        given.append("".join(rnd.choice([c * rnd.randint(1, 900), "the", "x", " ", c, "//"]) for _ in range(200)))
    rounds, real = [], PieceModel.merges
    monkeypatch.setattr(PieceModel, "merges", lambda *a: rounds.append(1) or real(*a))
    for text in given:
        rounds.clear()
        assert Encoder(model).encode([text])[0].tolist() == library.encode(text), text[:100]
        assert len(rounds) < 400


def test_decoding_any_ids(model, library):
    rnd = random.Random(5)
    for _ in range(500):
        ids = [rnd.choice([0, 1, 2, rnd.randint(3, 258), rnd.randint(3, 258), rnd.randint(259, 31999), 259]) for _ in range(rnd.randint(0, 9))]
        assert model.decode(ids) == library.decode(ids)


def test_remembered_words_are_forgotten(model, library, monkeypatch):
    monkeypatch.setattr("corvane.llm.bpe.CACHE_CHARS", 10)
    encoder = Encoder(model)
    for text in ("one two three four", "two three", "four five"):
        assert encoder.encode([text])[0].tolist() == library.encode(text)


def test_table(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (None, "Hello  world\n", None), (2, "again", "z"), (2, "again", "z"), (3, "w" * 100_000, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode_documents(df, PATH).collect()
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in got) == sorted((str(i), library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, _ in rows)
    assert encode_documents(df.where("false"), PATH).collect() == []
