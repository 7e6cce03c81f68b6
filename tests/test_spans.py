import random

from pyspark.sql import functions as F

from corvane.functions import exprs as X
from corvane.operators import spans
from corvane.queries import QUERIES


def plain(texts, values):
    return sorted((i, t, j, v, t.index(v), len(v)) for i, t in texts if t for j, v in values if v and v in t)


def found(spark, texts, values, ids="long", value_ids="long"):
    got = spans.first_spans(spark.createDataFrame(texts, f"id {ids}, text string"), spark.createDataFrame(values, f"value_id {value_ids}, value string"))
    return sorted(map(tuple, got.collect()))


def made(seed, n):
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choices("ab 😀é\n", [5, 5, 2, 1, 1, 1], k=k))
    texts = [(i, word(rnd.randint(0, 400))) for i in range(n)]
    values = [(i, word(rnd.randint(0, 7))) for i in range(40)]
    values += [(100 + i, t[10 : 10 + 30 * (i % 9)]) for i, t in texts[:30]] + [(200, "a" * 90), (201, "a" * 64 + "b"), (202, "a"), (203, "a"), (204, None)]
    return [*texts, (900, None), (901, ""), (902, "b" + "a" * 200 + "b"), texts[0]], values


def test_like_index(spark):
    texts, values = made(3, 60)
    assert found(spark, texts, values) == plain(texts, values)


def test_many_batches(spark, monkeypatch):
    texts, values = made(4, 20)
    monkeypatch.setattr(spans, "BATCH_BYTES", 300)
    assert found(spark, texts, values) == plain(texts, values)


def test_other_kinds_of_ids_long_texts_and_nothing(spark):
    text = "x" * 300_000 + "needle in it" + "y" * 300_000
    assert found(spark, [("t", text)], [("v", "needle in")], "string", "string") == [("t", text, "v", "needle in", 300_000, 9)]
    assert found(spark, [], [(1, "x")]) == found(spark, [(1, "x")], []) == found(spark, [(1, "x")], [(1, None)]) == []


def test_a_search_without_separators_finds_what_the_pattern_finds(spark):
    rnd = random.Random(6)
    chars = lambda k: "".join(rnd.choices("12-. \nA\\$E", k=k))
    rows = [(chars(rnd.randint(0, 25)), chars(rnd.randint(1, 4))) for _ in range(2000)] + [("".join(rnd.choices("123-.", k=12)), "".join(rnd.choices("123", k=4))) for _ in range(3000)] + [("x - . 1", "-."), ("1--2 1-2", "12"), ("", "1"), ("1", "")]
    df = spark.createDataFrame(rows, "text string, value string")
    exact = F.instr("text", F.col("value"))
    hit = F.when(exact > 0, F.col("value")).otherwise(F.regexp_substr(F.col("text"), X.tolerant_pattern(F.col("value"))))
    wanted = F.when((F.length("value") > 0) & hit.isNotNull(), F.struct((F.instr("text", hit) - 1).alias("start"), F.length(hit).alias("length")))
    assert df.where(~X.find_span(F.col("text"), F.col("value")).eqNullSafe(wanted)).count() == 0
    assert df.where(wanted.isNotNull() & (exact == 0)).count() > 50


def test_sentences_of_an_item_are_found_alone(spark, tmp_path):
    docs = [(1, "Before it. The second one is here! After it."), (2, "The first one. The second one is here! A third"), (3, "Nothing."), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "The first one. The second one is here!"), (8, "Not there."), (9, ""), (10, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r.doc_id, r.item_id, r.part): (r.before, r.current, r.after) for r in QUERIES["sentence_context"](spark, str(tmp_path)).collect()}
    second = "The second one is here!"
    assert got == {
        (1, 7, 2): ("Before it.", second, "After it."), (2, 7, 0): ("", "The first one.", second),
        (2, 7, 1): ("", "The first one.", second), (2, 7, 2): ("The first one.", second, "A third"),
    }
