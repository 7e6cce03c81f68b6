import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import phrases
from corvane.llm.phrases import collocations

LOW = {c: c + 32 for c in range(65, 91)}


def plain(rows, least, top, percent=80):
    """The contract, in plain loops over all n-grams."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    good = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= least}
    dropped = {(lang, w[i : i + k]) for (lang, w), c in good.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * c >= percent * good[lang, w[i : i + k]]}
    out = []
    for lang in n:
        scores = []
        for (of, w), a in good.items():
            if of == lang and (lang, w) not in dropped:
                score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
                scores.append((-score, -a, " ".join(w).encode(), left, right))
        out += [(lang, rank + 1, w.decode(), -a, left, right, n[lang], -score) for rank, (score, a, w, left, right) in enumerate(sorted(scores)[:top])]
    return sorted(out)


def found(spark, rows, schema="text string, lang string", **settings):
    made = collocations(spark.createDataFrame(rows, schema).repartition(3), **settings)
    return sorted(map(tuple, made.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def made(n, seed=3):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Ä", "état", "A", "a\xa0b", "x\u2028y", "-"]
    fixed = ["New York City hall", "of the", "In Spite of", "a a a a a"]
    ends = [" ", "  ", "\t", ". ", ", ", "\n", "!", " \x0b", "\r\n"]
    text = lambda: "".join((rnd.choice(fixed) if rnd.random() < 0.2 else rnd.choices(words, range(len(words), 0, -1))[0]) + rnd.choices(ends, [20, 2, 2, 1, 1, 1, 1, 1, 1])[0] for _ in range(rnd.randint(0, 60)))
    return [(text(), rnd.choice(["en", "en", "de", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize("cells, block", [(8, 300), (1 << 10, 64), (1 << 16, 1 << 20)])
def test_like_plain_loops_at_any_width_and_block(spark, cells, block):
    rows = [*made(150), (None, "en"), ("", None), (" .,\n\t ", "fr")]
    rows += rows[:20] * 3
    assert found(spark, rows, least=5, top=30, cells=cells, block=block) == plain(rows, 5, 30)


def test_long_texts_in_blocks_and_long_words(spark):
    rnd = random.Random(1)
    long = " ".join(rnd.choice(["one", "two", "three", "four", "five."]) for _ in range(5000))
    rows = [(long, "en"), ("x" * 5000 + " one two three" * 20, "en"), ("no end", "de")]
    assert found(spark, rows, least=10, top=50, cells=1 << 12, block=100) == plain(rows, 10, 50)


def test_empty_table_and_no_phrase(spark):
    assert found(spark, []) == []
    assert found(spark, [("one two", "en")] * 29) == []
    assert [r[2:6] for r in found(spark, [("one two", "en")] * 30, cells=64)] == [("one two", 30, 30, 30)]


def test_other_columns_and_names(spark):
    rows = [("one two", "en", 1, 2, 3)] * 40
    df = spark.createDataFrame(rows, "`the text` string, `l.g` string, n int, phrase int, `a` int")
    got = collocations(df, "the text", "l.g", cells=64).collect()
    assert [(r["phrase"], r["a"], r["score"]) for r in got] == [("one two", 40, 1_000_000)]


def test_scores_beyond_64_bits(spark):
    from corvane.llm.phrases import scored, standing

    big = 9_000_000_000_000_000_000
    counts = spark.createDataFrame([("en", 1, "x", big), ("en", 1, "y", big), ("en", 2, "x y", big - 7), ("en", 3, "x y z", big // 10 * 8), ("en", 2, "y z", big), ("en", 1, "z", big), ("en", 0, "", big)], "lang string, size int, phrase string, n long")
    got = {r["phrase"]: r["score"] for r in scored(counts).collect()}
    assert got["x y"] == 2_000_000 * (big - 7) // (2 * big)
    assert got["x y z"] == 2_000_000 * (big // 10 * 8) // (2 * big)
    assert {r["phrase"] for r in standing(scored(counts)).collect()} == {"x y z"}


def test_sketches_grow_with_the_text():
    assert phrases.cells_for(0) == phrases.CELLS
    for size in (840_000_000, 5_000_000_000):  # so many occurrences of words and pairs are in three times as many bytes
        assert size / 3 / phrases.cells_for(size) < phrases.LEAST / 2
    assert phrases.cells_for(10**12) == phrases.MOST_CELLS


def test_cells_stop_without_running_over():
    words = [b"a"] * 100_000 + [b"b"] * 29
    grams = phrases._Grams("en", words, 0)
    batch = pa.RecordBatch.from_arrays([pa.array([b" ".join(words).decode()] * 3), pa.array(["en"] * 3)], ["text", "lang"])
    filled = list(phrases._sketch(lambda g: [g.keys(g.starts(1), 1)], 30, 1 << 12, 1, 1 << 20)(iter([batch])))
    merged = next(phrases._merge(30, 1 << 12)(iter(filled * 2)))
    bits = np.zeros(1 << 9, np.uint8)
    for segment, part in zip(merged.column("segment").to_pylist(), merged.column("bits").to_pylist()):
        bits[segment * 512 : (segment + 1) * 512] = np.frombuffer(part, np.uint8)
    assert phrases._Frequent(bits, 1 << 12).holds(grams.keys(grams.starts(1), 1)).all()
