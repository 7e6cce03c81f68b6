import math
import random
import re
from collections import Counter

from corvane.operators import languages as L
from corvane.queries import QUERIES
from tests.test_queries import DATA

SYLLABLES = {"aa": ["ka", "lo", "mi", "ren"], "bb": ["schu", "ter", "ung", "ach"], "cc": ["ño", "ción", "que", "llo"]}


def corpus(n, seed=1):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        lang = rnd.choice(sorted(SYLLABLES))
        out.append((" ".join("".join(rnd.choices(SYLLABLES[lang] + ["ta", "en"], k=rnd.randint(1, 3))) for _ in range(rnd.randint(3, 30))).title(), lang))
    return out


def plain(taught, text):
    """Naive Bayes in plain loops over letter pairs and triples, with the bins' smoothing."""
    def grams(t):
        words = re.findall(r"[^\W\d_]+", t.lower())
        line = f" {' '.join(words)} "
        return Counter([line[i : i + k] for k in (2, 3) for i in range(len(line) - k + 1)]) if words else Counter(), len(words)

    sums = {lang: Counter() for _, lang in taught}
    for t, lang in taught:
        sums[lang].update(grams(t)[0])
    asked, words = grams(text)
    score = {lang: sum(n * math.log((c[g] + L.SMOOTHING) / (c.total() + L.SMOOTHING * L.BINS)) for g, n in asked.items()) for lang, c in sums.items()}
    return max(sorted(score), key=score.get) if words >= L.LEAST_WORDS else None


def test_like_plain_naive_bayes(spark):
    taught, asked = corpus(150), corpus(80, 2) + [("", "aa"), ("12 34 ...", "aa"), ("kalo miren", "aa"), ("KALO " * 300_000, "aa")]
    model = L.fit(spark.createDataFrame([*taught, (None, "aa"), ("kalo", None)], "text string, language string"))
    rows = L.detected(spark.createDataFrame([*asked, (None, None)], "text string, language string"), model).collect()
    got = {r["text"]: r["detected"] for r in rows}
    assert len(rows) == len(asked) + 1 and got[None] is None and got[""] is None and got["12 34 ..."] is None
    wrong = [t for t, _ in asked[:80] if got[t] != plain(taught, t)]
    assert len(wrong) <= 1  # bins hold more than one n-gram
    assert got["KALO " * 300_000] == "aa"


def test_nothing_to_learn_and_too_much(spark, monkeypatch):
    none = L.fit(spark.createDataFrame([], "text string, language string"))
    assert none.of("one two three four five six seven") is None and not none.more_than_one()
    monkeypatch.setattr(L, "MAX_LANGUAGES", 2)
    try:
        L.fit(spark.createDataFrame(corpus(30), "text string, language string"))
        raise AssertionError
    except ValueError as e:
        assert "languages" in str(e)


def test_held_out_accuracy_on_documents(spark):
    rows = [r for r in QUERIES["detected_languages"](spark, str(DATA)).where("held_out and lang is not null and detected is not null").collect()]
    assert len(rows) > 20 and sum(r["detected"] == r["lang"] for r in rows) / len(rows) > 0.9
