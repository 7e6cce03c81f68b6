import random

import numpy as np
from pyspark.sql import functions as F

from corvane.llm import langid

SCHEMA = "doc_id long, text string, lang string"
SYLLABLES = {"aa": ["ka", "lo", "mi", "ren"], "bb": ["schu", "ter", "ung", "ach"], "cc": ["ño", "ción", "que", "llo"]}


def corpus(n=240):
    rnd = random.Random(8)
    rows = []
    for i in range(n):
        lang = rnd.choice(sorted(SYLLABLES))
        rows.append((i, " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.randint(1, 3))) for _ in range(rnd.randint(3, 40))).title(), lang))
    return rows


def test_held_out_accuracy_and_defined_cases(spark):
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 ... !?", "cc"), (1003, "漢字 漢字", "aa"), (None, "kalo miren", None), (1004, "KALO" * 200_000, None)]
    df = spark.createDataFrame([*corpus(), *odd], SCHEMA)
    model = langid.fit(df, F.coalesce(df["doc_id"] < 120, F.lit(False)))
    rows = langid.predict(df, model, carry=("lang",)).collect()
    assert len(rows) == 246
    known = [r for r in rows if r.doc_id is not None and 120 <= r.doc_id < 1000]
    assert np.mean([r.lang_pred == r.lang for r in known]) > 0.95 and not any(r.rejected for r in known)
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 and by_id[i].rejected for i in (1000, 1001, 1002))
    assert by_id[1003].rejected and by_id[1003].lang_pred in SYLLABLES
    assert by_id[1004].lang_pred == by_id[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in rows)


def test_blocks_of_long_texts_count_the_same(monkeypatch):
    text = "Some  words, and äöü more\nwords; " * 30
    whole = langid.trigram_counts([text])
    for block in (1, 2, 7, 64, len(text)):
        monkeypatch.setattr(langid, "BLOCK", block)
        assert (langid.trigram_counts([text]) == whole).all()
    assert whole.sum() == sum(c.isalpha() for c in text)


def test_no_labels_and_empty_table(spark):
    df = spark.createDataFrame([(1, "abc", None), (1, "abc", None)], SCHEMA)
    assert [(r.lang_pred, r.rejected) for r in langid.predict(df, langid.fit(df, F.lit(True))).collect()] == [("und", True)] * 2
    none = df.where("false")
    assert langid.predict(none, langid.fit(none, F.lit(True))).collect() == []


def test_sample_is_bounded(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    model = langid.fit(df, F.lit(True), per_language=5)
    assert model.languages == sorted(SYLLABLES) and len(model.centres) == 3


def test_like_a_plain_classifier():
    """Plain dictionaries and loops give the language and the cosine of the arrays."""
    rows = corpus(200)
    model = langid.fit_counts([lang for _, _, lang in rows[:150]], langid.trigram_counts([t for _, t, _ in rows[:150]]))

    def bin_of(a, b, c):
        x = (ord(a) * 0x9E3779B1 + ord(b) * 0x85EBCA77 + ord(c) * 0xC2B2AE3D) % 2**32
        x = ((x ^ (x >> 15)) * 0x2C1B3C6D) % 2**32
        return x >> 20

    for _, text, _ in rows[150:]:
        words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
        counts = {}
        for w in words:
            for i in range(len(w)):
                k = bin_of(*f" {w} "[i : i + 3])
                counts[k] = counts.get(k, 0) + 1
        weights = {k: (1 + np.log(n)) * float(model.idf[k]) for k, n in counts.items()}
        norm = sum(v * v for v in weights.values()) ** 0.5
        cosines = [sum(v * float(c[k]) for k, v in weights.items()) / norm for c in model.centres]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        names, scores, _ = model.predict(langid.trigram_counts([text]))
        assert names == [model.languages[model.language_of[best]]] and abs(scores[0] - cosines[best]) < 1e-4


def test_repeated_rows_teach_once_and_reruns_agree(spark):
    rows = [r for r in corpus(2000) for _ in range(20)]
    df = spark.createDataFrame([(i, t, g, "x", 1) for i, t, g in rows], SCHEMA + ", id string, label int")
    seen = []
    real, langid.fit_sample = langid.fit_sample, lambda sample, clusters: seen.append(sample) or real(sample, clusters)
    try:
        models = [langid.fit(df, F.lit(True)), langid.fit(df.repartition(7), F.lit(True))]
    finally:
        langid.fit_sample = real
    for sample in seen:
        assert all(sample.labels.count(g) == langid.PER_LANGUAGE for g in SYLLABLES)
    assert np.array_equal(models[0].centres, models[1].centres) and np.array_equal(models[0].floors, models[1].floors)
