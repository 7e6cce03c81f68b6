import random
import re
from collections import Counter

import numpy as np
import pandas as pd

from corvane.llm import quality


def plain(text):
    text = text or ""
    words = re.findall("[^ \t-\r]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, marked = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            marked |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


def texts():
    rnd = random.Random(6)
    made = ["".join(rnd.choices(["a ", "b ", "c\n", "ü# ", "\n", "\xa0", "\x0b", "$"], k=rnd.randint(0, 80))) for _ in range(200)]
    return [None, "", " ", "a b c d e a b c d e", "a a a a a a", "same\nsame\n same\n\n", "x " * 20_000, *made, made[0], made[0]]


def test_statistics_like_a_plain_loop(spark):
    given = texts()
    found = quality.text_stats(given)
    assert list(zip(*(found[s].tolist() for s in quality.STATS), strict=True)) == [plain(t) for t in given]
    df = spark.createDataFrame([(i if i else None, t, 5) for i, t in enumerate(given)], "doc_id long, text string, n_words long")
    rows = quality.statistics(df).collect()
    want = sorted(str((i if i else None, *plain(t), plain(t)[0] < 10 or 100 * plain(t)[4] > 20 * plain(t)[0])) for i, t in enumerate(given))
    assert sorted(str(tuple(r)) for r in rows) == want
    assert quality.statistics(df.where("false")).collect() == []


def labelled(n=3000):
    rnd = np.random.default_rng(1)
    t = pd.DataFrame({"doc_id": np.arange(n), "n_words": rnd.integers(20, 900, n), "n_dup_lines": rnd.integers(0, 3, n), "n_repeat_words": 0})
    t["word_chars"] = (t["n_words"] * rnd.normal(5, 0.2, n)).astype(int)
    t["n_symbols"] = 0
    kind = rnd.integers(0, 6, n)
    t.loc[kind == 0, "n_symbols"] = t["n_words"]
    t.loc[kind == 1, "word_chars"] = t["n_words"] * 8
    t["bad"] = (kind == 0) | ((kind == 1) & (t["n_words"] > 100))
    t["part"] = t["doc_id"] % 3
    return t


def test_learned_list_separates(spark):
    t = labelled()
    rules = quality.learn(t)
    values = {k: np.asarray(f(t), float) for k, (_, f) in quality.FEATURES.items()}
    gone = np.zeros(len(t), bool)
    for r in rules:
        gone |= quality.covers(r, values)
    assert (gone == t["bad"]).mean() > 0.995
    assert any(len(r) > 1 for r in rules)
    kept = spark.createDataFrame(t[[*quality.STATS, "doc_id"]]).select("doc_id", quality.verdict(rules).alias("kept")).toPandas().sort_values("doc_id")
    assert (kept["kept"].to_numpy() == ~gone).all()


def test_noise_gives_no_rules():
    t = labelled()
    t["bad"] = np.random.default_rng(3).random(len(t)) < 0.1
    assert quality.learn(t) == []
    assert quality.learn(t.assign(bad=False)) == [] and quality.learn(t.iloc[:0]) == []


def test_sample_takes_one_label_each(spark):
    df = spark.createDataFrame([(i, "word " * 30 + str(i)) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(1, 0), (None, 1), (2, None), (99, 0)], "doc_id long, quality int")
    stats = quality.statistics(df.withColumn("text", df["text"]))
    sample = quality.labelled_sample(stats.withColumn("base_failed", stats["doc_id"] < 0), labels)
    assert len(sample) == 50 and sample.set_index("doc_id")["bad"][1]
    assert 5 <= len(quality.labelled_sample(stats.withColumn("base_failed", stats["doc_id"] < 0), labels, rows=20)) <= 40
