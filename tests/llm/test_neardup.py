import random
from itertools import combinations

import numpy as np

from corvane.llm import neardup
from corvane.llm.components import components
from corvane.llm.neardup import near_duplicates, signature
from corvane.llm.shingles import Shingler, odd_numbers

LOW = {chr(c): chr(c + 32) for c in range(65, 91)}


def shingles(text):
    words = "".join(LOW.get(c, c) for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
    for c in "\t\n\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((top(i), top(j)))
            parent[y] = x
    return sorted(((i, len(s), None if i is None else top(i), i is None or top(i) == i) for i, s in sets), key=str)


def corpus():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    passage = rnd.choices(words, k=60)
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append((n, text))
        n += 1

    for _ in range(25):
        base = rnd.choices(words, k=rnd.randint(8, 160))
        add(" ".join(base))
        for _ in range(rnd.randint(0, 3)):
            copy = list(base)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            add("  ".join(copy).upper() if rnd.random() < 0.3 else " ".join(copy))
    hot = rnd.choices(words, k=90)
    for _ in range(80):  # one large group of near copies, some of them too far from the others
        copy = list(hot)
        for _ in range(rnd.choice([1, 2, 3, 4, 9])):
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
        add(" ".join(copy))
    for _ in range(30):  # a passage in common makes no near copies
        add(" ".join(rnd.choices(words, k=rnd.randint(5, 40)) + passage))
    return rows


def got(spark, rows, schema="doc_id long, text string"):
    return sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)


def test_like_all_pairs(spark):
    rows = corpus()
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one two"), (1004, "ONE\x0btwo"), (1005, "one two three"), (None, "one two"), rows[0], (1006, rows[0][1])]
    assert got(spark, rows) == plain(rows)


def test_empty_table_long_text_and_other_columns(spark):
    assert got(spark, []) == []
    long = " ".join(f"w{i}" for i in range(50_000))
    df = spark.createDataFrame([(3, long, "a"), (2, long + " end", "b"), (5, "x", "c")], "doc_id long, text string, value string")
    assert sorted(map(tuple, near_duplicates(df).collect())) == [(2, 49_997, 2, True), (3, 49_996, 2, False), (5, 1, 5, True)]


def test_signatures_estimate_similarity():
    shingler, factors = Shingler(), odd_numbers(neardup.COORDINATES, 5)
    rnd = random.Random(1)
    agreed = []
    for _ in range(60):
        words = [f"v{rnd.randrange(10**6)}" for _ in range(700)]
        a, b = shingler.sets(" ".join(words[:600])), shingler.sets(" ".join(words[100:]))
        agreed.append((signature(a, factors) == signature(b, factors)).mean())
    assert abs(np.mean(agreed) - 496 / 696) < 0.03


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 200), (201, 201), (300, 300)]
    labels = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert labels == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
