import random

import pytest

from corvane.llm.hamming import nearest

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k, asks, dimensions):
    bits = [(i, sum(1 << j for j, x in enumerate(v) if x is not None and x > 0)) for i, v in rows if i is not None and v is not None and len(v) == dimensions]
    out, ranked = [], {}
    for q, c in bits:
        if asks(q):
            ranked.setdefault(q, []).extend(((c ^ d).bit_count(), i) for i, d in bits if i != q)
    for q, near in ranked.items():
        out += [(q, n + 1, i, far) for n, (far, i) in enumerate(sorted(near)[:k])]
    return sorted(out)


def found(spark, rows, k, dimensions=64, width=16):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, nearest(df, df["vec_id"] % 10 == 0, k, dimensions, width).collect()))


@pytest.mark.parametrize("dimensions, width", [(64, 8), (32, 4), (128, 16)])
def test_like_brute_force(spark, dimensions, width):
    rnd = random.Random(dimensions)
    centres = [[rnd.gauss(0, 1) for _ in range(dimensions)] for _ in range(6)]
    rows = [(i, [x + rnd.gauss(0, 0.4) for x in rnd.choice(centres)]) for i in range(250)]
    rows += [(300 + i, rows[0][1]) for i in range(40)]  # many equal vectors, queries among them
    rows += [(1000, None), (1010, [1.0]), (None, rows[0][1]), (1020, [None] * dimensions)]
    assert found(spark, rows, 5, dimensions, width) == plain(rows, 5, lambda i: i % 10 == 0, dimensions)


def test_few_rows(spark):
    assert found(spark, [], 3) == []
    rows = [(0, [1.0] * 64), (1, [-1.0] * 64)]
    assert found(spark, rows, 3) == [(0, 1, 1, 64)]
    assert found(spark, rows[:1], 3) == []


def test_repeated_ids_and_other_columns(spark):
    one = [1.0] * 64
    rows = [(100, one)] * 12 + [(i, [-1.0] * i + [1.0] * (64 - i)) for i in range(1, 8)]
    assert found(spark, rows, 10) == plain(rows, 10, lambda i: i % 10 == 0, 64) and len(found(spark, rows, 10)) == 10
    rnd = random.Random(4)
    vector = lambda: [rnd.choice([-1.0, 1.0]) * (1 if j < 12 else 0) for j in range(64)]
    rows = [(rnd.choice([0, 0, 10, 10, 20, 1, 2, 3, 3, 3, 4, 5]), vector()) for _ in range(200)]
    rows += [(10, rows[0][1]), (30, rows[0][1]), *rows[:30], *[(3, rows[1][1])] * 9]
    for k in (1, 4, 9):
        assert found(spark, rows, k, width=8) == plain(rows, k, lambda i: i % 10 == 0, 64)
    wide = spark.createDataFrame([(i, v, "a", 1, 2.0) for i, v in rows[:40]], SCHEMA + ", id string, n int, w0 double")
    assert sorted(map(tuple, nearest(wide, wide["vec_id"] % 10 == 0, 4, width=8).collect())) == plain(rows[:40], 4, lambda i: i % 10 == 0, 64)
