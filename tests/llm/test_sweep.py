import random
from collections import defaultdict

import pytest

from corvane.llm.sweep import seconds, sweep

SCHEMA = "key int, start_s long, end_s long, weight long"


def plain(rows, all_key):
    steps = defaultdict(lambda: [0, 0])
    for key, start, end, weight in rows:
        if start is None or end is not None and end <= start:
            continue
        for k in {key, all_key} if all_key is not None else {key}:
            for at, sign in [(start, 1)] + [(end, -1)] * (end is not None):
                steps[k, at][0] += sign
                steps[k, at][1] += sign * (weight or 0)
    out = []
    for k in {k for k, _ in steps}:
        n = w = high = 0
        mine = []
        for at in sorted(at for of, at in steps if of == k and any(steps[of, at])):
            n, w = n + steps[k, at][0], w + steps[k, at][1]
            high = max(high, n) if mine else n
            mine.append([k, at, None, n, w, high, None])
        for i, row in enumerate(mine):
            row[2], row[6] = mine[i + 1][1] if i + 1 < len(mine) else None, row[3] == max(r[3] for r in mine)
        out += map(tuple, mine)
    return sorted(out, key=str)


def found(spark, rows, *args, schema=SCHEMA, **settings):
    made = sweep(spark.createDataFrame(rows, schema), *args, **settings)
    assert made.columns == ["key", "from_s", "to_s", "n_open", "open_weight", "high_open", "is_peak"]
    return sorted(map(tuple, made.collect()), key=str)


def made(n, seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        start = 60 * rnd.randint(-500, 3000)
        rows.append((rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([start] * 9 + [None]), rnd.choice([start + 60 * rnd.randint(-5, 900)] * 5 + [None]), rnd.choice([None, rnd.randint(-99, 10**6)])))
    return rows + rows[:20] + [(4, 0, 60, 5), (4, 60, 120, 5), (4, 120, 180, 6), (5, 60, 60, 1), (6, 0, None, 0)]


@pytest.mark.parametrize("buckets, all_key", [(1, None), (7, -2), (128, -2), (5000, -2)])
def test_like_a_plain_sweep(spark, buckets, all_key):
    rows = made(400, buckets)
    assert found(spark, rows, all_key, buckets=buckets) == plain(rows, all_key)


def test_one_hot_key_and_moment(spark):
    rows = [(7, 60 * (i % 50), 60 * (i % 50) + 6000, i) for i in range(4000)] + [(7, 0, 60, 1)] * 2000
    assert found(spark, rows, -2) == plain(rows, -2)


def test_few_rows(spark):
    assert found(spark, [], -2) == []
    assert found(spark, [(1, None, 60, 1), (1, 60, 60, 1)], -2) == []
    assert found(spark, [(1, 60, None, 9)]) == [(1, 60, None, 1, 9, 1, True)]


def test_extra_columns(spark):
    rows = [(1, 0, 120, 3, "a", 1, 2)]
    got = found(spark, rows, schema=SCHEMA + ", bucket string, n int, `from_s` int")
    assert got == [(1, 0, 120, 1, 3, 1, True), (1, 120, None, 0, 0, 1, False)]


def test_seconds_are_those_of_the_clock_in_any_zone(spark):
    times = "1969-12-31 23:59:59.5", "1970-01-01 00:00:59.999", "2024-03-31 02:30:00", "2024-10-27 02:30:59"
    df = spark.sql("SELECT * FROM VALUES " + ", ".join(f"(TIMESTAMP_NTZ'{t}')" for t in times) + " AS t(at)")
    before = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("UTC", "Europe/Berlin", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert [r[0] for r in df.select(seconds(df["at"])).collect()] == [-60, 0, 1711852200, 1729996200]
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)
