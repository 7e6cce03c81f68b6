import random


from corvane.llm import linededup
from corvane.llm.linededup import apply_bitmaps, dropped_lines

SPACES = " \t\n\x0b\x0c\r"


def plain(rows):
    """The contract, in a plain loop."""
    low = {chr(c): chr(c + 32) for c in range(65, 91)}
    key = lambda x: "".join(low.get(c, c) for c in x.strip(SPACES))
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add((i is None, i or 0))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == (i is None, i or 0)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def found(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    done = apply_bitmaps(df, dropped_lines(df)).select("doc_id", "_n_lines", "_n_dropped", "_kept").collect()
    return sorted(map(tuple, done), key=str)


def made(n=150, hot=None):
    rnd = random.Random(2)
    pool = ["This line is shared", "  this LINE is shared\t", "ÄÖÜ äöü longer line", "short", "", "exactly10!", "nine char", "x" * 50, "\xa0no break space", "a\x0bb\x0cc\rddddddd"]
    rows = [(i, "\n".join(rnd.choices(pool, k=rnd.randint(0, 6)) + [f"own line of {i}"] * rnd.randint(0, 2) + ([hot] if hot else []))) for i in range(n)]
    return [*rows, (None, "This line is shared\nonly null has this"), (7, None), (8, ""), rows[3], rows[3], (9, "This line is shared\n" * 200)]


def test_like_a_plain_loop(spark):
    rows = made()
    assert found(spark, rows) == plain(rows)


def test_hot_keys_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(linededup, "HOT_SAMPLE", 1)
    rows = made(300, "a line in every document")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert not linededup.hot_keys(linededup.keyed_lines(df, "doc_id", "text", 10), 4).isEmpty()
    assert found(spark, rows) == plain(rows)


def test_other_columns_empty_table_and_long_text(spark):
    assert found(spark, []) == []
    long = "\n".join(f"line number {i % 900}" for i in range(20_000))
    rows = [(2, long), (1, "line number 5\nline number 899\nelse")]
    assert found(spark, rows) == plain(rows)
    df = spark.createDataFrame([(1, "some longer line", "a"), (2, "some longer line", "b")], "doc_id long, text string, pos string")
    assert apply_bitmaps(df, dropped_lines(df)).select("pos", "_kept").orderBy("pos").collect() == [("a", "some longer line"), ("b", "")]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    bitmaps = linededup._bitmaps(linededup.keyed_lines(df, "doc_id", "text", 10), None, 4)
    plans = [x._jdf.queryExecution().toString() for x in (apply_bitmaps(df, dropped_lines(df)), bitmaps)]
    assert not any("Python" in plan or "Arrow" in plan for plan in plans)
    assert "rangepartitioning" in plans[1] or "RepartitionByExpression" in plans[1]


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "some longer line", 1, 2, 3, 4, 5)], "doc_id long, text string, _words int, _kept int, id int, row int, `a.b` int")
    done = apply_bitmaps(df, dropped_lines(df))
    assert done.columns == ["doc_id", "text", "_words", "id", "row", "a.b", "_n_lines", "_n_dropped", "_kept"]
    assert [tuple(r) for r in done.collect()] == [(1, "some longer line", 1, 3, 4, 5, 1, 0, "some longer line")]
