from pyspark.sql import functions as F

from corvane.llm import chat

SCHEMA = "tree long, node long, parent long, role string, text string, score double"


def read(df):
    out = df.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("learned", chat.learned_text(F.col("formatted"), F.col("loss")))
    return {(r.tree, r["rank"]): ([(t.role, t.text) for t in r.turns], r.learned, r.leaf) for r in out.collect()}


def test_branches_are_ranked_and_whole(spark):
    rows = [
        (1, 1, None, "user", "root", 1.0), (1, 2, 1, "assistant", "a", 5.0), (1, 3, 1, "assistant", "b", 1.0), (1, 4, 3, "user", "c", 9.0),
        (1, 5, 4, "assistant", "d", None), (None, 1, None, "user", None, 0.0), (2, 1, 99, "assistant", "no parent", 0.0),
        (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0), (3, 3, 1, "user", "hangs on it", 0.0), (4, None, 1, None, "no id", 0.0),
        (1, 5, 4, "assistant", "d", None),
    ]
    got = read(chat.conversations(spark.createDataFrame(rows, SCHEMA)))
    assert got == {
        (1, 1): ([("user", "root"), ("assistant", "b"), ("user", "c"), ("assistant", "d")], "bd", 5),
        (1, 2): ([("user", "root"), ("assistant", "a")], "a", 2),
        (None, 1): ([("user", "")], "", 1),
        (2, 1): ([("assistant", "no parent")], "no parent", 1),
        (4, 1): ([("", "no id")], "", None),
    }
    best = read(chat.conversations(spark.createDataFrame(rows, SCHEMA), top_k=1))
    assert best == {k: v for k, v in got.items() if k[1] == 1}


def test_control_strings_come_back(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "<\\|x|>", "<\\\\|", "|>\n<", "<", "<|", "\n\n", "<|n", ""]
    rows = [(i, j, text) for i, text in enumerate(odd) for j in (0, 1)]
    df = spark.createDataFrame([(i, j, ["assistant", text or None][j], text) for i, j, text in rows], "conv_id long, turn long, role string, text string")
    got = read(chat.conversations(chat.turns_as_replies(df, "conv_id", "turn", "role", "text")))
    for i, text in enumerate(odd):
        assert got[(i, 1)][0] == [("assistant", text), (text, text)]
        assert got[(i, 1)][1] == text


def test_long_chain_empty_table_and_ties(spark):
    chain = spark.range(700).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(0).alias("tree"))
    turns = read(chat.conversations(chat.turns_as_replies(chain, "conv_id", "turn", "role", "text")))[(1, 1)][0]
    assert [t for _, t in turns] == [str(i) for i in range(700)]
    assert chat.conversations(spark.createDataFrame([], SCHEMA)).collect() == []
    tied = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "user", "c"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    turns = read(chat.conversations(chat.turns_as_replies(tied, "conv_id", "turn", "role", "text")))[(1, 1)][0]
    assert [t for _, t in turns] == ["c", "a", "a", "b"]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 1, None, "user", "x", 0.0)], SCHEMA)
    plan = chat.conversations(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_extra_columns_and_a_very_long_text(spark):
    long = "<|im_end|> word " * 50_000
    rows = [(1, 1, None, "user", long, 0.0, "a", 1), (1, 2, 1, "assistant", long, 0.0, "b", 2)]
    df = spark.createDataFrame(rows, SCHEMA + ", up string, leaf int")
    assert read(chat.conversations(df)) == {(1, 1): ([("user", long), ("assistant", long)], long, 2)}
