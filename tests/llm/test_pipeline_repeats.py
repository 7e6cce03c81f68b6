"""Near-dup removal where ids repeat."""

import corpus_pipeline as pipeline
from tests.llm.test_pipeline import SCHEMA


def test_near_dedup_keeps_other_texts_of_an_id_and_repeated_rows_once(spark):
    first = " ".join(f"a{i}" for i in range(60))
    other = " ".join(f"b{i}" for i in range(60))
    rows = [(1, first), (1, first), (2, first + " more"), (2, other), (None, other), (3, ""), (3, "")]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in rows], SCHEMA)
    kept = [(r.doc_id, r.text) for r in pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(1, first), (2, other), (None, other), (3, ""), (3, "")], key=str)


NAMES = "_id _hash _copy _turn _taken _spans _words _kept _key key row id node text_hash size epochs hash epoch mixed lang_pred score rejected in_text a.b".split()


def test_every_stage_takes_any_names_nulls_repeated_rows_and_an_empty_table(spark, tmp_path):
    text = lambda i: " ".join(f"word{i}x{j} lorem" for j in range(30)) + "\nA line that all documents share"
    rows = [*[(i, text(i), "aa", "s") for i in range(30)], (3, text(3), "aa", "s"), (4, text(99), "aa", None), (None, text(98), None, "s"), (None, None, None, None), (7, None, "aa", "s"), (8, "", None, "t")]
    wide = ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *[f"`{n}` int" for n in NAMES]])
    full = spark.createDataFrame([(*r, len(r[1] or ""), *range(len(NAMES))) for r in rows], wide)
    counts = []
    for kind, docs in (("full", full), ("empty", full.limit(0))):
        for name, stage in pipeline.STAGES:
            stage(spark, docs, "").write.parquet(str(tmp_path / kind / name))
            made = spark.read.parquet(str(tmp_path / kind / name))
            if name != "encode":
                assert made.columns == full.columns
                assert all(tuple(r)[5:] == tuple(range(len(NAMES))) for r in made.collect())
            counts.append(made.count())
            docs = made
    # Rejected: texts without a letter. One of the two rows of document 3 goes.
    assert counts[:3] == [33, 33, 32] and counts[3] == counts[4] and counts[5:] == [0] * 5
