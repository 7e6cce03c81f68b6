"""Banded pairs are the exact pairs, for long texts too."""

import random

import duckdb

from corvane.operators import similarity as M
from corvane.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    """Long texts, each with a copy that has one more word at the start and another word in a few places."""
    rnd = random.Random(3)
    for i in range(40):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(300, 900))]
        yield 2 * i, words
        other = [f"x{i}", *words]
        for at in rnd.sample(range(len(words)), len(words) * rnd.randint(0, 5) // 200):
            other[at] = f"y{at}"
        yield 2 * i + 1, other


def test_banded_pairs_of_long_texts_are_the_exact_pairs(spark, tmp_path):
    rows = [(i, " ".join(w), "en", "s", 0) for i, w in texts()] + [(100, "one two", "en", "s", 0), (101, "One, two", "en", "s", 0), (102, None, "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    exact = {(r.id_a, r.id_b): r.jaccard for r in QUERIES["shingle_jaccard_pairs"](spark, str(tmp_path)).collect()}
    banded = {(r.id_a, r.id_b): round(r.jaccard, 6) for r in QUERIES["minhash_lsh_pairs"](spark, str(tmp_path)).collect()}
    assert len(exact) > 30 and (100, 101) in exact and min(exact.values()) < 0.85
    assert banded == exact


def near_copies(n, size=1500):
    """Copies of one long text, each with words of its own in a few places."""
    rnd = random.Random(5)
    words = [f"w{rnd.randrange(9000)}" for _ in range(size)]
    for i in range(n):
        own = list(words)
        for at in rnd.sample(range(size), 5):
            own[at] = f"own{i}x{at}"
        yield i, " ".join(own)


def shuffled(spark):
    return sum(x.totalShuffleWrite() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().statusStore().executorList(False)))


def test_exact_pairs_of_a_group_do_not_send_texts_for_each_pair(spark):
    rows = list(near_copies(60))
    texts = spark.createDataFrame(rows, "id long, text string")
    before = shuffled(spark)
    pairs = M.similar_pairs(texts, 75)
    assert pairs.count() == 60 * 59 // 2
    assert shuffled(spark) - before < 10 * sum(len(t) for _, t in rows)


def test_exact_pairs_whatever_is_known_as_frequent_and_however_pairs_are_cut(spark, monkeypatch):
    rows = [*near_copies(25, 120), *((100 + i, " ".join(w)) for i, w in texts()), (200, "one two"), (201, "One, two"), (202, None), (None, "one two"), (203, "three")]
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in rows if i is not None and t and (w := t.lower().replace(",", "").split())}
    wanted = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    frame = spark.createDataFrame(rows, "id long, text string")
    for surveyed, tile in ((8000, 1 << 14), (3, 7), (1, 1)):
        monkeypatch.setattr(M, "SURVEYED", surveyed)
        monkeypatch.setattr(M, "TILE_PAIRS", tile)
        assert sorted((r.id_a, r.id_b) for r in M.similar_pairs(frame, 75).collect()) == sorted(wanted)


def test_banded_pairs_of_a_group_do_not_send_texts_for_each_pair(spark):
    rows = list(near_copies(60))
    frame = spark.createDataFrame(rows, "id long, text string")
    before = shuffled(spark)
    assert M.text_pairs(frame).count() == 60 * 59 // 2
    assert shuffled(spark) - before < 10 * sum(len(t) for _, t in rows)


def test_different_texts_with_equal_sets_have_all_their_pairs(spark, tmp_path):
    words = [f"w{i}" for i in range(40)]
    plain, near = " ".join(words), " ".join([*words, "more"])
    rows = [(1, plain), (2, plain.upper()), (3, ", ".join(words)), (4, near), (5, near), (6, near.upper()), (7, plain), (8, "other words")]
    spark.createDataFrame([(*r, "en", "s", 0) for r in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    ends = [1, 2, 3, 4, 6]  # a text each
    wanted = sorted([(a, b) for a in ends for b in ends if a < b] + [(1, 7), (4, 5)])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("shingle_jaccard_pairs", "minhash_lsh_pairs"):
        got = sorted((r.id_a, r.id_b, round(r.jaccard, 6)) for r in QUERIES[name](spark, str(tmp_path)).collect())
        assert [x[:2] for x in got] == wanted
        assert got == sorted(con.execute(ORACLES["shingle_jaccard_pairs"]).fetchall())
    assert [tuple(r) for r in QUERIES["near_dup_cluster_rate"](spark, str(tmp_path)).collect()] == con.execute(ORACLES["near_dup_cluster_rate"]).fetchall()


def test_shingles_that_no_other_text_has_are_not_sent(spark):
    rnd = random.Random(7)
    own = [(i, " ".join(f"w{rnd.randrange(5000)}" for _ in range(400))) for i in range(300)]
    shared = " ".join(f"s{i}" for i in range(150))
    rows = [*own, *((1000 + i, f"{shared} {t}") for i, t in own[:3]), (2000, own[0][1] + " once more")]
    texts = spark.createDataFrame(rows, "id long, text string").repartition(4).localCheckpoint()
    before = shuffled(spark)
    assert sorted((r.id_a, r.id_b) for r in M.similar_pairs(texts, 75).collect()) == [(0, 2000)]
    assert shuffled(spark) - before < 0.5 * sum(len(t) for _, t in rows)


def test_shingles_are_of_words_in_lower_case_whatever_stands_between(spark):
    of = M.TextShingles().of
    assert of("Ab cd, EF\ngh \u00e9ij").tolist() == of("ab cd ef gh ij").tolist() and len(of("a b c d e f")) == 2 and len(of("a b a b a b a b")) == 2
    assert len(of(" \u00e9?")) == len(of(None)) == len(of("")) == 0 and len(of("one two")) == 1
    assert len({x for t in ("ab c d e f", "a bc d e f", "abc d e f g", "ba c d e f", "x" * 500 + " b c d e", "x" * 501 + " b c d e") for x in of(t)}) == 6
    assert of("x" * 500 + " b c d e").tolist() == M.TextShingles().of("x" * 500 + " b c d e").tolist()
