import re
from collections import defaultdict

import numpy as np
import pytest

from corvane.llm.mixing import make_plan, mix, mixed_documents, per_document, permute, share_out

SCHEMA = "doc_id long, text string, source string"


def corpus():
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(1 + (i * 37) % 300)), f"s{i % 7}") for i in range(160)]
    rows += [(i, "one hot source " * 40, "hot") for i in range(200, 300)]
    return [*rows, (500, None, "s1"), (501, "", "s1"), (502, " \n", "s2"), (None, "no id here", None), (503, "a\tb\x0bc\n", None), (504, "tiny", "z"), rows[0], rows[0]]


def words(text):
    return len((text or "").encode().split())


def test_targets_stop_at_the_limit():
    sizes, weights = [100, 1000, 1000, 10], [5, 2, 1, 5]
    targets = share_out(sizes, weights, 1.5 * sum(sizes))
    assert sum(targets) == pytest.approx(1.5 * sum(sizes))
    assert targets[0] == 200 and targets[3] == 20 and targets[1] == 2 * targets[2] or targets[1] == 2000
    assert share_out([], [], 0.0) == [] and share_out([0, 4], [5, 2], 6.0) == [0, 6]


def test_permutations_are_bijections():
    for n in (1, 2, 3, 17, 64, 1000):
        x = np.arange(n)
        size, key = np.full(n, n), np.full(n, 12345)
        out = permute(x, size, key)
        assert sorted(out.tolist()) == x.tolist()
        assert permute(out, size, key, backward=True).tolist() == x.tolist()
    assert permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 1)).tolist() != permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 2)).tolist()


def test_plan_takes_exactly_its_words():
    for block in (1, 3, 64):
        plan = make_plan(["a", "b", None], [10, 1000, 77], block_words=block)
        for s in range(3):
            taken = 0
            for j in range(plan.slots[s]):
                epoch, at = divmod(j, plan.blocks[s])
                from corvane.llm.mixing import permutation_key

                b = permute(np.array([at]), plan.blocks[[s]], permutation_key(plan.seed, np.array([s]), np.array([epoch])))
                taken += int(plan.lengths(np.array([s]), b)[0])
            assert taken - plan.trim[s] == plan.words[s]


def test_mix(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = per_document(mix(df, block_words=16, shard_slots=32)).collect()
    assert sorted(str((r.doc_id, r["size"], r.source)) for r in got) == sorted(str((i, words(t), s)) for i, t, s in rows)
    taken, target, size = defaultdict(int), {}, {}
    for r in got:
        assert r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        target[r.source], size[r.source] = r.target, r.source_size
    for s in target:
        assert abs(taken[s] - target[s]) <= 1
        assert size[s] == sum(words(t) for _, t, x in rows if x == s)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    again = per_document(mix(df.repartition(3), block_words=16, shard_slots=32)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_shards_are_full_and_spans_lie_in_documents(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    mixed = mix(df, block_words=16, shard_slots=32)
    spans = mixed.spans.collect()
    slots = {(r.shard, r.slot) for r in spans}
    assert slots == {(i // 32, i % 32) for i in range(int(mixed.plan.slots.sum()))}
    assert all(0 <= r["first"] and r["first"] + r.words <= r["size"] for r in spans)
    per_slot = defaultdict(int)
    for r in spans:
        per_slot[r.shard, r.slot] += r.words
    assert max(per_slot.values()) == 16


def test_mixed_rows_have_the_words_that_are_taken(spark):
    df = spark.createDataFrame([(*r, 0, "x") for r in corpus()], SCHEMA + ", taken long, first string")
    rows = mixed_documents(df, block_words=16, shard_slots=32)
    assert rows.columns == df.columns
    taken = defaultdict(int)
    for r in per_document(mix(df, block_words=16, shard_slots=32)).collect():
        taken[r.doc_id] += r.taken
    had = defaultdict(int)
    for r in rows.collect():
        had[r.doc_id] += words(r.text)
    assert dict(had) == {k: v for k, v in taken.items() if v}


def test_empty_tables(spark):
    for rows in ([], [(1, None, "a")]):
        df = spark.createDataFrame(rows, SCHEMA)
        assert [r.taken for r in per_document(mix(df)).collect()] == [0] * len(rows)
        assert mixed_documents(df).collect() == []


def test_extra_names_repeated_rows_and_a_very_long_text(spark):
    rows = [(1, "a b c", "s", 1, 2), (1, "a b c", "s", 1, 2), (2, "x " * 200_000, "t", 3, 4), (None, None, None, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _taken int, size int")
    got = mixed_documents(df).collect()
    assert {tuple(r)[3:] for r in got} <= {(1, 2), (3, 4)} and words(" ".join(r.text for r in got)) == round(1.5 * 200_006)


def test_no_table_with_a_row_for_each_document_block_or_draw_is_broadcast(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    broadcast = lambda frame: re.findall(r"BroadcastExchange[^\n]*", frame._jdf.queryExecution().executedPlan().toString())
    mixed = mix(df, block_words=16, shard_slots=32)
    assert mixed.spans.count() and broadcast(mixed.spans) == []
    found = per_document(mixed)
    assert found.count() == len(corpus()) and all("input[0, bigint, false]" in x for x in broadcast(found))  # sources alone
    assert broadcast(mixed_documents(df, block_words=16, shard_slots=32)) == []
