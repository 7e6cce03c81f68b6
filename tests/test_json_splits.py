import json
import random

import pytest

from corvane.sources import json_splits as S


@pytest.fixture
def tiny_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


TEXTS = ["", "plain", 'say "hi", he\\she said', "a, b], c}", "[{,:", "\\", '\\"', "tab\tline\nend", "ünïcödé 漢字 😀", ",", ",,,", "x" * 300, "a:b", " "]


def value(rnd, depth=0):
    kind = rnd.random()
    if depth > 3 or kind < 0.4:
        return rnd.choice([*TEXTS, 1, -2.5e7, True, None, "1"])
    if kind < 0.7:
        return [value(rnd, depth + 1) for _ in range(rnd.randint(0, 4))]
    return {rnd.choice(TEXTS) + str(i): value(rnd, depth + 1) for i in range(rnd.randint(0, 4))}


STYLES = [{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}, {"ensure_ascii": False, "indent": 1}]


def test_elements_are_those_of_json_load(spark, tmp_path, tiny_splits):
    rnd, wanted = random.Random(5), {}
    for i in range(12):
        rows = [value(rnd) for _ in range(rnd.choice([0, 1, 2, 30]))]
        (tmp_path / f"f {i}.json").write_bytes(b"\xef\xbb\xbf" * (i % 3 == 0) + (" \n" * (i % 2) + json.dumps(rows, **STYLES[i % 5]) + "\n" * (i % 4)).encode())
        wanted[f"f {i}.json"] = rows
    found = S.read(spark, [f"file://{tmp_path}"], 1)
    files = {r["file"]: r for r in found.files.collect()}
    assert {f["name"]: (f["root"], f["bom"], f["error"]) for f in files.values()} == {f"f {i}.json": ("array", i % 3 == 0, None) for i in range(12)}
    got = {n: {} for n in wanted}
    for r in S.elements(found).collect():
        got[files[r["file"]]["name"]][r["pos"]] = json.loads(r["text"])
    assert {n: [v[k] for k in sorted(v)] for n, v in got.items()} == wanted
    assert all(sorted(v) == list(range(len(v))) for v in got.values())
    found.release()


ODD = {
    "blank.json": (" \n ", "empty", None), "object.json": ('{"a": [1, 2]}', "object", None), "cut.json": ('[{"a": 1}, {"a": "x', "array", "truncated"), "cut2.json": ("[1, [2", "array", "truncated"),
    "more.json": ("[1] [2]", "array", "malformed"), "after.json": ("[1], 7", "array", "malformed"), "low.json": ("[1]]", "array", "malformed"), "scalar.json": ("5", "scalar", None), "string.json": ('"[1, 2]"', "scalar", None), "none.json": ("[]", "array", None),
}


def test_root_types_and_errors(spark, tmp_path, tiny_splits):
    for name, (text, _, _) in ODD.items():
        (tmp_path / name).write_text(text)
    found = S.read(spark, [f"file://{tmp_path}"], 1, "*.json")
    assert {f["name"]: (f["root"], f["error"]) for f in found.files.collect()} == {k: v[1:] for k, v in ODD.items()}
    found.release()


def test_maps_in_maps(spark, tmp_path, tiny_splits):
    rnd = random.Random(7)
    text = lambda i: rnd.choice(TEXTS) + str(i)
    wanted = {text(e): {text(v): {text(f): [{"chunk_id": rnd.choice([1, None, "x"]), "chunk_content": rnd.choice(TEXTS)} for _ in range(rnd.randint(0, 3))] for f in range(rnd.randint(0, 4))} for v in range(12)} for e in range(3)}
    wanted["odd"] = {"list": [1, {"a": "b"}, [2]], "number": 5, "empty": {}}
    wanted["flat"] = 7
    wanted["rows"] = [1, "x"]
    (tmp_path / "i.json").write_text(json.dumps(wanted, indent=1))
    found = S.read(spark, [f"file://{tmp_path}/i.json"], 3)
    assert [(f["root"], f["error"]) for f in found.files.collect()] == [("object", None)]
    made, keys = {}, set()
    for r in sorted(S.entries(found).collect(), key=lambda r: r["number"]):
        if r["text"] is None:
            keys.add((r["first"], r["second"]))
        elif r["depth"] == 3 and r["container"] == "{":
            made.setdefault(r["first"], {}).setdefault(r["second"], {}).update(json.loads("{" + r["text"] + "}"))
        elif r["depth"] == 3:
            made.setdefault(r["first"], {}).setdefault(r["second"], []).append(json.loads(r["text"]))
        elif r["depth"] == 2 and r["container"] == "{":
            made.setdefault(r["first"], {})[r["second"]] = json.loads(r["text"])
        elif r["depth"] == 2:
            made.setdefault(r["first"], []).append(json.loads(r["text"]))
        else:
            made[r["first"]] = json.loads(r["text"])
    assert keys == {(e, None) for e in wanted} | {(e, v) for e, of in wanted.items() if isinstance(of, dict) for v in of}
    full = {e: {v: x for v, x in of.items() if x != {}} if isinstance(of, dict) else of for e, of in wanted.items()}
    assert made == full
    found.release()


def test_the_last_of_repeated_keys_counts(spark, tmp_path, tiny_splits):
    (tmp_path / "i.json").write_text('{"a": {"v": {"f": [1], "g": [2]}, "w": {"f": [0]}, "v": {"h": [3]}}, "b": {"v": {"f": [4]}}, "b": {"x": {"f": [5]}, "v": {"k": [6]}}}')
    found = S.read(spark, [f"file://{tmp_path}/i.json"], 3)
    held = lambda last: sorted((r["first"], r["second"], r["text"].strip()) for r in S.entries(found, last).collect() if r["text"])
    assert held(True) == [("a", "v", '"h": [3]'), ("a", "w", '"f": [0]'), ("b", "v", '"k": [6]'), ("b", "x", '"f": [5]')]
    assert len(held(False)) == 7
    found.release()


def test_splits_have_a_limit(spark, tmp_path, tiny_splits, monkeypatch):
    (tmp_path / "a.json").write_text(json.dumps(list(range(500))))
    monkeypatch.setattr(S, "MAX_SPLITS", 3)
    with pytest.raises(ValueError, match="splits"):
        S.read(spark, [f"file://{tmp_path}"], 1)


def test_entries_do_not_read_the_files_again(spark, tmp_path, tiny_splits):
    (tmp_path / "i.json").write_text('{"a": {"v": {"f": [1], "g": [2]}, "w": {"f": [0]}}, "b": {"v": {"f": [4]}}}')
    found = S.read(spark, [f"file://{tmp_path}/i.json"], 3)
    rows = S.entries(found)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Join" not in plan
    assert sorted((r["first"], r["second"], r["text"].strip()) for r in rows.collect() if r["text"]) == [("a", "v", '"f": [1]'), ("a", "v", '"g": [2]'), ("a", "w", '"f": [0]'), ("b", "v", '"f": [4]')]
    found.release()
