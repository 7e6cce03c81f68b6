"""Rules on notes, languages and the grader's second summary, each with a fault."""

import json

import pytest

from corvane.plans import rules
from corvane.plans.audit import metrics
from corvane.plans.rules import Options
from corvane.sources.land import land
from tests.tree import build


def found(rows):
    return {(r.rule, r.title): (r.status, r.bad) for r in rows}


def edit(path, change):
    value = json.loads(path.read_text())
    change(value)
    path.write_text(json.dumps(value))


def test_grader(spark, tmp_path):
    sound = found(rules.grader(land(spark, build(tmp_path / "a", graded=True)), Options()).collect())
    assert {status for status, _ in sound.values()} == {"PASS"}
    assert {r for r, _ in sound} == {"T1", "T2", "T3", "T4", "T5", "T6", "T7", "T8", "T9", "T10", "T11", "T12", "T13", "T14"}
    root = build(tmp_path / "b", graded=True)
    misc = root / "Disagreements/SITGrader/misc"
    edit(misc / "evaluation_summary.json", lambda v: v.update(agreements=4, agreement_rate=0.5, source_labels={"true": 1, "false": 3}, disagreement_documents=2, unevaluated_documents=3))
    odd = {k for k, (status, _) in found(rules.grader(land(spark, root), Options()).collect()).items() if status != "PASS"}
    assert {r for r, _ in odd} == {"T8", "T9", "T11", "T13", "T14"} and len(odd) == 8
    (misc / "evaluation_summary.json").write_text("{")
    (misc / "evaluation_manifest.jsonl").unlink()
    odd = {k[0] for k, (status, _) in found(rules.grader(land(spark, root), Options()).collect()).items() if status == "FAIL"}
    assert odd == {"T7", "T13"}


def test_composition_notes(spark, tmp_path):
    root = build(tmp_path)
    path = root / "combined_metadata.jsonl"
    rows = [json.loads(x) for x in path.read_text().splitlines()]
    for i, r in enumerate(rows):
        r["persona"] = "one" if i else "other"
        if i in (0, 2):
            r["sit_values"] = {"number": ["AB-1 2"], "more": ["ab12"]} if i else {"number": ["ab 12"]}
    rows[0]["sit_category"] = "hard positive"
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    got = found(rules.composition(land(spark, root), Options()).collect())
    assert got["D9", "no persona holds 80 % of the documents or more"] == ("PASS", 1) and got["D4", "no domain holds 80 % of the documents or more"] == ("PASS", 0)
    assert got["D12", "positive values are used once"] == got["D12", "no positive value is reused, mixed"] == ("PASS", 1)
    assert got["D12", "no positive value is reused, easy"] == got["D13", "negative values are used once"] == ("PASS", 0)


def test_context_and_structure_notes(spark, tmp_path):
    root = build(tmp_path)
    edit(root / "context_output_normalized/all.json", lambda v: [r.update(language="en" if i else "de") or r.pop("domain") for i, r in enumerate(v)])
    t = land(spark, root)
    got = found(rules.context(t, Options()).collect())
    assert got["C4", "domain is in the schema"] == got["C7", "one language is spoken"] == ("PASS", 1) and got["C8", "all records are in one language"] == ("WARN", 1)
    got = found(rules.structure(t, Options()).collect())
    assert got["S2", "the version folder is named by its date"] == ("PASS", 0)
    assert found(rules.scenarios(t, Options()).collect())["Q2", "the scenario begins with the entity's name"] == ("PASS", 6)


def test_purity(spark, tmp_path):
    root = build(tmp_path)
    t = land(spark, root)
    score = metrics(t)["target_language_purity"]
    t.release()
    assert score == {"score": 1.0, "grade": "strong", "gate": False}
    (root / "Positive/outputs/parsed_raw_doc/plain_text/doc0.docx.txt").write_text("und der Hund und die Katze von den Nachbarn " * 4)
    score = metrics(land(spark, root))["target_language_purity"]
    assert 0 < score["score"] < 1 and score["score"] == pytest.approx(0.75, abs=0.15)


def test_each_context_file_is_held_against_the_summary(spark, tmp_path):
    root = build(tmp_path)
    path = root / "context_output_normalized/all.json"
    rows = json.loads(path.read_text())
    t = land(spark, root)
    whole = found(rules.summary(t, Options()).collect())
    t.release()
    assert whole["E8", "records are those in the context file"][0] == whole["E9", "true and false records are those in the context file"][0] == "PASS"
    path.write_text(json.dumps(rows[:3]))
    (path.parent / "more.json").write_text(json.dumps(rows[3:]))
    t = land(spark, root)
    halves = found(rules.summary(t, Options()).collect())
    t.release()
    assert halves["E8", "records are those in the context file"] == halves["E9", "true and false records are those in the context file"] == ("FAIL", 2)


def test_content_takes_the_value_else_its_normal_form(spark, tmp_path):
    root = build(tmp_path)
    for k, change in ((0, {"value": "not there at all"}), (2, {"value": "", "normalized_value": "absent too"}), (4, {"value": "", "normalized_value": None})):
        path = root / f"Positive/outputs/metadata/doc{k}.json"
        doc = json.loads(path.read_text())
        doc["instances"][0] |= change
        doc["filename"] = "wrong.docx"
        path.write_text(json.dumps(doc))
    t = land(spark, root)
    rows = {(r["rule"], r["scope"]): (r["status"], r["checked"], r["bad"]) for r in rules.content(t, Options()).collect()}
    t.release()
    assert rows["V1", "Agreements / Positive"] == ("FAIL", 2, 2) and rows["V1", "Agreements / Negative"] == ("PASS", 3, 0)
