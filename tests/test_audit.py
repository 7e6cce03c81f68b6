import json
import shutil

import pytest

from corvane.plans.audit import audit, results, to_html, to_json
from corvane.plans.rules import Options
from corvane.sources.land import land
from corvane.sources.runs import find_runs
from tests.tree import ENTITY, VERSION, build


@pytest.fixture(scope="module")
def report(spark, tmp_path_factory):
    return audit(spark, build(tmp_path_factory.mktemp("run")))


def test_a_sound_run_passes(report):
    odd = [(r["rule"], r["scope"], r["title"], r["examples"]) for r in report["results"] if r["status"] != "PASS"]
    assert odd == []
    rules = {r["rule"] for r in report["results"]}
    assert {"S3", "S8", "C2", "C6", "I1", "I2", "E4", "E12", "G10", "K2", "K5", "D1", "N1", "M2", "M4", "M8", "W1", "V1", "V2", "O1", "J1", "X1", "Q3", "Y2", "R2", "R8", "SC3", "H2", "Z2"} <= rules


def test_statistics(report):
    stats = report["statistics"]
    assert stats["labels"] == [{"total": 6, "easy_positive": 3, "easy_negative": 3, "hard_positive": 0, "hard_negative": 0, "other": 0}]
    assert {r["bucket"]: r["generated"] for r in stats["breakdown"]} == {"easy positive": 3, "easy negative": 3, "total": 6}
    assert stats["language"] == [{"value": "en", "n": 6, "total": 6}]
    assert stats["lengths"][0]["total"] == 6 and sum(r["n"] for r in stats["histogram"]) == 6
    assert {r["polarity"]: r["percent"] for r in stats["coverage"]} == {"Positive": 100.0, "Negative": 100.0}


def test_metrics_and_exports(report):
    assert report["metrics"]["negative_label_uniqueness"]["score"] == pytest.approx(1 / 3)
    assert report["metrics"]["keyword_proximity_diversity"] == {"score": 0.0, "grade": "critical", "gate": True}
    assert report["verdict"] == "NOT READY"
    assert json.loads(to_json(report))["verdict"] == "NOT READY"
    assert "<h1>NOT READY</h1>" in to_html(report)


def test_broken_run(spark, tmp_path):
    """One fault for each of many rules; each is found, with its exact count."""
    root = build(tmp_path)

    def edit(path, change):
        file = root / path
        value = json.loads(file.read_text())
        change(value)
        file.write_text(json.dumps(value))

    edit("export_summary.json", lambda v: v["counts"].update(total=7))
    edit("generation_log.json", lambda v: v.update(extra=1, mce={"version": ""}))
    edit("context_output_normalized/all.json", lambda v: (v[0].update(confidence="85d"), v[1].update(language="de"), v[2].update(value="missing value"), v[3].update(sit_category=" Undetermined ")))
    edit("Positive/outputs/metadata/doc0.json", lambda v: (v.update(filename="a/doc0.docx", raw_doc="/data/Version_20240101_0000/x"), v["instances"][0].update(expected_engine_match="False", pair_id=None)))
    edit("Positive/outputs/metadata/doc2.json", lambda v: (v.update(scenario_id="other", language="fr"), v["instances"][0].update(value="000", normalized_value="000")))
    edit("Negative/outputs/parsed_raw_doc/chunks/doc1.docx.json", lambda v: v["value"][0]["snippets"][0].update(label=True))
    edit("sit_inverted_index.json", lambda v: next(iter(v[ENTITY].values()))["doc0.docx"][0].update(polarity="x", chunk_id=None))
    (root / "Positive/outputs/raw_doc/doc4.docx").unlink()
    (root / "Negative/outputs/metadata/doc5.json").write_text("{broken")
    (root / "Negative/outputs/raw_doc/doc0.docx").write_text("x")
    (root / "strange.bin").write_text("")
    with (root / "corpus.jsonl").open("a") as f:
        f.write("not json\n")
    found = {}
    for r in results(land(spark, root)):
        if r["status"] != "PASS":
            found[r["rule"]] = found.get(r["rule"], 0) + r["bad"]
    assert not [r for r in found if len(r) > 4 and r != "MCE"], found  # no rule crashed
    for rule in ("E4", "G4", "C6", "C8", "X1", "C2", "SC2", "Y2", "M2", "N1", "Q3", "J1", "V1", "M6", "M8", "I1", "I3", "R2", "Z1", "Z2", "H2", "E13", "I2", "C1"):
        assert found.get(rule), (rule, found)
    assert found["C6"] == found["C8"] == found["C2"] == found["E13"] == found["M6"] == found["I1"] == 1


def test_missing_files_and_samples(spark, tmp_path):
    root = build(tmp_path)
    for name in ("corpus.jsonl", "generation_log.json", "sit_inverted_index.json"):
        (root / name).unlink()
    shutil.rmtree(root / "context_output_normalized")
    rows = results(land(spark, root), Options(sample_size=2))
    bad = {r["rule"] for r in rows if r["status"] == "FAIL"}
    assert {"S4", "S6", "S7", "G1"} <= bad and not [r for r in rows if r["title"].startswith("Check crashed")]
    assert max(r["checked"] for r in rows if r["rule"] == "N1") == 2


def test_discovery(tmp_path):
    root = build(tmp_path / "english")
    assert [(r.name, r.language, r.layout) for r in find_runs(tmp_path)] == [(ENTITY, None, "english")]
    assert find_runs(root)[0].label == f"{ENTITY} / {VERSION}"
    shutil.copytree(root, tmp_path / "multi" / ENTITY / "French" / VERSION)
    assert [(r.language, r.layout) for r in find_runs(tmp_path / "multi")] == [("French", "multilingual")]
    (tmp_path / "bare" / "German" / VERSION).mkdir(parents=True)
    assert [(r.name, r.language) for r in find_runs(tmp_path / "bare")] == [("bare", "German")]
    assert find_runs(tmp_path / "nothing") == []
