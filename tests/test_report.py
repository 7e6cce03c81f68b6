"""What a report says beside its rules, and the rules that it gained."""

import json

import pytest

from corvane.plans import report as P
from corvane.plans import rules
from corvane.plans.rules import Options
from corvane.sources.land import land
from tests.tree import VERSION, build


def row(status, category="5. Counts", scope="Agreements", title="counts add up", bad=0, examples=()):
    return {"rule": "E4", "category": category, "scope": scope, "title": title, "status": status, "checked": 3, "bad": bad, "examples": list(examples)}


BAD = {
    "label": "Thing / French / Version_20250101_1200", "verdict": "NOT READY", "metrics": {"sit_position_diversity": P.graded("sit_position_diversity", 0.1), "target_language_purity": P.graded("target_language_purity", 0.98)},
    "results": [row("FAIL", bad=2, examples=["/tmp/x/run/a.json"]), row("FAIL", scope="Disagreements", bad=1), row("PASS", "Folder/File Hygiene", title="<b>names</b>")],
    "doc_counts": {"total": 6, "combined_total": None}, "generation": {"mce_version": "1"}, "statistics": {"labels": [{"total": 6}]},
}


def test_fixes_and_headline():
    assert P.headline(BAD) == ("Hold back", "rules broken: 2; gate metrics that are critical: 1")
    got = [(f["tag"], f["where"], f["what"]) for f in P.fixes(BAD)]
    assert got == [("QC", "2 scopes", "counts add up: 3 of 6 not"), ("CRITICAL", "", "sit_position_diversity is 0.100; 0.6 is the next grade"), ("WEAK", "", "target_language_purity is 0.980; 0.99 is the next grade")]
    fine = BAD | {"results": [row("PASS")], "metrics": {}}
    assert P.headline(fine)[0] == "Release" and P.fixes(fine) == []
    assert [r["verdict"] for r in P.overview({"a": BAD, "b": fine, "c": fine | {"results": [row("WARN")]}})] == ["Needs fixes", "Clean", "Review warnings"]


def test_page():
    core, more = P.core_and_additional(BAD)
    assert list(core) == ["5. Counts"] and list(more) == ["Folder/File Hygiene"]
    page = P.to_html(BAD)
    assert "&lt;b&gt;names" in page and "<b>names" not in page and "Fix these 3" in page and "Statistics: labels" in page and "combined_total" not in page
    assert "href=#qc-run-a" in P.overview_html({"a": BAD}) and "id=qc-run-a" in P.overview_html({"a": BAD})


def test_texts():
    assert P.shown_category("1-2. Folder Structure") == "Folder Structure" and P.shown_category("9b. Content") == "Content" and P.shown_category("Hygiene") == "Hygiene"
    assert P.split_label("A / B / Version_20250101_1200") == ("A / B", "Version_20250101_1200") and P.split_label("A") == ("A", "")
    assert P.shorten("word " * 50, 22) == "word word word word …" and P.shorten("x" * 30, 10) == "x" * 9 + "…" and P.shorten(" fine  so ") == "fine  so" and P.shorten("") == P.shorten(None) == ""
    assert P.without_root(BAD, "/tmp/x")["results"][0]["examples"] == ["run/a.json"]
    for text in (r"C:\Jobs\Run\a.json", r"C:\\Jobs\\Run\\a.json", "C:/Jobs/Run/a.json"):
        assert P.without_root({"x": [text]}, r"C:\Jobs\Run") == {"x": ["a.json"]}
    assert P.without_root("a/b", "") == "a/b" and P.without_root("/tmp/xy/b", "/tmp/x") == "/tmp/xy/b"


@pytest.fixture
def broken(spark, tmp_path):
    root = build(tmp_path)
    (root / "Positive/outputs/metadata/index.jsonl").unlink()
    (root / "Negative/outputs/parsed_raw_doc/doc1.json").write_text("{")
    (root / "Negative/outputs/raw_doc/doc3.docx").write_text("")
    log = json.loads((root / "generation_log.json").read_text())
    (root / "generation_log.json").write_text(json.dumps(log | {"generator": {"model": ""}, "mce": 3}))
    path = root / "combined_metadata.jsonl"
    rows = [json.loads(x) for x in path.read_text().splitlines()]
    rows[1] |= {"generation_model": "big", "instances": [{"sit_extensions": {}}, {"sit_extensions": {"detector_engine_version": "7"}}]}
    rows[2] |= {"generation_model": "other"}
    for r, details in ((rows[3], {"negative": {"b": {"values": [{"sit_category": " "}, {"sit_category": "Hard Negative "}]}}}), (rows[4], {"x": {"values": 3}, "note": '"sit_category": "easy positive"'})):
        r |= {"sit_category": "", "sit_details": details}
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    (root / "sit_merged_index.json").write_text(json.dumps({"a": {"v": {"f": [{"chunk_id": 1, "chunk_content": "x", "polarity": 1}]}}}))
    table = land(spark, root)
    yield table
    table.release()


def test_counts_and_versions(broken):
    counts = P.doc_counts(broken).first().asDict()
    assert counts["total"] == counts["agreements_total"] == 6 and counts["combined_total"] is None and counts["agreements_positive"] == 3
    made = P.generation(broken).first().asDict()
    assert (made["generator_model"], made["mce_version"], made["sit_grader_model"], made["generator_model_version"]) == ("big", "7", "m", None) and made["docparser_version"]
    assert {r.line: r.b for r in broken.combined.select("line", rules.bucket().alias("b")).collect() if r.line in (3, 4)} == {3: "hard negative", 4: "unknown"}


def test_rules(broken):
    def bad(f):
        return {(r.rule, r.scope): r.bad for r in f(broken, Options()).collect() if r.status == "FAIL"}

    assert bad(rules.listings) == {("R1", "Agreements / Positive"): 1}
    assert bad(rules.file_groups) == {("Z3", "Agreements / Negative / raw_doc"): 1, ("Z4", "Agreements / Negative / parsed_raw_doc"): 1}
    assert bad(rules.merged_index) == {("I1", "Agreements"): 1, ("I2", "Agreements"): 1}
    shown = {r.scope: r.examples for r in rules.value_contexts(broken, Options()).collect()}
    assert set(shown) == {"Agreements / Negative", "Agreements / Positive"} and all("keyword is" in x for xs in shown.values() for x in xs)
    assert VERSION in broken.versions["Agreements"]
