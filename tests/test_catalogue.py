"""Rules E2, M1 and R1: a sound run with an index passes, and each fault is found."""

import json

from corvane.plans import rules
from corvane.sources.land import land
from tests.tree import build, lines


def found(spark, root):
    t, o = land(spark, root), rules.Options()
    rows = [r for f in (rules.structure, rules.summary, rules.parity) for r in f(t, o).collect()]
    return sorted((r.rule, r.scope, r.status, r.bad) for r in rows if r.rule in ("E2", "M1", "R1"))


def test_version_index_and_repeated_chunk_runs(spark, tmp_path):
    root = build(tmp_path / "sound")
    for polarity, first in (("Positive", 0), ("Negative", 1)):
        (root / polarity / "outputs/metadata/index.jsonl").write_text(lines([{"stem": f"doc{k}"} for k in range(first, 6, 2)]))
    sides = [f"Agreements / {p}" for p in ("Negative", "Negative", "Positive", "Positive")]
    assert found(spark, root) == [("E2", "Agreements", "PASS", 0)] + [("R1", s, "PASS", 0) for s in sides]
    root = build(tmp_path / "broken")
    summary = json.loads((root / "export_summary.json").read_text())
    (root / "export_summary.json").write_text(json.dumps(summary | {"version": "Version_20240101_0000"}))
    (root / "Positive/outputs/metadata/index.jsonl").write_text(lines([{"stem": "doc0"}, {"stem": "other"}]) + "{broken\n")
    (root / "Negative/outputs/metadata/index.jsonl").write_text("")
    for name in ("chunk_run_1", "chunk_run_2"):
        (root / "Disagreements/SITGrader" / name).mkdir(parents=True)
    (root / "Disagreements/Positive").mkdir()
    assert found(spark, root) == [
        ("E2", "Agreements", "FAIL", 1), ("M1", "Disagreements", "WARN", 1),
        ("R1", "Agreements / Negative", "FAIL", 3), ("R1", "Agreements / Positive", "FAIL", 1), ("R1", "Agreements / Positive", "FAIL", 3),
    ]
