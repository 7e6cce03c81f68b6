"""A small run tree that breaks no rule, built from scratch."""

import json
from pathlib import Path

from corvane.plans.fields import REQUIRED

VERSION = "Version_20250101_1200"
ENTITY = "Sample Number"


def write(path: Path, value) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def lines(rows) -> str:
    return "".join(json.dumps(r) + "\n" for r in rows)


def build(top: Path, graded: bool = False, documents: int = 6, words: int = 0) -> Path:
    root = top / ENTITY / VERSION
    combined, context, index = [], [], {}
    for k in range(documents):
        positive = k % 2 == 0
        polarity, stem, value = ("Positive" if positive else "Negative"), f"doc{k}", f"{k}23-456-{k}89"
        text = f"Opening words number {k} of this document. " + "Filler text goes on here. " * (k % 12) + " ".join(f"word{k * j % 7919}" for j in range(words)) + f"The member keyword is {value} as stated in line {k}. Closing words follow."
        start = text.index(value)
        name = f"{stem}.docx"
        out = root / polarity / "outputs"
        instance = {f: "x" for f in REQUIRED} | {
            "doc_id": stem, "value": value, "normalized_value": value, "value_start_offset": str(start), "value_end_offset": start + len(value), "keyword_present": "True", "keyword": "keyword",
            "keyword_distance": "10", "keyword_direction": "before", "difficulty": "easy", "semantic_ground_truth": positive, "expected_engine_match": positive, "actual_engine_match": positive, "sit_extensions": {"keyword_requirement": "mandatory"},
        }
        side = "sit_values" if positive else "lookalike_values"
        row = {
            "doc_id": stem, "stem": stem, "filename": name, "file_ext": ".docx", "file_format": "docx", "sit_name": ENTITY, "label": polarity.lower(), "language": "en",
            "sit_category": f"easy {polarity.lower()}", side: {"number": [value]}, "scenario_id": f"case-{k % 3}", **{d: f"{d}{k % 3}" for d in "domain department function workflow process persona role document_type".split()},
        }
        combined.append(row)
        folder = f"/data/{VERSION}/{polarity}"
        write(out / "metadata" / f"{stem}.json", row | {"raw_doc": f"{folder}/{name}", "docparser": {"raw_output": folder, "parsed": folder, "chunks": folder}, "instances": [instance]})
        write(out / "raw_doc" / name, "raw")
        write(out / "parsed_raw_doc" / f"{stem}.json", {})
        write(out / "parsed_raw_doc/chunks" / f"{name}.json", {"value": [{"snippets": [{"index": 0, "label": positive, "sit_found": True, "snippet": value}]}]})
        write(out / "parsed_raw_doc/plain_text" / f"{name}.txt", text)
        window = {"text": text, "left_context_length": 1, "right_context_length": 1, "exact_content_length": 1, "detected_sit_start_index": 1, "detected_sit_end_index": 1, "language": "en"}
        context.append({"sit_name": ENTITY, "confidence": "85", "doc_path": f"{folder}/{name}", "value": value, "doc_content_length": len(text), "detected_sit_start_index": start, "detected_sit_end_index": start + len(value) - 1, "language": "en", "ground_truth": str(positive), "sit_category": row["sit_category"], "domain": "d", "file_format": "docx", "document_name": name, "doc_id": stem, "context_100": window})
        index[value] = {name: [{"chunk_id": 0, "chunk_content": text, "chunk_label": positive}]}
    for polarity in ("Positive", "Negative"):
        write(root / polarity / "outputs/metadata/index.jsonl", lines([{"stem": r["stem"]} for r in combined if r["label"] == polarity.lower()]))
    write(root / "combined_metadata.jsonl", lines(combined))
    write(root / "corpus.jsonl", lines(combined))
    write(root / "context_output_normalized/all.json", context)
    write(root / "sit_inverted_index.json", {ENTITY: index})
    write(root / "export_summary.json", {"sit_name": ENTITY, "version": VERSION, "output_dir": f"/data/{VERSION}", "counts": {"positive": (documents + 1) // 2, "negative": documents // 2, "total": documents}, "normalized_context": {"records": documents, "ground_truth": {"true": (documents + 1) // 2, "false": documents // 2}}})
    grader = root / "Disagreements/SITGrader"
    scores = {"total_chunk_value_records": 4, "agreements": 3, "disagreements": 1, "agreement_rate": 0.75}
    if graded:
        write(grader / "chunk_run_1/chunk_summary.json", scores)
        write(grader / "chunk_run_1/chunk_grades.jsonl", lines([{"grade": i} for i in range(4)]))
        more = {"source_labels": {"true": 2, "false": 2}, "grader_labels": {"true": 3, "false": 1}, "evaluated_documents": 3, "unevaluated_documents": 1, "disagreement_documents": 1}
        write(grader / "misc/evaluation_summary.json", scores | more)
        write(grader / "misc/chunk_evaluations.jsonl", lines([{"chunk_label": i < 2, "grader_label": i < 3, "chunk_content": "x"} for i in range(4)]))
        write(grader / "misc/evaluation_manifest.jsonl", lines([{"document_name": f"d{i}", "chunk_value_records": 1, "agreement": x} for i, x in enumerate([True, True, False, None])]))
    write(root / "generation_log.json", {"schema_version": "1", "dataset_version": VERSION, "generated_at": "now", "sit_name": ENTITY, "generator": {"model": "m", "model_version": "1"}, "sit_grader": {"model": "m"}, "mce": {"version": "1"}, "docparser": {"version": "1"}})
    return root
