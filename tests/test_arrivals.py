import json
import shutil

from corvane.plans import rules
from corvane.plans.rules import COLUMNS, Options
from corvane.sources.land import land
from corvane.streaming.audit import judge_arrivals, standing
from tests.tree import build


def told(df):
    return sorted((tuple(sorted(v) if isinstance(v, list) else v for v in r) for r in df.select(*COLUMNS).collect()), key=str)


def test_batches_in_any_order_and_a_restart_give_the_rows_of_one_run(spark, tmp_path):
    root = build(tmp_path / "run", documents=8)
    for k, change in ((0, {"keyword_present": "False"}), (2, {"value": ""}), (3, {"failure_reason": "x", "semantic_ground_truth": True}), (6, {"actual_engine_match": False})):
        path = root / f"{'Negative' if k % 2 else 'Positive'}/outputs/metadata/doc{k}.json"
        doc = json.loads(path.read_text())
        doc["instances"][0] |= change
        doc["filename"] = "x/" + doc["filename"]
        path.write_text(json.dumps(doc))
    (root / "Positive/outputs/metadata/broken.json").write_text("{oops")
    t = land(spark, root)
    whole = told(rules.schema(t, Options()).unionByName(rules.instances(t, Options())))
    t.release()
    assert any(r[4] == "FAIL" for r in whole) and any(r[4] == "WARN" for r in whole)

    state, checkpoint = str(tmp_path / "state"), str(tmp_path / "checkpoint")
    arriving = tmp_path / "arriving" / root.parent.name / root.name
    pattern = f"file://{arriving}/*/outputs/metadata"
    for names in (["doc6", "doc3"], ["doc1"], ["doc0", "doc2", "doc4", "doc5", "doc7", "broken"]):
        for side in ("Positive", "Negative"):
            to = arriving / side / "outputs/metadata"
            to.mkdir(parents=True, exist_ok=True)
            for name in names:
                if (old := root / side / f"outputs/metadata/{name}.json").exists():
                    shutil.copy(old, to)
        judge_arrivals(spark, pattern, state, checkpoint).awaitTermination()
    assert told(standing(spark, state)) == whole
    judge_arrivals(spark, pattern, state, checkpoint).awaitTermination()  # nothing new
    assert told(standing(spark, state)) == whole
    shutil.rmtree(checkpoint)  # all over again, in one batch: the first batch's number is written anew
    shutil.rmtree(state)
    judge_arrivals(spark, pattern, state, checkpoint).awaitTermination()
    assert told(standing(spark, state)) == whole
