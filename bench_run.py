"""Seconds of each stage of the audit over a made run of RUN_DOCUMENTS documents (five files each): one JSON line."""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


def main() -> None:
    from corvane.plans import audit
    from corvane.session import new_session
    from corvane.sources.land import land
    from tests.tree import build

    documents = int(os.environ.get("RUN_DOCUMENTS", "15000"))
    took, start = {}, time.time()

    def lap(name: str) -> None:
        nonlocal start
        took[name], start = round(time.time() - start, 1), time.time()

    with tempfile.TemporaryDirectory(prefix="corvane-bench-") as top:
        root = build(Path(top), documents=documents, words=250)
        spark = new_session("bench", **{"spark.master": f"local[{os.environ.get('BENCH_CPUS', '8')}]", "spark.driver.memory": "12g", "spark.sql.shuffle.partitions": "16", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
        spark.sparkContext.setLogLevel("OFF")
        lap("build")
        tables = land(spark, root)
        for name in ("files", "metadata", "text", "snippets", "combined", "corpus", "context"):
            getattr(tables, name).count()
        lap("land")
        rows = audit.results(tables)
        lap("rules")
        for df in audit.statistics(tables).values():
            df.collect()
        lap("statistics")
        graded = audit.metrics(tables)
        lap("metrics")
        tables.release()
    odd = sorted({r["rule"] for r in rows if r["status"] != "PASS"})
    print(json.dumps({"metric": "seconds of the audit without building the run", "value": round(sum(v for k, v in took.items() if k != "build"), 1), "unit": "sec", "documents": documents, "stages": took, "rows": len(rows), "not passed": odd, "metrics": {k: round(m["score"], 4) for k, m in graded.items()}}))


if __name__ == "__main__":
    main()
