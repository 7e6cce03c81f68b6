"""The driver contract, with the pipeline's operators and without them."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as contract

ROOT = Path(__file__).resolve().parent.parent


def test_sql_belongs_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_the_rest_works_without_the_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for kept in (("corpus_pipeline.py",), ()):
        shutil.rmtree(copy / "corvane" / "llm", ignore_errors=True)
        shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
        if not kept:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s)); assert set(s) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q if n[2:3].isdigit() or n == 'pipeline')"
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
