"""The library without the corpus folders: it imports, registers its queries, and its tests are collected."""

import os
import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_the_rest_stands_alone(tmp_path):
    skip = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache", "metastore_db", "spark-warehouse")
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    env = {**os.environ, "PYTHONPATH": str(copy)}
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0 and int(done.stdout.split()[-1]) > 100, done.stderr[-2000:]
    found = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=copy, env=env, capture_output=True, text=True, timeout=240)
    assert found.returncode == 0 and "error" not in found.stdout.lower().split("\n")[-2], found.stdout[-2000:]
