"""The engine without the subpackage for training data, in a copy from which its folders are gone."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import __spark_entry__ as e
names = e.queries()
assert len(names) > 50 and not any(n.startswith("op") and n[2:3].isdigit() for n in names) and "pipeline" not in names
assert set(e.oracle_sql()) <= set(names)
from tessera.session import local_session
spark = local_session(2, partitions=2, memory="1g")
assert e.entry(spark).count() > 0 and names["where_eq"](spark, "/root/testdata/sf0.001").count() == 1
"""


@pytest.mark.parametrize("gone", [["tessera/llm", "tests/llm", "corpus_pipeline.py"], ["tessera/llm", "tests/llm"]])
def test_entry(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *(Path(x).name for x in gone)))
    done = subprocess.run([sys.executable, "-c", CODE], cwd=copy, env={**__import__("os").environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
