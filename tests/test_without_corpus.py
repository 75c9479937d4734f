"""The rest of the repository works where the corpus operators, their tests and the pipeline are taken out."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = """
import __spark_entry__ as contract
names = set(contract.queries())
assert "filter_eq" in names and not any(n == "pipeline" or n.startswith("op1") for n in names), names
assert set(contract.oracle_sql()) <= names
from cellframe.session import build_session
spark = build_session("bare", "local[2]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"})
print("rows", contract.queries()["filter_eq"](spark, "/root/testdata/sf0.001").count())
"""


def run(folder):
    done = subprocess.run([sys.executable, "-c", PROGRAM], cwd=folder, capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split()[-1]) > 0


def copied(to, *without):
    keep = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *without)
    shutil.copytree(ROOT, to, ignore=keep)
    return to


def test_without_the_folders_and_the_pipeline(tmp_path):
    run(copied(tmp_path / "bare", "llm", "corpus_pipeline.py"))


def test_without_the_folders_alone(tmp_path):
    run(copied(tmp_path / "half", "llm"))
