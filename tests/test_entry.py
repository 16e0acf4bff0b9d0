"""The driver entry where the corpus queries are not there."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

from tests.conftest import ROOT

CODE = """
import __spark_entry__ as e
names = set(e.queries())
assert names and not any(n.startswith("op") or n == "pipeline" for n in names), names
assert set(e.oracle_sql()) <= names
"""


RUN = """
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
assert e.queries()["m23_confusion"](spark, "/root/testdata/sf0.001").count() == 1
"""


def copied(folder, *without: str) -> str:
    ignore = shutil.ignore_patterns(".git", "__pycache__", "*.pyc", ".pytest_cache")
    shutil.copytree(ROOT, folder, ignore=ignore)
    for name in without:
        path = folder / name
        shutil.rmtree(path, True) if path.is_dir() else path.unlink(missing_ok=True)
    return str(folder)


def test_imports_without_the_corpus_queries(tmp_path):
    for i, without in enumerate((("evistrata/llm", "tests/llm"), ("evistrata/llm", "tests/llm", "corpus_pipeline.py"))):
        at = copied(tmp_path / str(i), *without)
        subprocess.run([sys.executable, "-c", CODE], cwd=at, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": at}, check=True)


def test_the_rest_runs_without_the_corpus_queries(tmp_path):
    at = copied(tmp_path / "rest", "evistrata/llm", "tests/llm")
    env = os.environ | {"PYTHONPATH": at}
    subprocess.run([sys.executable, "-c", RUN], cwd=at, env=env, check=True)
    listed = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=at, env=env, check=True, capture_output=True, text=True).stdout
    assert "test_queries.py" in listed and "llm" not in listed
