"""The entry points work in a copy of the repository without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
names = set(e.queries())
assert "way_index" in names and set(e.oracle_sql()) <= names, names
assert not any(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in names), names
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() > 0
"""


@pytest.mark.parametrize("pipeline", [False, True])
def test_without_corpus(tmp_path, pipeline):
    """Whether the pipeline's file is deleted with the folders or not."""
    if not os.path.isdir(os.path.join(ROOT, "gridloom", "llm")) and pipeline:
        pytest.skip("there is nothing to take out")
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])))
    done = subprocess.run([sys.executable, "-B", "-c", CODE], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
