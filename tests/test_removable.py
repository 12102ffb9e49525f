"""The registry without the optional package."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
names, texts = set(e.queries()), set(e.oracle_sql())
assert len(names) > 200 and texts <= names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names, names
assert e.FLAGSHIP in names
"""


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_queries_without_the_optional_package(tmp_path, also):
    gone = {os.path.join(ROOT, "veil", "llm"), os.path.join(ROOT, "tests", "llm"), os.path.join(ROOT, ".git"), *[os.path.join(ROOT, x) for x in also]}
    shutil.copytree(ROOT, tmp_path / "tree", ignore=lambda folder, names: [n for n in names if os.path.join(folder, n) in gone or n == "__pycache__"])
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "tree", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
