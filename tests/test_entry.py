"""The driver's entry points, with and without the text operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_names():
    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found) and len(found) > 70


def test_flagship(spark):
    row = __spark_entry__.entry(spark).first()
    assert 0 < row["auroc"] < 1 and row["n_anomaly"] > row["n_normal"]


def test_import_without_the_text_operators(tmp_path):
    shutil.copytree(ROOT / "prismlake", tmp_path / "prismlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(n.startswith('op1_') or n == 'pipeline' for n in e.queries()); print('fine')"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert "fine" in said.stdout, said.stderr
