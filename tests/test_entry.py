"""The entry without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'p3_found' in q and 'p8_found' not in q and 'source_units' in q"


@pytest.mark.parametrize("left", ["absent", "empty", "compiled"])
def test_the_rest_is_registered_without_the_subpackage(tmp_path, left):
    shutil.copytree(os.path.join(ROOT, "lattica"), tmp_path / "lattica", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    if left != "absent":
        (tmp_path / "lattica" / "llm").mkdir()
    if left == "compiled":
        (tmp_path / "lattica" / "llm" / "__pycache__").mkdir()
        (tmp_path / "lattica" / "llm" / "__pycache__" / "queries.cpython-313.pyc").write_bytes(b"")
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
