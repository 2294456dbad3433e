"""The registry in a copy of the repository without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

CHECK = """
import sys
import __spark_entry__ as entry
assert entry.__file__.startswith(sys.argv[1])
assert set(entry.queries()) == set(entry.oracle_sql()) == {*entry.REPORTS, *entry.OPERATORS}
assert len(entry.queries()) >= 41
assert not any(name.startswith(("hirelens.llm", "corpus_pipeline")) for name in sys.modules)
"""


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_registry_without_llm(tmp_path, gone):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = str(tmp_path / "copy")
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    env = {**os.environ, "PYTHONPATH": ""}
    subprocess.run([sys.executable, "-c", CHECK, copy], cwd=copy, env=env, check=True, timeout=120)
