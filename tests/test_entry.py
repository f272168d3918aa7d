"""The entry file stands with and without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from verification import QUERIES

REPO = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("dropped", [["barfold/llm", "tests/llm"], ["barfold/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_optional_parts(tmp_path, dropped):
    leave = {str(REPO / d) for d in dropped}

    def ignored(folder, names):
        return [n for n in names if f"{folder}/{n}" in leave or n in (".git", "__pycache__", ".pytest_cache")]

    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=ignored)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    number, pipeline, known = done.stdout.split()
    assert int(number) >= len(QUERIES) and pipeline == "False" and known == "True"
    if "barfold/llm" in dropped:
        assert int(number) == len(QUERIES)
