"""The driver's contract without the training-data subpackage, its tests and the pipeline."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

from lodestar import catalog

ROOT = Path(__file__).resolve().parent.parent


def names(at, hidden=""):
    code = f"import sys; sys.modules.update(dict.fromkeys('{hidden}'.split())); import __spark_entry__ as e; print(*e.queries(), '|', *e.oracle_sql())"
    said = subprocess.run([sys.executable, "-c", code], cwd=at, capture_output=True, text=True, check=True).stdout
    return [x.split() for x in said.split("|")]


def test_entry_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "lodestar", tmp_path / "lodestar", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    queries, oracles = names(tmp_path)
    assert sorted(queries) == sorted(oracles) == sorted(catalog.queries())


def test_entry_without_a_package_that_they_need():
    queries, _ = names(ROOT, "ahocorasick")
    assert sorted(queries) == sorted(catalog.queries())


def test_nothing_else_imports_them():
    for f in (ROOT / "lodestar").rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"\bllm\b", f.read_text()), f
