"""The entry module can be imported before there is a session, and without the training-data subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"


def names(repo: Path) -> set[str]:
    said = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=repo, capture_output=True, text=True, check=True)
    return set(said.stdout.split())


def test_entry_without_session():
    assert "jn_heal_lookup" in names(REPO)


def test_entry_without_training_data_operators(tmp_path):
    shutil.copytree(REPO / "harvestry", tmp_path / "harvestry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    found = names(tmp_path)
    assert "jn_heal_lookup" in found and not any(n.startswith("op") for n in found)


def test_flagship_query(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
