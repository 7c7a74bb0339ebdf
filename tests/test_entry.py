"""The registry imports without a session, and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"


def _say(folder):
    return subprocess.run([sys.executable, "-B", "-c", SAY], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


def test_entry_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "evidentia", tmp_path / "evidentia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    assert _say(tmp_path)[1:] == ["False", "True"]


def test_entry_without_a_session():
    assert int(_say(ROOT)[0]) >= 40
