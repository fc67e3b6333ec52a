"""The driver contract holds before any session exists."""

import shutil
import subprocess
import sys
from pathlib import Path


def test_registry_loads_without_a_session():
    code = (
        "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); "
        "assert len(q) > 200 and set(s) <= set(q)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True)


def test_entry_loads_where_the_optional_folders_are_gone(tmp_path):
    root = Path(__file__).parents[1]
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "tidegauge", tmp_path / "tidegauge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = (
        "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); "
        "assert len(q) > 200 and set(s) <= set(q) and not any(n.startswith('op') for n in q) and 'pipeline' not in q"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
