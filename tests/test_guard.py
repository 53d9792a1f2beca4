"""Without the training-data folders the rest still imports."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parent.parent


def test_entry_without_llm(tmp_path):
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    shutil.copytree(REPO / "tidelog", tmp_path / "tidelog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'seat_availability' in q and not [x for x in q if x.startswith('op') and x[2].isdigit()] and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_llm():
    for path in (REPO / "tidelog").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
