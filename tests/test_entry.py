"""The driver contract with and without the training-data folders."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*sorted(q))"


def names_in(folder: Path) -> set[str]:
    done = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=folder, capture_output=True, text=True, check=True)
    return set(done.stdout.split())


def test_queries_without_the_training_data_folder(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    left = names_in(copy)
    assert "total_score" in left and "pipeline" not in left
    assert not any(n.startswith("op") and n[2:3].isdigit() for n in left)
    if (ROOT / "meritgrid" / "llm").exists():
        assert left < names_in(ROOT) and "pipeline" in names_in(ROOT)
