"""The library without the operators for training data."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def listed(at):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    return set(subprocess.run([sys.executable, "-c", code], cwd=at, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"}).stdout.split())


def test_entry_imports(tmp_path):
    for pipeline in (True, False):
        at = tmp_path / str(pipeline)
        at.mkdir()
        for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and (ROOT / "corpus_pipeline.py").exists() else [])):
            shutil.copy(ROOT / name, at)
        shutil.copytree(ROOT / "lettermill", at / "lettermill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        found = listed(at)
        assert "search_summary" in found and len(found) >= 52 and not any(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in found)


def test_nothing_else_imports_it():
    for path in (ROOT / "lettermill").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text().replace("lettermill", "")
