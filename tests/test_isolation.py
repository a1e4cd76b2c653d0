"""The library without the training-data folders."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parents[1]


def copy(to: Path, *gone: str) -> Path:
    shutil.copytree(HERE, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.pyc", ".pytest_cache", ".hypothesis"))
    for x in gone:
        p = to / x
        shutil.rmtree(p) if p.is_dir() else p.unlink(missing_ok=True)
    return to


def names(at: Path) -> set[str]:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"], cwd=at, env=env, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    return set(run.stdout.split())


def test_core_stands_alone(tmp_path):
    core = names(copy(tmp_path / "a", "quillon/llm", "tests/llm", "corpus_pipeline.py"))
    assert core == names(copy(tmp_path / "b", "quillon/llm", "tests/llm"))  # the pipeline module may be left behind
    assert "topk" in core and not any(n.startswith("op") for n in core) and "pipeline" not in core


def test_a_broken_operator_is_not_hidden(tmp_path):
    if not (HERE / "quillon" / "llm").exists():
        return
    at = copy(tmp_path / "c")
    (at / "quillon" / "llm" / "pii.py").write_text("import a_module_that_is_not_there\n")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=at, capture_output=True, text=True)
    assert run.returncode != 0 and "a_module_that_is_not_there" in run.stderr


def test_nothing_else_imports_them():
    for p in (HERE / "quillon").rglob("*.py"):
        if "llm" not in p.parts:
            assert "quillon.llm" not in p.read_text() and "from .llm" not in p.read_text()
