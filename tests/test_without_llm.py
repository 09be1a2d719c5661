"""The library without the subpackage for training data: it imports, and its queries are there."""

import os
import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; assert not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"


def _env() -> dict[str, str]:
    """The caller's environment, of which the module path leads to installed packages only, not back to this repository."""
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and pathlib.Path(p).resolve() not in (ROOT, ROOT / "src")]
    return os.environ | {"PYTHONPATH": os.pathsep.join(paths)}


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_imports_and_tests_are_found(tmp_path, with_pipeline):
    ignored = shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if with_pipeline else ["corpus_pipeline.py"]))
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=ignored)
    env = _env()
    out = subprocess.run([sys.executable, "-c", CODE], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout) > 30, out.stderr
    out = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stdout


def test_errors_are_not_swallowed(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    (copy / "quarry" / "llm").mkdir()
    (copy / "quarry" / "llm" / "__init__.py").write_text("")
    (copy / "quarry" / "llm" / "queries.py").write_text("import no_such_module_at_all\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, env=_env(), capture_output=True, text=True, timeout=120)
    assert out.returncode != 0 and "no_such_module_at_all" in out.stderr
