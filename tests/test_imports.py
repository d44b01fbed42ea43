"""The library without its training-data part."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_training_data_part():
    for path in (ROOT / "strataframe").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"import.*\bllm\b|strataframe\.llm", path.read_text()), path


def copy_without(tmp_path: Path) -> Path:
    """The repository without the training-data part, its tests and the pipeline."""
    for name in ("__spark_entry__.py", "bench.py"):
        (tmp_path / name).symlink_to(ROOT / name)
    for folder in ("strataframe", "tests"):
        (tmp_path / folder).mkdir()
        for path in (ROOT / folder).iterdir():
            if path.name not in ("llm", "__pycache__"):
                (tmp_path / folder / path.name).symlink_to(path)
    return tmp_path


def run(code: list[str], at: Path) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-B", *code], cwd=at, capture_output=True, text=True, timeout=300)


def test_entry_without_it(tmp_path):
    at = copy_without(tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and not [n for n in q if n.startswith('op')] and 'pipeline' not in q; assert set(e.oracle_sql()) == set(q)"
    done = run(["-c", f"import sys; sys.path.insert(0, {str(at)!r}); {code}"], at)
    assert done.returncode == 0, done.stderr


def test_other_tests_run_without_it(tmp_path, sf_dir):
    at = copy_without(tmp_path)
    done = run(["-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests/test_queries.py", "-k", "match_prf1 or bootstrap_ci or test_entry"], at)
    assert done.returncode == 0 and "3 passed" in done.stdout, done.stdout[-2000:]


def test_entry_tells_other_import_errors(tmp_path):
    """Only the absence of the part itself is passed over; a missing module that it needs is told."""
    at = copy_without(tmp_path)
    (at / "strataframe" / "llm").mkdir()
    (at / "strataframe" / "llm" / "__init__.py").write_text("")
    (at / "strataframe" / "llm" / "queries.py").write_text("import a_module_that_is_not_there\n")
    done = run(["-c", f"import sys; sys.path.insert(0, {str(at)!r}); import __spark_entry__ as e; e.queries()"], at)
    assert done.returncode != 0 and "a_module_that_is_not_there" in done.stderr
