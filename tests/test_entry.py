import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_import_needs_no_session_and_no_llm(tmp_path):
    for name in ("rillflow", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    import shutil

    shutil.copytree(ROOT / "rillflow", tmp_path / "rillflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not [k for k in q if k.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_outside_imports_llm():
    for path in (ROOT / "rillflow").rglob("*.py"):
        if "llm" not in path.parts:
            assert "rillflow.llm" not in path.read_text(), path
