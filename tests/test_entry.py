import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_imports_without_the_optional_package(tmp_path):
    for name in ("docweave", "jobs", "__spark_entry__.py"):
        src = ROOT / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "docweave" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
