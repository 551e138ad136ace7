import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "bm25_topk" in entry.queries()


def test_imports_without_the_subpackage(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "titleforge", tmp_path / "titleforge", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 30 and out[1] == "0"
