"""The entry works without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_optional_parts(tmp_path):
    shutil.copytree(f"{ROOT}/quarry", f"{tmp_path}/quarry", ignore=lambda d, names: {"llm", "__pycache__"} & set(names))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and set(e.oracle_sql()) <= set(e.queries()); print('fine')"
    got = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True,
                         env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert got.stdout.strip().endswith("fine"), got.stderr
