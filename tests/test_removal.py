"""The rest of the repository without the removable subpackage and the pipeline."""

import os
import shutil
import subprocess
import sys

from .conftest import ROOT


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/lumagrid", tmp_path / "lumagrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(f"{ROOT}/lumagrid"):
        if not folder.endswith("/llm"):
            assert not any("lumagrid.llm" in open(f"{folder}/{n}").read() or "from ..llm" in open(f"{folder}/{n}").read() for n in names if n.endswith(".py"))
