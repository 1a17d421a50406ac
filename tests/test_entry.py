import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_module

ROOT = Path(__file__).resolve().parent.parent


def test_names_match():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_without_corpus_operators(tmp_path):
    """The entry module and the page queries do without the corpus operators."""
    shutil.copytree(ROOT / "pagemill", tmp_path / "pagemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and not any(q.startswith(('op', 'pipeline')) for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
