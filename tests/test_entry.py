"""The entry imports, and lists the other queries, where the training-data package is gone."""

import os
import shutil
import subprocess
import sys

import pytest

from conftest import ROOT

LIST = "import __spark_entry__ as e; print('\\n'.join(sorted(e.queries()))); e.oracle_sql()"


@pytest.mark.parametrize("gone", [["gapmend/llm"], ["gapmend/llm", "corpus_pipeline.py"]])
def test_entry_without_the_package(gone, tmp_path):
    from gapmend.catalog import load_catalog
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in gone:
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    shutil.copytree(os.path.join(ROOT, "gapmend"), tmp_path / "gapmend", ignore=lambda d, names: {n for n in names if os.path.relpath(os.path.join(d, n), ROOT) in gone or n == "__pycache__"})
    assert not (tmp_path / "gapmend" / "llm").exists()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    assert got.stdout.split() == sorted(load_catalog()[0])
