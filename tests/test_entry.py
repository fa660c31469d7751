"""The entry with and without the corpus operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def listed(folder):
    import json

    run = subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(folder)})
    assert run.returncode == 0, run.stderr
    return json.loads(run.stdout.splitlines()[-1])


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_the_corpus_folders(tmp_path, with_pipeline):
    target = tmp_path / "copy"
    drop = ["llm", "tests", ".git", "__pycache__", *([] if with_pipeline else ["corpus_pipeline.py"])]
    shutil.copytree(ROOT, target, ignore=shutil.ignore_patterns(*drop))
    queries, sql = listed(target)
    whole_queries, whole_sql = listed(ROOT)
    gone = set(whole_queries) - set(queries)
    assert all(name == "pipeline" or name.startswith("op") for name in gone)
    assert not [name for name in queries if name == "pipeline" or name.startswith("op")]
    assert set(sql) <= set(queries) and set(whole_sql) <= set(whole_queries)
