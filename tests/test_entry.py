"""The driver's entry module with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [(), ("aerolith/llm",), ("aerolith/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_queries_load_without_the_subpackage(tmp_path, gone):
    for name in ("aerolith", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    for name in gone:
        path = tmp_path / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(*q)"
    # what the child finds must come from its own folder, so it gets no path that holds the repository
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() not in (ROOT, ROOT / "src")]
    env = {**os.environ, "PYTHONPATH": os.pathsep.join(paths)}
    names = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert "anomaly_rows" in names
    there = {n: (tmp_path / n).exists() for n in ("aerolith/llm", "corpus_pipeline.py")}
    assert ("pipeline" in names) == all(there.values())
    assert bool([n for n in names if n.startswith("op")]) == there["aerolith/llm"]
