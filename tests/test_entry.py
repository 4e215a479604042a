"""The entry imports whatever is left of the optional parts."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("absent", [("llm",), ("llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_imports_without(tmp_path, absent):
    shutil.copytree(
        f"{ROOT}/maskwright", tmp_path / "maskwright", ignore=shutil.ignore_patterns("__pycache__", *absent)
    )
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in absent and os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path / name)
    script = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op1_') for n in q))"
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    count, pipeline, corpus = done.stdout.split()
    assert int(count) > 100 and pipeline == "False"
    assert corpus == str("llm" not in absent and os.path.isdir(f"{ROOT}/maskwright/llm"))
