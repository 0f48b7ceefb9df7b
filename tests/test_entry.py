"""The library without its corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_the_corpus_folders(tmp_path, pipeline):
    """With the pipeline's module left behind, which imports what is gone, and without it."""
    root, copy = Path(__file__).resolve().parent.parent, tmp_path / "copy"
    gone = [] if pipeline else ["corpus_pipeline.py"]
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", *gone))
    for folder in (None, copy / "waymill" / "llm"):
        if folder is not None:
            folder.mkdir()  # an emptied folder counts as none
        code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), any(n.startswith('op') and n[2].isdigit() for n in q), set(s) <= set(q))"
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
        assert int(out[0]) > 80 and int(out[1]) > 80 and out[2:] == ["False", "True"]
