"""The entry points, with and without the optional parts."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent


def names(at, path=""):
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(*q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=at, env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout.split()


def test_queries_are_found():
    got = names(REPO)
    assert "topk" in got and len(got) > 100


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
@pytest.mark.parametrize("path", ["", str(REPO)])
def test_the_rest_works_alone(tmp_path, gone, path):
    """Also where the whole repository is further down the path."""
    at = tmp_path / "repo"
    shutil.copytree(REPO, at, ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    got = names(at, path)
    assert "topk" in got and not any(n.startswith("op") and n[2].isdigit() for n in got) and "pipeline" not in got


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["o_orderkey", "o_totalprice"] and df.count() == 20
