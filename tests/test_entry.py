"""The driver contract: names, stable schema, and life without the llm subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["o_orderkey", "o_custkey", "o_totalprice"] and rows.count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [("bramble/llm", "tests/llm"), ("bramble/llm", "tests/llm", "corpus_pipeline.py")])
def test_life_without_the_subpackage(tmp_path, gone):
    """Without the two folders, and without the pipeline as well: the entry imports and the other tests are found and pass (the quick ones run here)."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", ".pytest_cache"))
    for name in gone:
        if (copy / name).is_dir():
            shutil.rmtree(copy / name)
        else:
            (copy / name).unlink(missing_ok=True)
    env = {**os.environ, "PYTHONPATH": ""}
    code = "import __spark_entry__ as e; n = e.queries(); assert 'bql_eq' in n and not any(k.startswith('op') or k == 'pipeline' for k in n), n; assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=env)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only", "tests"], cwd=copy, check=True, env=env, stdout=subprocess.DEVNULL)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_access.py"], cwd=copy, check=True, env=env, stdout=subprocess.DEVNULL)
