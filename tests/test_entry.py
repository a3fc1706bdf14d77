"""The entry module with and without the training-data subpackage, and storage on clusters."""

import shutil
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from brightloom.session import checkpointed

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), sum(n.startswith('op') or n == 'pipeline' for n in q))"


def asked(folder):
    return subprocess.run([sys.executable, "-B", "-c", ASK], cwd=folder, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)})


def copied(folder, *without):
    shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", *without))
    return folder


def test_the_library_stands_alone(tmp_path):
    got = asked(copied(tmp_path / "r", "llm", "corpus_pipeline.py"))
    assert got.returncode == 0, got.stderr
    queries, sql, llm = map(int, got.stdout.split())
    assert queries > 80 and sql > 70 and llm == 0


def test_missing_dependencies_are_not_hidden(tmp_path):
    if not (ROOT / "brightloom" / "llm").exists():
        pytest.skip("the subpackage isn't there")
    folder = copied(tmp_path / "r")
    assert int(asked(folder).stdout.split()[2]) == 14  # thirteen operators and the pipeline
    with open(folder / "brightloom" / "llm" / "__init__.py", "a") as f:
        f.write("\nimport a_module_that_is_missing\n")
    got = asked(folder)
    assert got.returncode != 0 and "a_module_that_is_missing" in got.stderr


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://h:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpointed(SimpleNamespace(sparkSession=session))
