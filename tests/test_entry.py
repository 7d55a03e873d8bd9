import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "pause_mad" in df.columns


def test_sql_names_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _entry(tmp_path, code, *gone):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    return copy, lambda: subprocess.run([sys.executable, "-c", code], cwd=copy, timeout=120, capture_output=True, text=True)


ALONE = "import __spark_entry__ as e; q = e.queries(); assert 'pause_profile' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_rest_stands_alone(tmp_path, gone):
    """Without the training-data operators, with or without the pipeline's file, the entry imports and has the other queries."""
    _, run = _entry(tmp_path, ALONE, *gone)
    assert run().returncode == 0


def test_emptied_folder_stands_for_none(tmp_path):
    copy, run = _entry(tmp_path, ALONE, "llm", "corpus_pipeline.py")
    (copy / "parlance" / "llm" / "__pycache__").mkdir(parents=True)
    assert run().returncode == 0


def test_missing_library_leaves_the_rest(tmp_path):
    _, run = _entry(tmp_path, "import sys; sys.modules['zstandard'] = None; " + ALONE)
    assert run().returncode == 0


@pytest.mark.skipif(not (REPO / "parlance" / "llm").exists(), reason="the operators are not there")
def test_error_within_the_package_is_not_swallowed(tmp_path):
    copy, run = _entry(tmp_path, ALONE)
    storage = copy / "parlance" / "llm" / "storage.py"
    storage.write_text(storage.read_text().replace("def new_path", "def renamed_path"))
    found = run()
    assert found.returncode != 0 and "new_path" in found.stderr
