"""The library without the training-data operators: everything else works."""

import os
import shutil
import subprocess
import sys

from fixture_paths import ROOT, SF0001

RUN = """
import __spark_entry__ as e
from tempora.session import get_spark
q = e.queries()
assert not [n for n in [*q, *e.oracle_sql()] if n.startswith("op") or n == "pipeline"], sorted(q)
assert q["gap_report"](get_spark("local[2]", 2, shuffle_partitions=2), SF) .count() > 0
print("fine")
"""


def _copy(tmp_path, *dropped):
    away = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *dropped)
    return shutil.copytree(ROOT, tmp_path / "repo", ignore=away)


def _run(folder, code):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=300)


def test_rest_runs_without_the_folders_and_the_pipeline(tmp_path):
    out = _run(_copy(tmp_path, "llm", "corpus_pipeline.py"), f"SF = {SF0001!r}\n{RUN}")
    assert out.stdout.strip().endswith("fine"), out.stderr[-2000:]


def test_pipeline_file_alone_is_left_out(tmp_path):
    out = _run(_copy(tmp_path, "llm"), "import __spark_entry__ as e; print('pipeline' in e.queries())")
    assert out.stdout.strip().endswith("False"), out.stderr[-2000:]


def test_a_broken_pipeline_is_an_error(tmp_path):
    folder = _copy(tmp_path)
    (folder / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    if not (folder / "tempora" / "llm").exists():
        return
    assert _run(folder, "import __spark_entry__").returncode != 0
