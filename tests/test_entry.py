"""The entry points with and without the training-data subpackage."""

import pathlib
import shutil
import subprocess
import sys

REPO = pathlib.Path(__file__).parent.parent


def run(folder, code):
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_rest_stands_without_the_subpackage(tmp_path):
    code = "import __spark_entry__ as e; print(*sorted(e.queries()))"
    whole = run(REPO, code)
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    for gone in ((), ("corpus_pipeline.py",)):  # the folders alone, then the pipeline too
        for name in gone:
            (copy / name).unlink(missing_ok=True)
        left = run(copy, code)
        assert set(whole) - set(left) == {n for n in whole if n == "pipeline" or n.startswith("op") and n[2].isdigit()} if (REPO / "adjudica/llm").exists() else whole == left
        assert run(copy, "import __spark_entry__ as e; print(*sorted(set(e.oracle_sql()) - set(e.queries())))") == []
