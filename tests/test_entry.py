"""The entry module with and without the text-preparation folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


def test_entry_imports_without_the_text_folders(tmp_path):
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache", ".hypothesis")
    shutil.copytree(ROOT, tmp_path / "r", ignore=skip)
    out = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path / "r", capture_output=True, text=True,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0, out.stderr
    from oracle.sql import SQL
    from shopflow.plans.registry import QUERIES
    assert out.stdout.split() == [str(len(QUERIES)), str(len(SQL))]


def test_nothing_else_imports_the_text_operators():
    for folder in ("shopflow", "oracle", "tests"):
        for d, _, names in os.walk(f"{ROOT}/{folder}"):
            for name in names:
                if name.endswith(".py") and "llm" not in d.split(os.sep):
                    text = open(f"{d}/{name}").read()
                    assert "import shopflow." + "llm" not in text and "from shopflow." + "llm" not in text, name
