"""The rest of the library imports and registers its queries without the training-data subpackage."""

import os
import re
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_without_the_subpackage(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    shutil.rmtree(copy / "quire" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'lang_guess' in q and not [n for n in q if n.startswith('op') and n[2].isdigit() or n == 'pipeline'], q; assert set(e.oracle_sql()) <= set(q); print(len(q))"
    run = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(copy)})
    assert run.returncode == 0 and int(run.stdout) > 100, run.stderr


def test_nothing_else_imports_it():
    for folder, _, names in os.walk(os.path.join(HERE, "quire")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert not re.search(r"quire\.llm|from quire import llm|from \.+llm", f.read()), name
