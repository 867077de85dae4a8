"""The library stands without its optional parts."""

import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_stands_without_the_optional_parts(tmp_path):
    """The whole repository less the two optional folders: with and without the pipeline's file."""
    root = tmp_path / "copy"
    shutil.copytree(ROOT, root, ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__", ".pytest_cache", "spark-warehouse") or (n == "llm" and os.path.basename(d) in ("tessella", "tests"))])
    assert not (root / "tessella" / "llm").exists() and not (root / "tests" / "llm").exists()
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    env = {**os.environ, "PYTHONPATH": str(root)}
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, env=env)
    if (root / "corpus_pipeline.py").exists():
        (root / "corpus_pipeline.py").unlink()
        subprocess.run([sys.executable, "-c", code], cwd=root, check=True, env=env)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests/test_sources.py"], cwd=root, check=True, env=env)


def test_nothing_else_imports_the_optional_parts():
    for folder, _, names in os.walk(os.path.join(ROOT, "tessella")):
        for name in names:
            if name.endswith(".py") and os.path.basename(folder) != "llm":
                with open(os.path.join(folder, name)) as f:
                    assert not re.search(r"^\s*(from|import) .*\bllm\b", f.read(), re.M), name
