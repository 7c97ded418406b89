"""The entry works without the subpackage for training data."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'rerank_topk' in q and set(o) <= set(q) and not [k for k in q if k.startswith('op') or k == 'pipeline'], sorted(q)"


def run(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", CODE], cwd=folder, env=env, capture_output=True, text=True, timeout=120)


def test_without_the_subpackage(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/rankloom", tmp_path / "rankloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    assert (done := run(tmp_path)).returncode == 0, done.stderr
    # a folder that is left empty is no subpackage
    (tmp_path / "rankloom" / "llm" / "__pycache__").mkdir(parents=True)
    assert (done := run(tmp_path)).returncode == 0, done.stderr


def test_nothing_else_imports_it():
    found = []
    for folder, _, names in os.walk(f"{ROOT}/rankloom"):
        if "llm" not in folder.split(os.sep):
            for name in (n for n in names if n.endswith(".py")):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    if "rankloom.llm" in f.read():
                        found.append(name)
    assert found == []
