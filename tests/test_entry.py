"""The entry module without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _import(folder):
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True)


def _copy(tmp_path, *without):
    skip = shutil.ignore_patterns(".git", "__pycache__", *without)
    return shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)


def test_imports_without_the_subpackage(tmp_path):
    for without in (("llm",), ("llm", "corpus_pipeline.py")):
        shutil.rmtree(tmp_path / "copy", ignore_errors=True)
        out = _import(_copy(tmp_path, *without))
        assert out.returncode == 0, out.stderr
        n, _, pipeline = out.stdout.split()
        assert int(n) > 150 and pipeline == "False"


def test_an_error_inside_is_one(tmp_path):
    """Only absence is passed over: a broken module fails the import."""
    copy = _copy(tmp_path)
    if not (copy / "populace" / "llm").is_dir():
        return
    (copy / "populace" / "llm" / "queries.py").write_text("import no_such_module_at_all\n")
    assert "no_such_module_at_all" in _import(copy).stderr
