"""The entry module with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"


def names(folder):
    return subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin"}, timeout=120).stdout.split()


def test_without_the_subpackage(tmp_path):
    for pipeline in (False, True):
        copy = tmp_path / str(pipeline)
        copy.mkdir()
        shutil.copy(ROOT / "__spark_entry__.py", copy)
        shutil.copytree(ROOT / "taskweft", copy / "taskweft", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        if pipeline and (ROOT / "corpus_pipeline.py").exists():
            shutil.copy(ROOT / "corpus_pipeline.py", copy)
        n, sql, optional = names(copy)
        assert int(n) > 90 and int(sql) > 90 and optional == "False"


def test_other_import_errors_are_raised(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "taskweft", tmp_path / "taskweft", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module")
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode and "no_such_module" in done.stderr
