import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q), 'gold_daily' in q, any(n.startswith('op') or n == 'pipeline' for n in q))"


def _asked(folder: Path) -> list[str]:
    env = os.environ | {"PYTHONPATH": str(folder), "PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", ASK], cwd=folder, env=env, capture_output=True, text=True, check=True)
    return done.stdout.split()


def _copy(to: Path) -> Path:
    shutil.copytree(ROOT / "weirflow", to / "weirflow", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, to)
    return to


def test_core_queries_stand_without_the_corpus_folder(tmp_path):
    """With the corpus operators gone, corpus_pipeline.py there or not, all other queries are registered."""
    folder = _copy(tmp_path)
    shutil.rmtree(folder / "weirflow" / "llm", ignore_errors=True)
    left = _asked(folder)
    assert left[1:] == ["True", "True", "False"] and int(left[0]) > 70
    (folder / "corpus_pipeline.py").unlink(missing_ok=True)
    assert _asked(folder) == left


def test_core_queries_stand_where_the_corpus_folder_cannot_be_imported(tmp_path):
    """A library that only corpus operators need is missing."""
    folder = _copy(tmp_path)
    (folder / "weirflow" / "llm").mkdir(exist_ok=True)
    (folder / "weirflow" / "llm" / "queries.py").write_text("import a_library_that_is_not_there\n")
    assert _asked(folder)[1:3] == ["True", "True"]
