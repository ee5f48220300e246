import shutil
import subprocess
import sys
from pathlib import Path

from lumenframe.plans import queries

ROOT = Path(__file__).resolve().parents[1]
LOOK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q)"


def names(folder):
    done = subprocess.run([sys.executable, "-B", "-c", LOOK], cwd=folder, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, check=True)
    return done.stdout.split()


def copied(tmp_path):
    for part in ("lumenframe", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / part).is_dir():
            shutil.copytree(ROOT / part, tmp_path / part, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / part).exists():
            shutil.copy(ROOT / part, tmp_path / part)
    return tmp_path


def test_without_the_text_operators(tmp_path):
    folder = copied(tmp_path)
    shutil.rmtree(folder / "lumenframe/llm", ignore_errors=True)
    (folder / "corpus_pipeline.py").unlink(missing_ok=True)
    assert names(folder) == [str(len(queries.QUERIES)), "0", "False"] and len(queries.QUERIES) >= 44


def test_without_a_library_of_the_text_operators(tmp_path):
    folder = copied(tmp_path)
    if not (folder / "lumenframe/llm").exists():
        return
    (folder / "regex.py").write_text("raise ImportError('no module named regex', name='regex')\n")
    assert names(folder) == [str(len(queries.QUERIES)), "0", "False"]


def test_nothing_else_imports_the_text_operators():
    for path in (ROOT / "lumenframe").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "lumenframe").parts:
            assert "lumenframe.llm" not in path.read_text().replace("``lumenframe.llm``", "")
