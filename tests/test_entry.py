import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("left", ["nothing", "an empty folder", "compiled files"])
def test_the_rest_imports_without_the_corpus_operators(tmp_path, left):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "quillspark", tmp_path / "quillspark", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    if left != "nothing":
        (tmp_path / "quillspark" / "llm").mkdir()
    if left == "compiled files":
        (tmp_path / "quillspark" / "llm" / "__pycache__").mkdir()
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith(('op', 'pipeline')) for n in q), list(q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)
