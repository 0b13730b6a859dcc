import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_flagship_has_rows(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_every_sql_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_optional_subpackage():
    for path in (ROOT / "quillon").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "quillon.llm" not in path.read_text(), path


def test_entry_works_without_the_optional_subpackage(tmp_path):
    """A copy without those files still imports and registers the engine's own queries."""
    code = (
        "import sys, importlib.util as u\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('quillon.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name='quillon.llm' if 'llm' in name else name)\n"
        f"sys.meta_path.insert(0, Gone()); sys.path.insert(0, {str(ROOT)!r})\n"
        "import __spark_entry__ as e\n"
        "q = e.queries(); assert 'ret_04_bm25' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
