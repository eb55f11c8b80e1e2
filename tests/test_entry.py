import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_queries_and_sql_agree_on_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_everything_else_works_without_the_training_data_operators(tmp_path):
    """The entry point copied without them still lists the other queries."""
    for name in ("__spark_entry__.py",):
        (tmp_path / name).write_text((ROOT / name).read_text())
    package = tmp_path / "scriptorium"
    for path in (ROOT / "scriptorium").rglob("*.py"):
        part = path.relative_to(ROOT / "scriptorium")
        if part.parts[0] != "llm":
            (package / part).parent.mkdir(parents=True, exist_ok=True)
            (package / part).write_text(path.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and not any(n.startswith('op') for n in q), q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_them():
    for path in (ROOT / "scriptorium").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "scriptorium").parts:
            assert "scriptorium.llm" not in path.read_text()
