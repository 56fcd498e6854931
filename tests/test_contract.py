import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and "status" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_works_without_the_subpackage():
    code = "import sys; sys.modules['tessera.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[-2]) >= 90 and int(out[-1]) >= 80


def test_nothing_outside_imports_the_subpackage():
    for path in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"tessera\.llm|from \.*llm|import llm", path.read_text()), path
