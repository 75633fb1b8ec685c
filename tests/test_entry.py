"""The driver's contract, with and without the optional parts."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_sql_only_for_known_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_import_without_optional_parts(tmp_path):
    for p in ROOT.rglob("*.py"):
        part = p.relative_to(ROOT)
        if "llm" not in part.parts and part.name != "corpus_pipeline.py" and part.parts[0] != "tests":
            (tmp_path / part).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / part).write_bytes(p.read_bytes())
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(k.startswith('op') for k in q), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, check=False)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[-3:-1] == ["False", "False"] and int(out.stdout.split()[-4]) > 60
