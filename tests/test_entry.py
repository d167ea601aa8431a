"""The driver's contract, and that the engine stands without its optional part."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_queries_and_oracles():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100 and "em_counts" in o


def test_nothing_else_imports_the_optional_part():
    for f in [*ROOT.glob("tagtally/*.py"), *ROOT.glob("tagtally/[!l]*/*.py")]:
        assert "tagtally.llm" not in f.read_text(), f


def test_stands_without_the_optional_part():
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['tagtally.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1_') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 90 and out[1] == "False"
