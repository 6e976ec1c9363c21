"""The entry module with and without the training-data subpackage."""

import importlib.util
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(code: str) -> list[str]:
    run = subprocess.run([sys.executable, "-c", code + "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"], cwd=ROOT, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr[-800:]
    return run.stdout.split()


def test_all_queries_are_registered():
    found = names("")
    assert "filter_qual_pass" in found
    if importlib.util.find_spec("locusframe.llm") and (ROOT / "corpus_pipeline.py").exists():
        assert "pipeline" in found and {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in found}


def test_without_the_subpackage():
    block = "import importlib.util as u\nold = u.find_spec\nu.find_spec = lambda n, *a: None if n.startswith(('locusframe.llm', 'corpus_pipeline')) else old(n, *a)\n"
    found = names(block)
    assert "filter_qual_pass" in found and not any(x.startswith("op") or x == "pipeline" for x in found)
