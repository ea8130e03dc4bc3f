"""The entry module with and without the optional package."""

import os
import subprocess
import sys

from linetrawl.plans import catalog

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _names(block: str) -> set[str]:
    code = f"import sys\n{block}\nsys.path.insert(0, {REPO!r})\nimport __spark_entry__ as e\nassert set(e.oracle_sql()) <= set(e.queries())\nprint(*e.queries())"
    return set(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd="/").stdout.split())


def test_a_missing_package_or_library_costs_only_its_own_queries():
    for name in ("linetrawl.llm", "corpus_pipeline", "sentencepiece_of_no_machine"):
        names = _names(f"sys.modules[{name!r}] = None")
        assert set(catalog.QUERIES) <= names
        if not name.startswith("sentence"):
            assert names == set(catalog.QUERIES)
