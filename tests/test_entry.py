"""The registered core queries do without what only other parts need."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

from workload.oracles import ORACLES
from workload.queries import QUERIES

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("missing", ["xxhash", "public_tokenizers", "promptweave.llm", "corpus_pipeline"])
def test_a_missing_module_leaves_the_core(missing):
    code = (
        f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; "
        "print(len(e.queries()), len(e.oracle_sql()))"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    queries, sql = map(int, done.stdout.split())
    assert queries >= len(QUERIES) and sql >= len(ORACLES)
