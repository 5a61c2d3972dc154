"""The reports are there whatever the training-data operators lack."""

import subprocess
import sys
from pathlib import Path

import pytest

from stockaudit.plans import registry

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("blocked", ["zstandard", "xxhash", "sentencepiece", "public_tokenizers", "corpus_pipeline", "stockaudit.llm"])
def test_reports_without_a_package(blocked):
    code = f"import sys; sys.modules[{blocked!r}] = None; import __spark_entry__ as d; print(len(d.queries()), len(d.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    counts = list(map(int, done.stdout.split()))
    assert len(counts) == 2 and min(counts) >= len(registry.REPORTS), done.stderr
