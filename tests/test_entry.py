"""The entry offers the core queries whatever the training data libraries are."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
HIDE = """
import sys, warnings
sys.modules[{name!r}] = None
warnings.simplefilter("ignore")
import __spark_entry__ as entry
print(sum(not n.startswith("op") and n != "pipeline" for n in entry.queries()), len(entry.queries()))
"""


@pytest.mark.parametrize("name", ["tiktoken", "sentencepiece", "corpus_pipeline", "rillflow.llm"])
def test_core_queries_need_no_training_data_library(name):
    done = subprocess.run(
        [sys.executable, "-c", HIDE.format(name=name)], cwd=ROOT, capture_output=True, text=True
    )
    assert done.returncode == 0, done.stderr
    core, every = map(int, done.stdout.split())
    assert core == every >= 29
