"""The entry without the corpus operators, or without what they need."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Missing())
sys.path.insert(0, {root!r})
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert "aknn_grid_events_k10" in q and not any(n.startswith("op") or n == "pipeline" for n in [*q, *o]), sorted(q)
"""


@pytest.mark.parametrize("name", ["knnloom.llm", "ahocorasick", "sentencepiece", "xxhash"])
def test_entry_without(name):
    done = subprocess.run([sys.executable, "-c", CODE.format(name=name, root=ROOT)], capture_output=True, text=True, timeout=100)
    assert done.returncode == 0, done.stderr
