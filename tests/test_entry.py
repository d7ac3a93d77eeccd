"""The entry keeps its queries when the training-data part, or a library of it, is missing."""

import json
import os
import subprocess
import sys

import pytest

from .conftest import ROOT


@pytest.mark.parametrize("missing", ["ahocorasick", "edusignal.llm.queries"])
def test_entry_without(missing):
    code = (f"import sys, json; sys.modules[{missing!r}] = None; import __spark_entry__ as e; "
            "from edusignal.plans.registry import REGISTRY; print(json.dumps([sorted(e.queries()) == sorted(REGISTRY), len(REGISTRY)]))")
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, check=True)
    same, n = json.loads(out.stdout.splitlines()[-1])
    assert same and n > 100
