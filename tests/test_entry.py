"""The other queries stay where what the training-data package needs is missing."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
for name in sys.argv[1:]:
    sys.modules[name] = None
import __spark_entry__ as e
q = e.queries()
print(sum(n.startswith("q_") for n in q), sum(n.startswith("op") for n in q), "pipeline" in q, set(e.oracle_sql()) <= set(q))
"""


@pytest.mark.parametrize("blocked", ["inkframe.llm", "zstandard", "public_tokenizers", "xxhash"])
def test_a_missing_module_costs_no_other_query(blocked):
    from inkframe.plans import BUILDS

    out = subprocess.run([sys.executable, "-c", CODE, blocked], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == [str(len(BUILDS)), "0", "False", "True"], out.stderr[-500:]
