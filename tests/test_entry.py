"""The driver's entry, with the training-data subpackage and without."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parent.parent
BLOCKED = "import sys; sys.modules['contactgrid.llm'] = None; "
SHOWN = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), any(x.startswith('op') for x in q))"


def run(code: str) -> list[str]:
    return subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, check=True).stdout.split()


def test_entry_without_the_training_data_operators():
    n, any_op = run(BLOCKED + SHOWN)
    assert int(n) > 50 and any_op == "False"


def test_flagship_runs(spark):
    if not Path("/root/testdata/sf0.001").exists():
        return
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["x", "y", "value"] and df.count() > 0
