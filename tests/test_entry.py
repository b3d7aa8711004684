"""The entry module in a process of its own."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def _run(code: str) -> str:
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True, check=True, timeout=120).stdout


def test_read_without_a_session():
    """Names of queries and their SQL are read where no Spark runs."""
    out = _run("import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q))").split()
    assert int(out[0]) > 30 and out[1] == "True"


def test_without_training_data_operators():
    """With a dependency of the training-data operators missing, all others are still there."""
    out = _run("import sys; sys.modules['plumbline.llm'] = None; import __spark_entry__ as e; print('hash_sha256' in e.queries(), 'pipeline' in e.queries(), 'op1_mixing' in e.oracle_sql())")
    assert out.split() == ["True", "False", "False"]
