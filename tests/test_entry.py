"""The entry module: it imports without a session, and its queries and SQL agree in names."""

import subprocess
import sys

import __spark_entry__


def test_imports_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__spark_entry__.ROOT, check=True)
    assert int(out.stdout) > 40


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0
