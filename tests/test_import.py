import pathlib
import subprocess
import sys


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=pathlib.Path(__file__).resolve().parent.parent, check=True, timeout=120)
