"""The entry module and every package module import, and list their queries, without Spark."""
import subprocess
import sys


def test_import_and_listing_need_no_spark():
    code = (
        "import sys, importlib, pkgutil; sys.path.insert(0, '.');"
        "import trialspark;"
        "[importlib.import_module(m.name) for m in pkgutil.walk_packages(trialspark.__path__, 'trialspark.')];"
        "import __spark_entry__ as E; q = E.queries(); s = E.oracle_sql();"
        "from pyspark import SparkContext; assert SparkContext._active_spark_context is None;"
        "assert set(s) <= set(q) and len(q) > 30; print('ok')"
    )
    import os
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and out.stdout.strip().endswith("ok"), out.stderr[-2000:]
