"""bench.py prints exactly one JSON line with the fields the driver records."""
import json
import os
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_bench_prints_one_json_line():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, BENCH_SF_DIR=SF, BENCH_CPUS="2", BENCH_RUNS="1",
               BENCH_QUERIES="within_subject_summary,gap_diff_filter")
    out = subprocess.run([sys.executable, "bench.py"], cwd=root, env=env, capture_output=True, text=True,
                         timeout=600)
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert out.returncode == 0 and len(lines) == 1, out.stderr[-2000:]
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and d["sf"] == "0.001" and isinstance(d["value"], (int, float))
    assert set(d["queries"]) == {"within_subject_summary", "gap_diff_filter"} and "errors" not in d
