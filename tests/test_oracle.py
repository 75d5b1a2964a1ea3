"""Every query of the library proper against its SQL oracle on the smallest scale (DuckDB); the corpus queries have
the same test beside their operators."""
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_queries_match_oracle(spark):
    import check_oracle
    from trialspark.plans import all_queries
    con = check_oracle.duck(SF)
    failures = []
    for name, q in all_queries().items():
        df = q.build(spark, SF)
        rows = [tuple(r) for r in df.collect()]
        if not q.sql:
            continue
        res = con.execute(q.sql)
        cols = [d[0] for d in res.description]
        h1, _ = check_oracle.digest(df.columns, rows)
        h2, _ = check_oracle.digest(cols, res.fetchall())
        if sorted(df.columns) != sorted(cols) or h1 != h2:
            failures.append(name)
    assert not failures, failures


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "mean_value" in df.columns
