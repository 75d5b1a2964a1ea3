"""What one task holds does not grow with the input."""

import os

import numpy as np
import pytest

from trialspark.operators import spectral
from trialspark.plans import all_queries
from trialspark.sources import roles

SF = "/root/testdata/sf0.001"
NEEDS = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@NEEDS
def test_trial_words_are_dealt_by_the_bytes_of_their_table(spark, monkeypatch):
    size = os.path.getsize(f"{SF}/lineitem.parquet")
    monkeypatch.setattr(roles, "WORD_BYTES", size // 7)
    words = roles.trial_words(spark, SF)
    assert len({r.p for r in words.selectExpr("spark_partition_id() AS p").distinct().collect()}) >= 7


@NEEDS
def test_epochs_are_cut_and_reduced_without_moving_their_rows(spark):
    plan = all_queries()["period_bins"].build(spark, SF)._jdf.queryExecution().executedPlan().toString()
    window = plan.index("Window")
    assert "Exchange" not in plan[:plan.index("Join", window)].replace("BroadcastExchange", "")


def test_power_transforms_a_bounded_number_of_epochs_at_once(spark, monkeypatch):
    seen = []
    whole = spectral.epoch_log_power

    def spy(x, *args):
        seen.append(len(x))
        return whole(x, *args)
    rows = [(i, [0, 5, 9], [1.0, float(i), -1.0], 100.0) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, idx array<int>, v array<double>, rate double")

    class Caught:
        """Hands the batch function out instead of running it in workers."""
    import pandas as pd
    monkeypatch.setattr(spectral, "epoch_log_power", spy)
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, f, schema: setattr(Caught, "f", staticmethod(f)) or df.selectExpr("1D AS power"))
    spectral.epoch_power(df, ["k"], "idx", "v", "rate", 1.0, np.array([5.0]), 0.1, 100.0)
    out = pd.concat(Caught.f([pd.DataFrame(rows, columns=["k", "idx", "v", "rate"])]))
    assert sorted(out.k) == list(range(600)) and max(seen) <= 256
