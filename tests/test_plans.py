"""Plan properties that matter at scale, checked on the physical plan with broadcasts disabled."""
import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_scale_shape_of_plans(spark):
    import __spark_entry__ as E
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        q = E.queries()
        # the word log: two joins' inputs are shuffled once; rank, recall positions and lags reuse it
        p = q["trial_log_lags"](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert p.count("Exchange hashpartitioning") <= 4
        for name in ["pairwise_similarity", "leave_one_frequency_out", "pair_features", "epoch_bins"]:
            p = q[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
        # filters and column pruning reach the Parquet scan
        p = q["list_shift_repair"](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [In(event_type" in p or "In(event_type," in p
        p = q["wrong_length_lists"](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema: struct<l_orderkey:bigint>" in p
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name, scans", [
    ("pair_screen", 8), ("region_coverage", 9), ("quality_report", 6), ("similarity_variance_by_level", 4), ("variance_by_level", 2),
    ("period_bins", 3)])
def test_tables_are_read_a_bounded_number_of_times(spark, name, scans):
    """Every read of a table in the optimised plan, subqueries included."""
    import __spark_entry__ as E
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= scans, plan.count("Relation [")


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name", ["pair_features", "pair_features_isi", "pair_features_end", "isi_model_table", "end_model_table"])
def test_pairs_are_joined_once(spark, name):
    """The centring constants come from list sizes: the position rule, which makes the pairs, stands in one join."""
    import __spark_entry__ as E
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    rules = [line for line in plan.splitlines() if "Join Inner" in line and ("serialpos" in line.split("Join Inner")[1] or "<= 6" in line)]
    filters = [line for line in plan.splitlines() if "Filter" in line and "<= 6" in line]
    assert len(rules) <= 1 and len(filters) <= 1 and rules + filters


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_correlation_is_not_copied_by_a_filter(spark):
    import __spark_entry__ as E
    plan = E.queries()["similarity_variance_by_level"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") <= 3
