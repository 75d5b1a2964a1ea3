"""Round trips of the sources and sinks, and the small row and column operators of cleaning."""

import pytest
from pyspark.sql import functions as F

from trialspark.operators import cleaning, features, ordered, quality, stats, summary
from trialspark.sources import tables

INDEX = "subject string, session long, experiment string, system_version double"


@pytest.fixture(scope="module")
def index(spark):
    return spark.createDataFrame([("a", 1, "catFR1", 4.0), ("a", 2, "FR1", None), ("b", 1, "catFR1", 3.1), ("c", 1, "catFR1", None)], INDEX)


def test_session_index_and_events(spark, index, tmp_path):
    """One experiment of a partitioned catalogue, events of chosen subjects."""
    path = str(tmp_path / "index")
    tables.write_table(index, path, partition_by=["experiment"])
    assert tables.read_session_index(spark, path).count() == 4
    cat = tables.read_session_index(spark, path, "catFR1")
    assert {r.subject for r in cat.collect()} == {"a", "b", "c"}
    assert "PartitionFilters: [isnotnull(experiment" in cat._jdf.queryExecution().executedPlan().toString()
    some = tables.read_events(spark, path, "catFR1", subjects=spark.createDataFrame([("b",), ("b",)], "subject string"))
    assert [r.subject for r in some.collect()] == ["b"]


def test_montage_tables_have_their_keys_as_partitions(spark, tmp_path):
    """S3"""
    df = spark.createDataFrame([("a", "FR1", 0, 0, "L1"), ("b", "FR1", 1, 0, "L2")], "subject string, experiment string, montage int, localization int, label string")
    df.write.partitionBy("subject", "experiment", "montage", "localization").parquet(str(tmp_path / "contacts"))
    got = cleaning.read_montage_tables(spark, str(tmp_path), "contacts")
    assert {(r.subject, r.montage, r.label) for r in got.collect()} == {("a", 0, "L1"), ("b", 1, "L2")}


def test_csv_round_trip_keeps_schema_and_nulls(spark, tmp_path):
    """S5-S7"""
    df = spark.createDataFrame([("a", 1, 0.5), (None, None, float("nan"))], "subject string, n long, x double")
    tables.write_table(df, str(tmp_path / "csv"), fmt="csv")
    got = tables.read_csv_table(spark, str(tmp_path / "csv"), df.schema)
    assert got.schema.simpleString() == df.schema.simpleString()
    assert {tuple(r) for r in got.collect()} == {("a", 1, 0.5), (None, None, None)}


def test_power_tables_round_trip_and_replace_one_period(spark, tmp_path):
    """Array and long form, one period rewritten on its own, sessions read as one table."""
    rows = [("FR1", "encoding", "a", 1, [1.0, 2.0, 3.0, 4.0]), ("FR1", "distractor", "a", 1, [5.0, 6.0, 7.0, 8.0])]
    df = spark.createDataFrame(rows, "experiment string, period string, subject string, session long, features array<double>")
    path = str(tmp_path / "power")
    tables.write_power(df, path)
    tables.write_power(df.where("period = 'encoding'").withColumn("features", F.array(F.lit(9.0), F.lit(8.0), F.lit(7.0), F.lit(6.0))), path)
    got = tables.read_power(spark, path, "FR1")
    assert {(r.period, tuple(r.features)) for r in got.collect()} == {("encoding", (9, 8, 7, 6)), ("distractor", (5, 6, 7, 8))}
    long = tables.power_to_long(tables.read_power(spark, path, "FR1", "distractor"), n_freqs=2)
    assert sorted((r.channel, r.frequency_index, r.power) for r in long.collect()) == [(0, 0, 5), (0, 1, 6), (1, 0, 7), (1, 1, 8)]
    assert tables.collect_sessions(spark, path, experiment="FR1", period="distractor").count() == 1
    assert tables.collect_sessions(spark, path, period=None).count() == 0


def test_period_table_has_a_row_for_each_event_type(spark):
    """Overrides of the repeated-list experiment, another time scale, renamed types."""
    rows = {r.period: r for r in tables.period_table(spark, "RepFR1", 100, {"REC_START": "stop"}).collect()}
    assert rows["distractor"].type == "stop" and rows["distractor"].start_ms == -700 and rows["distractor"].bin_ms == 100
    assert (rows["encoding"].keep_lo_ms, rows["encoding"].keep_hi_ms) == (0, 75) and rows["encoding_isi"].keep_lo_ms is None
    assert tables.longest_epoch_ms("catFR1") == 22_000


def test_column_operators(spark):
    """P1, P4, P6-P9"""
    df = spark.createDataFrame([("WORD", "1", None, "f"), ("REC", "x", None, ""), ("WORD", None, None, None)],
                               "type string, n string, empty double, eegfile string")
    assert cleaning.keep_types(df, ["WORD"]).count() == 2
    assert [r.n for r in cleaning.cast_columns(df, {"n": "int", "absent": "int"}).orderBy("type", F.desc("n")).collect()] == [None, 1, None]
    assert cleaning.drop_columns(df, ["n", "absent"]).columns == ["type", "empty", "eegfile"]
    assert cleaning.drop_all_null_columns(df).columns == ["type", "n", "eegfile"]
    assert [r.n for r in cleaning.require_recording(df).collect()] == ["1"]
    from trialspark.functions.nulls import null_to_sentinel
    assert {r.n for r in null_to_sentinel(df, {"n": "NA"}).collect()} == {"1", "x", "NA"}


def test_catalogue_operators(spark, index):
    """P11, P12, J1, J8"""
    fix = spark.createDataFrame([("a", 2, 9.9)], "subject string, session long, system_version double")
    got = {(r.subject, r.session): r.system_version for r in cleaning.override_value(index, fix, ["subject", "session"], "system_version").collect()}
    assert got == {("a", 1): 4.0, ("a", 2): 9.9, ("b", 1): 3.1, ("c", 1): None}
    assert {(r.subject, r.session) for r in cleaning.closed_loop_filter(index).collect()} == {("a", 2), ("b", 1), ("c", 1)}
    allowed = spark.createDataFrame([("a", 1), ("a", 1), ("b", 7)], "subject string, session long")
    assert [(r.subject, r.session) for r in cleaning.keep_allow_list(index, allowed).collect()] == [("a", 1)]
    used = spark.createDataFrame([("b", 1), ("z", 5)], "sub string, ses long")
    got = {(r.sub, r.experiment) for r in cleaning.sessions_used(index, used, ["subject", "session"], ["sub", "ses"]).collect()}
    assert got == {("b", "catFR1"), ("z", None)}


def test_order_is_restored_by_the_saved_order(spark):
    """O1, O3, W14"""
    df = ordered.row_order(spark.createDataFrame([(i * 7 % 20,) for i in range(20)], "t long").repartition(6), ["t"])
    assert [r.t for r in cleaning.restore_order(df.repartition(5), ["row_order"]).collect()] == list(range(20))
    parts = cleaning.restore_order(df.repartition(5), ["row_order"], within_partitions=True).select(F.spark_partition_id().alias("p"), "row_order").collect()
    by = {}
    for r in parts:
        by.setdefault(r.p, []).append(r.row_order)
    assert all(v == sorted(v) for v in by.values()) and len(by) > 1


def test_projection_localization_and_countdowns(spark):
    """F1, J11, Q12, A18"""
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    assert features.project_pairs(df, ["b", "outpos"]).collect()[0].asDict() == {"b": 2, "outpos": None}
    pairs = spark.createDataFrame([("s", 0, "A1-A2"), ("s", 0, "B1-B2")], "subject string, montage long, label string")
    loc = spark.createDataFrame([("s", 0, "A1-A2", "hip")], "subject string, montage long, label string, region string")
    assert {(r.label, r.region) for r in summary.attach_localization(pairs, loc).collect()} == {("A1-A2", "hip"), ("B1-B2", None)}
    ev = spark.createDataFrame([("COUNTDOWN", None), ("WORD", 0), ("WORD", 1), ("REST", 0), ("WORD", None)], "type string, serialpos long")
    assert sorted((r.type, r.serialpos) for r in cleaning.repeated_list_countdowns(ev).where("serialpos is not null").collect()) == [("WORD", 0)]
    assert cleaning.repeated_list_countdowns(ev).count() == 2
    x = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "k string, t long")
    assert {(r.k, r.t) for r in ordered.first_per_key(x, ["k"], ["t"]).collect()} == {("a", 1), ("b", 5)}


def test_factor_and_bars(spark):
    """ST2, ST10: the longer arrow counts, one that is missing does not."""
    df = spark.createDataFrame([(1, 5.0, 3.0, 6.0), (2, 5.0, None, 6.5), (3, 5.0, 4.0, None)], "pos long, est double, lo double, hi double")
    assert dict(stats.as_factor(df, "pos").dtypes)["pos"] == "string"
    assert [r.SE for r in stats.comparison_bars(df, "est", "lo", "hi").orderBy("pos").collect()] == [2.0, 1.5, 1.0]


def test_ordered_distance_constants_match_the_pairs(spark):
    lists = {1: [1, 4, 6], 2: [2], 3: [3, 5, 9, 12]}
    ev = spark.createDataFrame([(k, p) for k, v in lists.items() for p in v], "list long, serialpos long")
    d = [b - a for v in lists.values() for i, a in enumerate(v) for b in v[i + 1:]]
    r = spark.range(1).select(features.ordered_distance_constants(ev, ["list"]).alias("s")).first().s
    assert abs(r.m - sum(d) / len(d)) < 1e-12 and r.mx == max(d)


def test_step_counts_from_flags_equal_counts_of_steps(spark):
    """A19"""
    df = spark.createDataFrame([("a", 1, True, True), ("a", 1, True, False), ("a", 2, False, True), ("b", 1, True, True)],
                               "subject string, session long, p boolean, q boolean")
    steps = [("all", F.lit(True)), ("p", F.col("p")), ("pq", F.col("p") & F.col("q"))]
    key = lambda d: sorted((r.step, r.step_name, r.n_rows, r.n_subjects, r.n_sessions) for r in d.collect())
    assert key(quality.flag_step_counts(df, steps)) == key(quality.step_counts([(n, df.where(c)) for n, c in steps]))
