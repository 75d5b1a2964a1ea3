"""Window operators: semantics and invariance to the input partitioning."""
from pyspark.sql import functions as F

from trialspark.operators import ordered, quality


def _log(spark, parts):
    rows = [("s1", 1, 1, "WORD", "a", 1, 100, 1.0), ("s1", 1, 1, "WORD", "b", 2, 2500, None),
            ("s1", 1, 1, "WORD", "a", 3, 5000, None), ("s1", 1, 1, "REC_WORD", "b", None, 9000, 4.0),
            ("s1", 1, 2, "WORD", None, 1, 12000, 5.0), ("s2", 1, 1, "WORD", "c", 1, 100, None)]
    df = spark.createDataFrame(rows, "subject string, session int, list int, type string, item string, "
                                     "serialpos int, mstime long, v double")
    return df.repartition(parts)


def test_occurrence_backfill_lag_diff(spark):
    for parts in (1, 7):
        df = _log(spark, parts)
        keys = ["subject", "session", "list"]
        x = ordered.occurrence_number(df, [*keys, "type"], ["mstime"], "item")
        x = ordered.backward_fill(x, keys, ["mstime"], "v", "v_bf")
        x = ordered.lag_columns(x, keys, ["mstime"], ["item"])
        x = ordered.diff(x, keys, ["mstime"], "mstime", "gap")
        got = {(r.subject, r.list, r.mstime): r for r in x.collect()}
        assert got[("s1", 1, 5000)].rep_num == 2
        assert got[("s1", 2, 12000)].rep_num is None           # missing item -> NULL (R5)
        assert got[("s1", 1, 2500)].v_bf == 4.0                # next non-null in the list
        assert got[("s2", 1, 100)].v_bf is None                # nothing after it
        assert got[("s1", 1, 2500)].prev_item == "a" and got[("s1", 1, 100)].prev_item is None
        assert got[("s1", 1, 2500)].gap == 2400


def test_quality_checks(spark):
    df = _log(spark, 3)
    words = df.where(F.col("type") == "WORD")
    assert {tuple(r) for r in quality.repeated_presentations(words, ["mstime"]).collect()} == {("s1", 1, 1)}
    wl = quality.wrong_length_lists(words, 3).collect()
    assert {(r.subject, r.list) for r in wl} == {("s1", 2), ("s2", 1)}
    gaps = quality.timing_issue_lists(words, ["mstime"], 2450, 2800).collect()   # gap 2400 < 2450
    assert {(r.subject, r.list) for r in gaps} == {("s1", 1)}
    kept, bad = quality.remove_bad_lists(df, [quality.repeated_presentations(words, ["mstime"])])
    assert kept.count() + df.join(bad, ["subject", "session", "list"], "left_semi").count() == df.count()


def test_countdown_repair(spark):
    rows = [("s", 1, 1, "COUNTDOWN_START", 0), ("s", 1, 1, "COUNTDOWN_END", 10), ("s", 1, 1, "COUNTDOWN_START", 20),
            ("s", 1, 1, "COUNTDOWN_END", 30), ("s", 1, 2, "COUNTDOWN_START", 40), ("s", 1, 2, "COUNTDOWN_END", 50)]
    df = spark.createDataFrame(rows, "subject string, session int, list int, type string, mstime long")
    out = quality.countdown_list_repair(df, ["mstime"], file_col=None)
    got = sorted((r.mstime, r.new_list) for r in out.collect())
    # list 1 holds a second START/END pair: it moves to list 2, and every later list of the
    # session moves up by one; no list is bad (one repeat, in list 1 only)
    assert got == [(0, 1), (10, 1), (20, 2), (30, 2), (40, 3), (50, 3)]
    # a third occurrence, or a repeat past list 1, makes the list bad (its rows are dropped)
    rows3 = rows + [("s", 1, 2, "COUNTDOWN_START", 60), ("s", 1, 2, "COUNTDOWN_END", 70)]
    df3 = spark.createDataFrame(rows3, "subject string, session int, list int, type string, mstime long")
    got3 = sorted((r.mstime, r.new_list) for r in quality.countdown_list_repair(df3, ["mstime"], file_col=None).collect())
    assert got3 == [(0, 1), (10, 1), (20, 2), (30, 2)]


def test_whole_list_duplicates(spark):
    def rows(subject, session, with_recall):
        out = [(subject, session, 1, "WORD", f"w{i}", i, session * 1000 + i) for i in range(1, 4)]
        if with_recall:
            out += [(subject, session, 1, "REC_WORD", "w2", None, session * 1000 + 10)]
        return out
    data = (rows("a", 1, True) + rows("a", 2, False)        # same list twice, recalls once -> Q7 both
            + rows("b", 1, True) + rows("b", 2, True))       # identical data twice -> Q8 later copy
    df = spark.createDataFrame(data, "subject string, session int, list int, type string, item string, "
                                     "serialpos int, mstime long")
    q7, q8 = quality.duplicated_lists(df, ["mstime"], "WORD", "REC_WORD")
    assert {tuple(r) for r in q7.collect()} == {("a", 1, 1), ("a", 2, 1)}
    assert {tuple(r) for r in q8.collect()} == {("b", 2, 1)}


def test_offset_backwards(spark):
    rows = [("s", 1, 1, "WORD", "f", 100, 1), ("s", 1, 1, "WORD", "f", 200, 2), ("s", 1, 2, "WORD", "f", 150, 3),
            ("s", 1, 3, "WORD", "", 10, 4), ("s", 1, 3, "WORD", "g", -1, 5)]
    df = spark.createDataFrame(rows, "subject string, session int, list int, type string, eegfile string, "
                                     "eegoffset long, mstime long")
    got = {tuple(r) for r in quality.offset_backwards_lists(df, ["mstime"]).collect()}
    assert got == {("s", 1, 2)}


def _hot_log(spark, parts):
    """One user holds half of all rows; ties in time, missing values, keys and times."""
    import random
    rng = random.Random(4)
    rows = [(i, "hot" if i % 2 else rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(50_000)]) if i % 40 == 0 else rng.randrange(50_000),
             rng.choice([None, None, None, float(i)]), rng.randrange(40)) for i in range(2000)]
    df = spark.createDataFrame(rows, "event_id long, subject string, mstime long, v double, item long")
    return df.repartition(parts)


def test_two_pass_scans_equal_one_window(spark):
    for width in (10, 5_000, 10 ** 9):
        df = _hot_log(spark, 5)
        order = ["mstime", "event_id"]
        bucket = F.floor(F.col("mstime") / width)
        x = ordered.diff(df, ["subject"], order, "mstime", "d1")
        x = ordered.diff(x, ["subject"], order, "mstime", "d2", bucket=bucket)
        x = ordered.backward_fill(x, ["subject"], order, "v", "f1")
        x = ordered.backward_fill(x, ["subject"], order, "v", "f2", bucket=bucket)
        got = x.collect()
        assert len(got) == 2000 and x.columns == [*df.columns, "d1", "d2", "f1", "f2"]
        assert all(r.d1 == r.d2 and r.f1 == r.f2 for r in got)
        assert any(r.d2 is not None for r in got) and any(r.f2 is not None and r.v is None for r in got)


def test_two_pass_scans_have_no_window_over_a_whole_user(spark):
    df = _hot_log(spark, 5)
    bucket = F.floor(F.col("mstime") / 1000)
    for x in (ordered.diff(df, ["subject"], ["mstime", "event_id"], "mstime", "d", bucket=bucket),
              ordered.backward_fill(df, ["subject"], ["mstime", "event_id"], "v", "f", bucket=bucket)):
        plan = x._jdf.queryExecution().optimizedPlan().toString()
        by_user = [line for line in plan.splitlines() if "Window [" in line and "_bucket" not in line.split("], [")[1]]
        assert len(by_user) == 1 and "_carry" in by_user[0]  # over the carries: a row for each bucket


def test_duplicate_flags_equal_windows(spark):
    df = _hot_log(spark, 5)
    keys, order = ["subject", "mstime"], ["event_id"]
    x = ordered.duplicate_flags(df, keys, order, "a2", "l2")
    x = ordered.mark_later_duplicates(ordered.mark_all_duplicates(x, keys, "a1"), keys, order, "l1")
    got = x.collect()
    assert len(got) == 2000 and all(r.a1 == r.a2 and r.l1 == r.l2 for r in got) and not all(r.a1 for r in got)


def test_row_order_does_not_depend_on_partitions(spark):
    want = None
    for parts in (1, 7, 50):
        out = ordered.row_order(_hot_log(spark, parts), ["subject", "mstime", "event_id"])
        ids = {r.event_id: r.row_order for r in out.collect()}
        assert sorted(ids.values()) == list(range(2000))
        want = want or ids
        assert ids == want
        assert "PythonRDD" not in out._jdf.queryExecution().executedPlan().toString()
    assert ordered.row_order(_hot_log(spark, 2).limit(0), ["event_id"]).collect() == []
