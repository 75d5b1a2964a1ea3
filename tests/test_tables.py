from pyspark.sql import functions as F

from trialspark.sources import tables


def test_resume_adds_rows_of_an_existing_session(spark, tmp_path):
    """A second run replaces the sessions it holds whole, and leaves the others."""
    path = str(tmp_path / "out")
    one = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "session int, subject string")
    tables.write_table(one, path, partition_by=["session"], mode="overwrite")
    todo = spark.createDataFrame([(1,), (2,), (3,)], "session int")
    done = spark.read.parquet(path).select("session")
    assert [r.session for r in tables.skip_done(todo, done, ["session"]).collect()] == [3]
    two = spark.createDataFrame([(1, "a"), (1, "b"), (1, "d"), (3, "e")], "session int, subject string")
    tables.write_table(two, path, partition_by=["session"], mode="overwrite")
    got = sorted((r.session, r.subject) for r in spark.read.parquet(path).select("session", "subject").collect())
    assert got == [(1, "a"), (1, "b"), (1, "d"), (2, "c"), (3, "e")]


def test_missing_inputs_are_reported(spark):
    want = spark.range(5).withColumnRenamed("id", "k")
    assert sorted(r.k for r in tables.missing_inputs(want, want.where("k < 3"), ["k"]).collect()) == [3, 4]
    assert F is not None
