"""Steps that several later ones read run once (large logs)."""

from pyspark.sql import functions as F

from trialspark.operators import cleaning, ordered


def test_clean_log_does_not_run_its_input_again(spark):
    rows = [(s, 1, li, t, f"w{i}", li * 1000 + i * 100 + (50 if t == "REC" else 0)) for s in range(4) for li in (1, 2)
            for i in range(3) for t in ("WORD", "REC")]
    log = spark.createDataFrame(rows, "subject long, session long, list long, type string, item string, mstime long")
    log = log.withColumn("event_id", F.monotonically_increasing_id()).withColumn("mstime", F.col("mstime") + F.lit(7_654_321))
    out = cleaning.clean_log(log, ["mstime", "event_id"], "WORD", "REC", None, 1, 10_000)
    assert "7654321" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == len(rows)


def test_backward_fill_shuffles_known_rows_without_their_other_columns(spark):
    rows = [(1, t, None if t % 3 else t, "long text") for t in range(30)] + [(None, 1, None, "x"), (2, 5, None, "x"), (2, 400, 9, "x")]
    df = spark.createDataFrame(rows, "k long, t long, v long, note string").repartition(3)
    out = ordered.backward_fill(df, ["k"], ["t"], "v", bucket=F.floor(F.col("t") / 10))
    got = {(r.k, r.t): (r.v, r.note) for r in out.collect()}
    want = {(k, t): (v if v is not None or k is None else min((w for j, u, w, _ in rows if j == k and u > t and w is not None), default=None), n)
            for k, t, v, n in rows}
    assert got == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and out.where("note = 'long text'").count() == 30
