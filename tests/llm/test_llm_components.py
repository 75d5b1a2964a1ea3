import random

from corpus_fixture import classes

from trialspark.llm.components import connected_components


def check(spark, links, **more):
    df = spark.createDataFrame(links, "u long, v long").repartition(5)
    got = {r.node: r.component for r in connected_components(df, **more).collect()}
    want = {k: v for k, v in classes({x for p in links for x in p}, links).items() if k != v}
    assert got == want


def test_components_match_union_find_in_every_form(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1040)]
    links += [(5000 + i, 5000) for i in range(200)] + [(7, 7)]
    check(spark, links)
    check(spark, links, native=True)
    check(spark, links, per_task=50)  # several tasks and rounds


def test_no_links(spark):
    df = spark.createDataFrame([], "u long, v long")
    assert connected_components(df).collect() == [] and connected_components(df, native=True).collect() == []


def test_a_table_with_long_arrays_is_not_broadcast_by_its_row_count(spark, monkeypatch):
    from pyspark.sql import functions as F

    from trialspark.llm import staging
    few = spark.range(4).select("id", F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.xxhash64("id", i)).alias("v"))
    staged = staging.stage(few, "arrays")
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(staging.small_or_plain(staged, 64))
    monkeypatch.setattr(staging, "BROADCAST_BYTES", 2_000_000)  # 640,000 bytes written, five million allowed for
    assert not hinted(staging.small_or_plain(staged, 64))
