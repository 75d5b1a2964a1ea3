import pytest
from corpus_fixture import CLASH, SCHEMA, corpus


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with clashing extra columns."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA).repartition(3)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH]).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
