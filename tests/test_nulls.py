"""Parity rules R1-R18 on literal frames."""
import math

from pyspark.sql import functions as F

from trialspark.functions import nulls


def test_nan_to_null_and_comparisons(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0), (3, None)], "id int, x double")
    out = {r.id: r for r in nulls.clean_nan(df).select(
        "id", "x", nulls.eq_false("x", 3.0).alias("eq"), nulls.ne_true("x", 3.0).alias("ne"),
        nulls.present("x").alias("has")).collect()}
    assert out[1].x is None and out[1].eq is False and out[1].ne is True and out[1].has is False
    assert out[2].eq is True and out[2].ne is False
    assert out[3].eq is False and out[3].ne is True


def test_strip_unicode_whitespace(spark):
    df = spark.createDataFrame([("\t Axe \n",)], "s string")
    assert df.select(nulls.strip_lower("s")).first()[0] == "axe"


def test_safe_div_fisher_and_trailing_int(spark):
    df = spark.createDataFrame([(1.0, 0.0, "A12"), (1.0, 2.0, "LA")], "a double, b double, label string")
    rows = df.select(nulls.safe_div("a", "b").alias("q"), nulls.fisher_z(F.lit(1.0000001)).alias("z"),
                     nulls.trailing_int("label").alias("n")).collect()
    assert rows[0].q is None and rows[1].q == 0.5
    assert math.isinf(rows[0].z)
    assert rows[0].n == 12 and rows[1].n is None


def test_r6_rounds_binary_value_half_away(spark):
    df = spark.createDataFrame([(36.9526205,), (-0.0000001,), (2.5e-7,)], "x double")
    got = [r[0] for r in df.select(nulls.r6("x")).collect()]
    assert got[0] == math.floor(36.9526205 * 1e6 + 0.5) / 1e6      # half away from zero
    assert got[1] == 0.0 and math.copysign(1, got[1]) == 1.0
