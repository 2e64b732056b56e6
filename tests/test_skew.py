from pyspark.sql import functions as F

from fieldtrace.operators.skew import hot_keys, salted_group, salted_join


def _skewed(spark):
    """2,000 rows of one key, 40 keys just below the bound, the rest alone; some keys are null."""
    return spark.range(8_000).select(
        "id", F.when(F.col("id") < 2_000, F.lit(-1)).when(F.col("id") < 5_960, F.col("id") % 40).when(F.col("id") < 7_990, F.col("id")).cast("long").alias("k"))


def test_hot_keys_are_absolute(spark):
    left = _skewed(spark)
    assert {(r["k"], r["__n"]) for r in hot_keys(left, "k", rows=100).collect()} == {(-1, 2_000)}


def test_salted_join_equals_plain_join_and_bounds_tasks(spark):
    left = _skewed(spark).repartition(16)
    right = spark.createDataFrame([(-1, "hot"), (-1, "twice"), (3, "cold"), (7_000, "one")], "k long, v string")
    for how in ("left", "inner"):
        got = salted_join(left, right, "k", how, rows=100)
        assert sorted(map(str, got.select("id", "k", "v").collect())) == sorted(map(str, left.join(right, "k", how).select("id", "k", "v").collect()))
    semi = salted_join(left, right, "k", "left_semi", rows=100)
    assert semi.count() == left.join(right, "k", "left_semi").count()


def test_equal_rows_are_spread(spark):
    from fieldtrace.operators.skew import salt_of

    rows = spark.range(4_000).select(F.lit(1).alias("k")).repartition(40)
    most = rows.select(salt_of(rows, F.lit(20)).alias("s")).groupBy("s").count().agg(F.max("count")).first()[0]
    assert most < 1_000


def test_salted_group_equals_plain_group(spark):
    left = _skewed(spark)
    part = [F.min("id").alias("low"), F.count("*").alias("n")]
    got = salted_group(left.filter("k is not null"), "k", part, [F.min("low").alias("low"), F.sum("n").alias("n")], rows=100)
    want = left.filter("k is not null").groupBy("k").agg(*part)
    assert sorted(map(tuple, got.select("k", "low", "n").collect())) == sorted(map(tuple, want.collect()))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, k long")
    assert salted_join(none, none.select("k"), "k", rows=0).count() == 0
    assert hot_keys(none, "k", rows=0).count() == 0
