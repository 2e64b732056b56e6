from datetime import datetime as T

from pyspark.sql import functions as F

from fieldtrace.operators import bloom, orphans as O

REFS = "table_name string, record_id long, field_name string, ref_id long, at timestamp"
PARENTS = "id long, created_at timestamp, deleted_at timestamp"


def test_reasons_and_nulls(spark):
    parents = spark.createDataFrame([(1, T(2024, 1, 1), None), (2, T(2024, 5, 1), None), (3, T(2024, 1, 1), T(2024, 2, 1))], PARENTS)
    refs = spark.createDataFrame(
        [("t", 10, "f", 1, T(2024, 3, 1)), ("t", 11, "f", 2, T(2024, 3, 1)), ("t", 12, "f", 3, T(2024, 2, 1)), ("t", 13, "f", 99, T(2024, 3, 1)),
         ("t", 13, "f", 99, T(2024, 3, 1)), ("t", 14, "f", None, T(2024, 3, 1)), ("t", 15, "f", 98, None), ("t", 16, "f", 2, None)], REFS)
    got = {tuple(r) for r in O.orphans(refs, parents).collect()}
    assert got == {("t", 11, "f", 2, "late", "2024-03"), ("t", 12, "f", 3, "deleted", "2024-02"), ("t", 13, "f", 99, "missing", "2024-03"), ("t", 15, "f", 98, "missing", None)}


def test_empty_tables(spark):
    refs = spark.createDataFrame([("t", 1, "f", 5, T(2024, 3, 1))], REFS)
    none = spark.createDataFrame([], PARENTS)
    assert [r["reason"] for r in O.orphans(refs, none).collect()] == ["missing"]
    assert O.orphans(spark.createDataFrame([], REFS), none).count() == 0


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(0, 30000, 3)
    held = bloom.build(keys, "id", 10000)
    probe = spark.range(30000).withColumn("m", bloom.might_contain(spark, held, F.col("id")))
    assert probe.filter("id % 3 = 0 and not m").count() == 0
    assert probe.filter("id % 3 <> 0 and m").count() < 2000


def test_spelled_integers_and_paths(spark):
    df = spark.createDataFrame([(" 12 ", "1.2.3"), ("12.0", "7 > 7/8"), ("12.5", ""), ("n/a", None), (None, "x"), ("99999999999999999999", "99999999999999999999.4")], "a string, b string")
    rows = df.select(O.spelled_integer(F.col("a")), O.path_ids(F.col("b"))).collect()
    assert [r[0] for r in rows] == [12, 12, None, None, None, None]
    assert [r[1] for r in rows] == [[1, 2, 3], [7, 8], [], None, [], [4]]


def test_parents_too_many_for_one_filter(spark):
    from fieldtrace.operators import bloom
    from fieldtrace.operators.orphans import orphans

    parents = spark.range(0, 6_000, 2).selectExpr("id", "timestamp'2020-01-01' as created_at", "cast(null as timestamp) as deleted_at")
    refs = spark.range(6_000).selectExpr("'t' as table_name", "id as record_id", "'f' as field_name", "id as ref_id", "timestamp'2024-05-01' as at")
    assert bloom.parts(3_000, 8_192) == 5
    got = {r["record_id"] for r in orphans(refs, parents, max_bits=8_192).collect()}
    assert got == set(range(1, 6_000, 2))
