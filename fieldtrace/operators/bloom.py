"""Bloom filters of a key column, built and probed inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

#: A filter never exceeds this many bits (8 MB); more keys take several filters.
MAX_BITS = 64 * 1024 * 1024
BITS_PER_KEY = 12


def _expr(spark, column: Column):
    return spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.expression(column._jc)


def _column(spark, expression) -> Column:
    return ClassicColumn(spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))


def parts(keys: int, max_bits: int = MAX_BITS) -> int:
    """How many filters ``keys`` keys need, each of them full enough and none too full."""
    return max(1, -(-keys * BITS_PER_KEY // max_bits))


def part_of(key: Column, count: int) -> Column:
    """The part of a key, by a hash of its own."""
    return F.pmod(F.xxhash64(F.lit(17), key), F.lit(count)).cast("int")


def build(df: DataFrame, key: str, keys: int) -> bytes:
    """Filter of all non-null values of ``key``; at most 8 MB reach the driver."""
    spark = df.sparkSession
    bits = min(MAX_BITS, max(1_024, keys * BITS_PER_KEY))
    lit = lambda v: _expr(spark, F.lit(v).cast("long"))
    node = spark._jvm.org.apache.spark.sql.catalyst.expressions.aggregate.BloomFilterAggregate(
        _expr(spark, F.xxhash64(F.col(key))), lit(max(1, min(keys, 4_000_000))), lit(bits))
    row = df.filter(F.col(key).isNotNull()).agg(_column(spark, node.toAggregateExpression()).alias("b")).first()
    return bytes(row["b"]) if row and row["b"] is not None else b""


def might_contain(spark, bloom: bytes, value: Column) -> Column:
    """False proves that ``value`` isn't in the filter; null stays null."""
    if not bloom:
        return F.lit(False)
    node = spark._jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(
        _expr(spark, F.lit(bloom)), _expr(spark, F.xxhash64(value)))
    return _column(spark, node)
