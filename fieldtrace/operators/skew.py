"""Joins and aggregations that survive a key holding a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldtrace.runtime import cut

#: Rows of one key that one task may take, whatever the size of the table.
HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, key: str, rows: int = HOT_ROWS) -> DataFrame:
    """(key, __n) of the keys with more than ``rows`` rows.

    Exact: one partial and one final count by key. There are at most
    count / ``rows`` of them; they stay a table. Null keys match nothing and
    are left out.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    return counts.filter(F.col("__n") > rows)


def salt_of(df: DataFrame, salts: Column) -> Column:
    """A salt below ``salts`` for each row: a hash of its columns and of its partition.

    A task that runs again yields the same salts, and equal rows of different
    partitions are spread.
    """
    hashable = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in hashable]), salts).cast("int")


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", rows: int = HOT_ROWS) -> DataFrame:
    """Equi-join of a large, possibly skewed ``left`` with ``right`` on ``key``.

    A key with more than ``rows`` rows on the left is spread over as many tasks
    as it fills; only the matching rows of ``right`` are repeated. ``how`` is
    ``inner``, ``left`` or ``left_semi``; null keys match nothing. A table of
    at most ``rows`` rows has no such key and is joined as it is.
    """
    if left.count() <= rows:
        return left.join(right, key, how)
    hot = cut(hot_keys(left, key, rows).select(key, F.ceil(F.col("__n") / rows).cast("int").alias("__salts")))
    if hot.isEmpty():
        return left.join(right, key, how)
    spread = left.withColumn("__salt0", salt_of(left, F.lit(1 << 20))).join(hot, key, "left")
    spread = spread.withColumn("__salt", F.when(F.col("__salts").isNotNull(), F.pmod("__salt0", "__salts")).otherwise(F.lit(0))).drop("__salt0", "__salts")
    repeated = right.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return spread.join(repeated, [key, "__salt"], how).drop("__salt")


def salted_group(df: DataFrame, key: str, partial: list[Column], final: list[Column], rows: int = HOT_ROWS) -> DataFrame:
    """Aggregate by ``key`` in two levels for hot keys and in one for all others.

    ``partial`` aggregates rows, ``final`` aggregates its results (same names).
    """
    if df.count() <= rows:
        return df.groupBy(key).agg(*partial)
    hot = cut(hot_keys(df, key, rows).select(key, F.ceil(F.col("__n") / rows).cast("int").alias("__salts")))
    if hot.isEmpty():
        return df.groupBy(key).agg(*partial)
    rest = df.join(hot, key, "left_anti").groupBy(key).agg(*partial)
    spread = df.withColumn("__salt0", salt_of(df, F.lit(1 << 20))).join(hot, key)
    first = spread.withColumn("__salt", F.pmod("__salt0", "__salts")).groupBy(key, "__salt").agg(*partial)
    return rest.unionByName(first.drop("__salt").groupBy(key).agg(*final))
