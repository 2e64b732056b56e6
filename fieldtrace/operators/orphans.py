"""References to records that don't exist (or not yet, or no longer)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldtrace.operators import bloom
from fieldtrace.operators.skew import salted_join
from fieldtrace.runtime import cut

#: Blanks at the ends of a text: Unicode white space and the ASCII separators.
_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def spelled_integer(text: Column) -> Column:
    """The integer a text spells, surrounding blanks and a final '.0' aside; else null."""
    bare = F.regexp_replace(text, _ENDS, "")
    return F.when(bare.rlike(r"^[+-]?[0-9]+(\.0)?$"), F.regexp_replace(bare, r"\.0$", "").try_cast("long"))


def path_ids(text: Column) -> Column:
    """The distinct integers in a text, whatever separates them."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)"), 1), lambda x: x.try_cast("long")), lambda x: x.isNotNull()))


def _filtered(refs: DataFrame, keys: DataFrame, max_bits: int) -> DataFrame:
    """``refs`` with ``maybe``: false where a filter of the keys proves a reference missing."""
    spark = refs.sparkSession
    count = keys.count()
    parts = bloom.parts(count, max_bits)
    if parts == 1:
        return cut(refs.withColumn("maybe", bloom.might_contain(spark, bloom.build(keys, "ref_id", count), F.col("ref_id"))))
    split = lambda df: cut(df.withColumn("__part", bloom.part_of(F.col("ref_id"), parts)).repartition(parts, "__part"))
    refs, keys = split(refs), split(keys.select("ref_id"))
    told = []
    for part in range(parts):
        held = bloom.build(keys.filter(F.col("__part") == part), "ref_id", count // parts + 1)
        told.append(cut(refs.filter(F.col("__part") == part).withColumn("maybe", bloom.might_contain(spark, held, F.col("ref_id"))).drop("__part")))
    whole = told[0]
    for more in told[1:]:
        whole = whole.unionByName(more)
    return whole


def orphans(refs: DataFrame, parents: DataFrame, max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """References without a living parent at their time, with the reason.

    ``refs``: (table_name, record_id, field_name, ref_id, at). ``parents``: one
    row per id (id, created_at, deleted_at). A Bloom filter of the parent keys
    proves most missing references; only those it lets pass are verified by an
    exact join. Parents too many for one filter of 8 MB are split by a hash of
    their id, and each part's references meet that part's filter, one filter at
    a time. Reasons in order of precedence: 'missing' (no such id), 'late'
    (created after ``at``), 'deleted' (deleted not after ``at``). A null
    ``ref_id`` refers to nothing; with a null ``at`` only 'missing' can be told
    and the period is null. Repeated references of one record count once.
    """
    keys = parents.select(F.col("id").alias("ref_id"), "created_at", "deleted_at", F.lit(True).alias("known"))
    told = _filtered(refs.filter(F.col("ref_id").isNotNull()).select("table_name", "record_id", "field_name", "ref_id", "at"), keys, max_bits)
    definite = told.filter(~F.col("maybe")).withColumn("reason", F.lit("missing")).drop("maybe")
    verified = salted_join(told.filter("maybe").drop("maybe"), keys, "ref_id", "left")
    reason = (
        F.when(F.col("known").isNull(), "missing")
        .when(F.col("created_at") > F.col("at"), "late")
        .when(F.col("deleted_at") <= F.col("at"), "deleted")
    )
    cols = ["table_name", "record_id", "field_name", "ref_id", "at", "reason"]
    verified = verified.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    found = definite.select(*cols).unionByName(verified.select(*cols))
    return found.select("table_name", "record_id", "field_name", "ref_id", "reason", F.date_format("at", "yyyy-MM").alias("period")).distinct()


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per table, field, reason and month."""
    return found.groupBy("table_name", "field_name", "reason", "period").agg(F.count("*").alias("orphans"), F.countDistinct("ref_id").alias("ref_ids"))
