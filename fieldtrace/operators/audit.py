"""Structural audit of flat product rows against a taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldtrace.functions import text
from fieldtrace.operators.skew import salted_join
from fieldtrace.operators.taxonomy import leaves


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that occur more than once, with their counts."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).filter("__n > 1")


def flags(products: DataFrame, nodes: DataFrame) -> DataFrame:
    """(listing_id, issues) of every row; an empty list where nothing is wrong.

    ``nodes``: one row per id (id, parent_id, path). Counts of URLs and names
    are aggregated first and joined back with hot values spread, never taken
    over a window of one value.
    """
    leaf = leaves(nodes).select("id", F.lit(True).alias("is_leaf"))
    known = nodes.join(leaf, "id", "left").select(F.col("id").cast("string").alias("label"), F.coalesce("path", F.lit("")).alias("node_path"), F.coalesce("is_leaf", F.lit(False)).alias("is_leaf"))
    name = F.concat_ws("\x1f", F.coalesce("brand", F.lit("\x01")), text.words(F.coalesce("product_name", F.lit(""))))
    rows = products.select("listing_id", F.coalesce("type_id", F.lit("")).alias("label"), F.coalesce("classification_path", F.lit("")).alias("told_path"), "product_name", "short_description", "long_description", F.coalesce("source_url", F.lit("")).alias("url"), name.alias("name_key"))
    told = salted_join(rows, known, "label", "left")
    told = salted_join(told, repeated(rows.filter("url <> ''"), "url").withColumnRenamed("__n", "url_n"), "url", "left")
    told = salted_join(told, repeated(rows, "name_key").withColumnRenamed("__n", "name_n"), "name_key", "left")
    scheme = F.try_parse_url("url", F.lit("PROTOCOL"))
    host = F.try_parse_url("url", F.lit("HOST"))
    # fixed values: the seven issue codes
    label = F.when(F.col("is_leaf").isNull(), "unknown_or_missing_predicted_id").when(~F.col("is_leaf"), "predicted_id_is_not_leaf").when(F.col("told_path") != F.col("node_path"), "predicted_path_mismatch")
    issues = F.array_compact(F.array(
        label,
        F.when(~(_filled("product_name") & (_filled("short_description") | _filled("long_description"))), "missing_name_or_description"),
        F.when(~F.coalesce(F.lower(scheme).isin("http", "https") & host.isNotNull(), F.lit(False)), "invalid_source_url"),
        F.when(F.col("url_n") > 1, "duplicate_source_url"),
        F.when(F.col("name_n") > 1, "duplicate_brand_product_name"),
    ))
    return told.select("listing_id", F.array_sort(issues).alias("issues"))


def issue_counts(flagged: DataFrame) -> DataFrame:
    return flagged.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("records"))


def disagreements(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviewed listings whose proposed type differs from their own."""
    own = products.select("listing_id", F.coalesce("type_id", F.lit("")).alias("original_type_id"))
    proposed = reviews.filter("proposed_type_id is not null").select("review_id", "listing_id", F.col("proposed_type_id").cast("long").cast("string").alias("proposed_type_id"), "rationale").distinct()
    return proposed.join(own, "listing_id").filter("proposed_type_id <> original_type_id").select("review_id", "listing_id", "original_type_id", "proposed_type_id", "rationale")
