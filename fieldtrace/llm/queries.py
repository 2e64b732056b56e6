"""Registered queries of the training-data problems 2, 3, 4, 7, 8 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldtrace.llm import copies as C
from fieldtrace.llm import encode as E
from fieldtrace.llm import items as I
from fieldtrace.llm import mapping as M
from fieldtrace.llm import packing as P
from fieldtrace.llm import spam as S
from fieldtrace.operators.skew import salted_join
from fieldtrace.runtime import cut, table


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.product_keys(table(spark, sf_dir, "products").select("listing_id", "brand", "product_name", "source_url", "technical_specs"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.collapse(_keyed(spark, sf_dir)).filter("id <> kept_id").select("kept_id", F.col("id").alias("copy_id"))


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record with the number of its copies."""
    return C.records(cut(_keyed(spark, sf_dir))).select("kept_id", "copies")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "products").select("listing_id", "category", "subcategory")
    return M.map_records(rows, "listing_id", ["category", "subcategory"], table(spark, sf_dir, "canonical_categories"))


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "products").select("category", "subcategory")
    return M.unmatched(rows, ["category", "subcategory"], table(spark, sf_dir, "canonical_categories"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.item_pairs(I.same_items(table(spark, sf_dir, "products")))


def p4_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each listing with the id of its item, the item's least listing, and its number of links."""
    items = cut(I.same_items(table(spark, sf_dir, "products")))
    sizes = items.groupBy("item").agg(F.min("listing_id").alias("item_id"), (F.count("*") - 1).alias("links"))
    return salted_join(items, sizes, "item", "inner").select("listing_id", "item_id", "links")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.encode_documents(table(spark, sf_dir, "documents"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = E.token_counts(table(spark, sf_dir, "documents"))
    return P.pack_documents(sizes, table(spark, sf_dir, "token_budgets"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused share of each budget."""
    return P.fill_report(p8_packed(spark, sf_dir), table(spark, sf_dir, "token_budgets"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "url")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spam_pages(_pages(spark, sf_dir))


def p9_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, spam pages and smoothed rate of each host."""
    scored = S.score_pages(_pages(spark, sf_dir)).filter("host is not null")
    return scored.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("score") >= S.THRESHOLD).alias("spam_pages"), F.round(F.max("host_rate"), 6).alias("host_rate"))


QUERIES = {f.__name__: f for f in (p2_found, p2_records, p3_found, p3_unmatched, p4_found, p4_items, p7_ids, p8_packed, p8_report, p9_found, p9_hosts)}

_W = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_COPIES = f"""WITH entries AS (SELECT listing_id, {_W.format('e.key')} || chr(4) || CASE e.type WHEN 'ARRAY' THEN '[' || array_to_string(list_transform(json_extract_string(e.value, '$[*]'), lambda x: {_W.format('x')}), chr(3)) || ']' ELSE {_W.format("json_extract_string(e.value, '$')")} END AS entry
 FROM products, json_each(technical_specs) e),
specs AS (SELECT listing_id, string_agg(entry, chr(5) ORDER BY entry) AS specs FROM entries GROUP BY listing_id),
keyed AS (SELECT p.listing_id, {_W.format('brand')} AS b, {_W.format('product_name')} AS n, {_W.format("regexp_extract(source_url, '^([^?#]*)', 1)")} AS base,
 list_sort(list_filter(list_transform(string_split(regexp_extract(source_url, '^[^?#]*[?]([^#]*)', 1), '&'), lambda q: {_W.format('q')}), lambda q: q <> '')) AS params, {_W.format("regexp_extract(source_url, '#(.*)$', 1)")} AS frag,
 source_url IS NULL AS no_url, CASE WHEN technical_specs IS NOT NULL THEN coalesce(specs, '') END AS specs FROM products p LEFT JOIN specs USING (listing_id)),
kept AS (SELECT listing_id, min(listing_id) OVER w AS kept_id, count(*) OVER w AS copies FROM keyed WINDOW w AS (PARTITION BY b, n, base, params, frag, no_url, specs))"""

SQL: dict[str, str] = {
    "p2_found": _COPIES + " SELECT kept_id, listing_id AS copy_id FROM kept WHERE listing_id <> kept_id",
    "p2_records": _COPIES + " SELECT kept_id, copies FROM kept WHERE listing_id = kept_id",
}
