"""Records that are one record written differently, collapsed exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldtrace.operators.skew import HOT_ROWS, salted_group, salted_join
from fieldtrace.runtime import cut

_NULL = "\x01"


def words(text: Column) -> Column:
    """Unbroken runs of letters and digits in order, lower case, one blank between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def url_words(url: Column) -> Column:
    """As ``words``; the parameters of the query are put in order first."""
    whole = F.split(url, "#", 2)
    parts = F.split(whole[0], r"\?", 2)
    query = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    params = F.filter(F.array_sort(F.transform(F.split(query, "&"), words)), lambda p: p != "")
    return F.concat_ws("\x02", words(parts[0]), F.array_join(params, "&"), words(F.coalesce(F.get(whole, F.lit(1)), F.lit(""))))


def entry_words(specs: Column) -> Column:
    """The entries of a JSON object in a fixed order, keys and values as ``words``.

    A list keeps the order of its elements and differs from a string. A text
    that isn't a JSON object is compared by its words, under its own mark.
    """
    parsed = F.try_variant_get(F.try_parse_json(specs), "$", "map<string,variant>")

    def entry(e: Column) -> Column:
        listed = F.try_variant_get(e["value"], "$", "array<string>")
        value = F.when(listed.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(listed, words), "\x03", _NULL), F.lit("]")))
        return F.concat(words(e["key"]), F.lit("\x04"), F.coalesce(value, words(F.try_variant_get(e["value"], "$", "string")), F.lit(_NULL)))

    return F.when(parsed.isNotNull(), F.array_join(F.array_sort(F.transform(F.map_entries(parsed), entry)), "\x05")).otherwise(F.concat(F.lit("text\x06"), words(specs)))


def canonical_key(brand: Column, name: Column, url: Column, specs: Column) -> Column:
    """128-bit key: equal for records that differ only in how they are written."""
    fields = [words(brand), words(name), url_words(url), entry_words(specs)]
    return F.unhex(F.md5(F.concat_ws("\x07", *[F.coalesce(f, F.lit(_NULL)) for f in fields])))


def records(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, kept_id, copies): one row per key of (id, key), with its least id.

    Keys with more than ``hot_rows`` rows are found exactly by partial counts
    and aggregated over salts in two levels; all others need one shuffle. Rows
    with a null id are left out; a null key forms a group like any other;
    repeated rows count as copies; an empty table gives no rows.
    """
    known = rows.filter("id is not null").select("id", F.coalesce("key", F.lit(b"")).alias("key"))
    one = [F.min("id").alias("kept_id"), F.count("*").alias("copies")]
    return salted_group(known, "key", one, [F.min("kept_id").alias("kept_id"), F.sum("copies").alias("copies")], hot_rows)


def collapse(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, kept_id, copies) of the rows (id, key) whose key occurs more than once.

    Only the records with copies are joined back, hot ones spread over tasks.
    """
    rows = cut(rows.select("id", F.coalesce("key", F.lit(b"")).alias("key")).filter("id is not null"))
    several = cut(records(rows, hot_rows).filter("copies > 1"))
    return salted_join(rows, several, "key", "inner", hot_rows).select("id", "kept_id", "copies")


def product_keys(products: DataFrame) -> DataFrame:
    key = canonical_key(F.col("brand"), F.col("product_name"), F.col("source_url"), F.col("technical_specs"))
    return products.select(F.col("listing_id").alias("id"), key.alias("key"))
