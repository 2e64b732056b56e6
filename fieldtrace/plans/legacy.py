"""Fixed recipes and reshaping of flat product rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldtrace.functions import text
from fieldtrace.plans.recipe import Field, Locator, Recipe, Scope

_TEXT = ({"op": "strip"}, {"op": "collapse_whitespace"})

# The flat product columns, all strings.
PRODUCT = ["brand", "product_name", "model_article_number", "category", "subcategory", "type_id", "classification_path", "technical_specs", "short_description", "long_description", "product_image_url", "datasheet_url", "source_url"]


def product_page_recipe(source_id: str) -> Recipe:
    """Name, text, first image and datasheet, and the label/value cells of a page."""
    css = lambda s, **kw: Field(Locator("css_text", s), **kw)
    return Recipe(source_id, "html", Scope("one_per_resource"), {
        "/product_name": css("h1", cardinality="many", transforms=_TEXT, required=True), "/short_description": css("p", cardinality="many", transforms=_TEXT),
        "/image": Field(Locator("css_attr", "img[src]", "src"), "many", ({"op": "resolve_url"},)), "/datasheet": Field(Locator("css_attr", "a[href$='.pdf']", "href"), "many", ({"op": "resolve_url"},)),
        "/spec_keys": css("tr > th, dt", cardinality="many", transforms=_TEXT), "/spec_values": css("tr > td, dd", cardinality="many", transforms=_TEXT)}, ("/product_name",))


def spec_map(keys: Column, values: Column) -> Column:
    """Labels to values; the last value of a repeated label counts, labels without a value are left out."""
    pairs = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: p["k"].isNotNull() & p["v"].isNotNull())
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))), lambda p: ~F.exists(F.slice(pairs, p["i"] + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def override(base: Column, own: Column) -> Column:
    """Entries of both maps; where both have a key, ``own`` counts."""
    base, own = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (base, own))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own)


def fan_out(products: DataFrame, variants: str, specs: str) -> DataFrame:
    """One row per variant of a product, its specs over the product's own.

    ``variants`` is an array of maps; products without variants stay one row.
    Adds ``variant_no`` and the order number: the variant's own, else the
    product's model number, else the page's tail.
    """
    rows = products.select("*", F.posexplode_outer(variants).alias("variant_no", "__v"))
    merged = rows.withColumn(specs, override(F.col(specs), F.col("__v")))
    order = F.coalesce(F.try_element_at("__v", F.lit("Order number")), F.nullif("model_article_number", F.lit("")), text.url_tail(F.col("source_url")))
    return merged.withColumn("order_number", order).drop("__v", variants)
