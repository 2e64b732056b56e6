"""Queries of locators, scopes, transforms, extraction, merge, diff and replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldtrace.functions import canon, paths, text, transforms as X
from fieldtrace.plans import extract as E
from fieldtrace.plans.legacy import fan_out
from fieldtrace.plans.recipe import Field, Locator, Recipe, Scope
from fieldtrace.queries.registry import Registry
from fieldtrace.runtime import beside, cut, spread, table

query = Registry()
SPEC_KEY = "Country of manufacture"


def _pointer(p: str, **kw) -> Field:
    return Field(Locator("json_pointer", p), **kw)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def pointer_props(spark: SparkSession, d: str) -> DataFrame:
    props = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.try_variant_get(paths.pointer_get(props, "/k"), "$", "bigint").alias("k"))


@query(f"""SELECT listing_id, json_extract_string(technical_specs, '$."{SPEC_KEY}"') AS country, json_exists(technical_specs, '$."{SPEC_KEY}"') AS told
FROM products WHERE technical_specs IS NOT NULL""")
def pointer_specs(spark: SparkSession, d: str) -> DataFrame:
    """A key with blanks; absent and present are told apart."""
    v = paths.pointer_get(F.try_parse_json("technical_specs"), f"/{SPEC_KEY}")
    rows = table(spark, d, "products").filter("technical_specs is not null")
    return rows.select("listing_id", F.try_variant_get(v, "$", "string").alias("country"), v.isNotNull().alias("told"))


def _order_pages(spark: SparkSession, d: str) -> DataFrame:
    """Orders as JSON documents with their lines as an array."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("int").alias("qty"), F.col("l_suppkey").alias("supplier")).alias("item"))
    items = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("item")).alias("items"))  # a few lines per order
    return items.select(F.concat(F.lit("https://orders.example/"), F.col("l_orderkey")).alias("url"), F.col("l_orderkey").alias("ord"), F.to_json(F.struct(F.col("l_orderkey").alias("order"), "items")).alias("body"))


_ITEMS = "(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS INT), l_suppkey) - 1 AS idx FROM lineitem)"


@query(f"SELECT l_orderkey AS ord, CAST(idx AS INT) AS idx, l_partkey AS part FROM {_ITEMS}")
def items_path_unnest(spark: SparkSession, d: str) -> DataFrame:
    found = paths.json_path(F.try_parse_json("body"), "$.items[*].part")
    rows = _order_pages(spark, d).select("ord", F.posexplode(found).alias("idx", "v"))
    return rows.select("ord", "idx", F.try_variant_get("v", "$", "bigint").alias("part"))


@query(f"SELECT l_orderkey AS ord, l_partkey AS first_part FROM {_ITEMS} WHERE idx = 0")
def json_path_index(spark: SparkSession, d: str) -> DataFrame:
    found = paths.json_path(F.try_parse_json("body"), "$.items[0].part")
    return _order_pages(spark, d).select("ord", F.explode(found).alias("v")).select("ord", F.try_variant_get("v", "$", "bigint").alias("first_part"))


@query("SELECT count(*) AS pages, count_if(n > 5) AS over_limit, CAST(0 AS BIGINT) AS empty FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def scope_guard(spark: SparkSession, d: str) -> DataFrame:
    """Pages without roots, and with more than the recipe allows."""
    n = F.size(paths.json_path(F.try_parse_json("body"), "$.items[*]"))
    return _order_pages(spark, d).agg(F.count("*").alias("pages"), F.count_if(n > 5).alias("over_limit"), F.count_if(n == 0).alias("empty"))


@query("""SELECT o_orderkey, '{"customer":{"id":' || o_custkey || '},"status":"' || o_orderstatus || '"}' AS doc FROM orders""")
def pointer_set(spark: SparkSession, d: str) -> DataFrame:
    doc = paths.set_pointers({"/customer/id": F.col("o_custkey"), "/status": F.col("o_orderstatus")})
    return table(spark, d, "orders").select("o_orderkey", F.to_json(doc).alias("doc"))


def _text_query(column_expr, spark, d, source="products", key="listing_id"):
    return table(spark, d, source).select(key, column_expr)


@query(r"""SELECT listing_id, regexp_replace(category, '^[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g') AS stripped FROM products""")
def transform_strip(spark: SparkSession, d: str) -> DataFrame:
    return _text_query(text.strip(F.col("category")).alias("stripped"), spark, d)


_BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(f"SELECT listing_id, regexp_replace(regexp_replace(product_name, '^{_BLANK}+|{_BLANK}+$', '', 'g'), '{_BLANK}+', ' ', 'g') AS collapsed FROM products")
def transform_collapse(spark: SparkSession, d: str) -> DataFrame:
    return _text_query(text.collapse(F.col("product_name")).alias("collapsed"), spark, d)


@query("SELECT doc_id, nfc_normalize(title) AS title FROM documents")
def transform_nfc(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.nfc(F.col("title")).alias("title"))


@query("SELECT doc_id, sha256(nfc_normalize(regexp_replace(text, '\\r\\n?', chr(10), 'g'))) AS digest FROM documents WHERE text IS NOT NULL")
def normalize_capture(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter("text is not null")
    return rows.select("doc_id", canon.text_digest(text.nfc(text.line_ends(F.col("text")))).alias("digest"))


@query("SELECT p_partkey, p_brand || ' / ' || p_type || ' / ' || p_name AS joined FROM part")
def transform_join(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part").withColumn("v", F.transform(F.array("p_brand", "p_type", "p_name"), lambda x: x.cast("variant")))
    return X.run(df, F.col("v"), [{"op": "join", "separator": " / "}], "s").select("p_partkey", F.try_variant_get(F.get("s.v", F.lit(0)), "$", "string").alias("joined"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct([p_brand, p_type, p_name, p_brand])), '|') AS ordered FROM part")
def transform_sort_unique(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part").withColumn("v", F.transform(F.array("p_brand", "p_type", "p_name", "p_brand"), lambda x: x.cast("variant")))
    df = X.run(df, F.col("v"), [{"op": "unique"}, {"op": "join", "separator": "|"}], "s")
    return df.select("p_partkey", F.try_variant_get(F.get("s.v", F.lit(0)), "$", "string").alias("ordered"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def transform_enum_map(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").withColumn("v", F.array(F.col("o_orderstatus").cast("variant")))
    df = X.run(df, F.col("v"), [{"op": "enum_map", "mapping": {"F": "finished", "O": "open"}, "unknown": "keep"}], "s")
    return df.select("o_orderkey", F.try_variant_get(F.get("s.v", F.lit(0)), "$", "string").alias("status"))


@query("SELECT c_custkey, CASE WHEN regexp_matches(c_name, '#(\\d+)[02468]$') THEN regexp_extract(c_name, '#(\\d+)[02468]$', 1) END AS number, CASE WHEN NOT regexp_matches(c_name, '#(\\d+)[02468]$') THEN 'TRANSFORM_PARSE' END AS error FROM customer")
def transform_regex_capture(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer").withColumn("v", F.array(F.col("c_name").cast("variant")))
    df = X.run(df, F.col("v"), [{"op": "regex_capture", "pattern": r"#(\d+)[02468]$"}], "s")
    return df.select("c_custkey", F.when(F.col("s.e").isNull(), F.try_variant_get(F.get("s.v", F.lit(0)), "$", "string")).alias("number"), F.col("s.e").alias("error"))


@query("SELECT c_custkey, round(c_acctbal, 2) AS balance FROM customer")
def transform_parse_decimal(spark: SparkSession, d: str) -> DataFrame:
    """Amounts written with dots for thousands and a decimal comma."""
    written = F.translate(F.format_number("c_acctbal", 2), ",.", ".,")
    return table(spark, d, "customer").select("c_custkey", F.round(X.parse_decimal(written, ",", "."), 2).alias("balance"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS ordered_at FROM orders")
def transform_parse_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", X.parse_date(F.date_format("o_orderdate", "d.M.yyyy"), "%d.%m.%Y").alias("ordered_at"))


@query("SELECT kind, count(*) AS n FROM (SELECT CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'TRANSFORM_TYPE' ELSE 'ok' END AS kind FROM events) GROUP BY kind")
def type_guard(spark: SparkSession, d: str) -> DataFrame:
    """A text transform on numbers is refused, not coerced."""
    df = table(spark, d, "events").withColumn("v", F.array(paths.pointer_get(F.try_parse_json("props"), "/k")))
    return X.run(df, F.col("v"), [{"op": "strip"}], "s").groupBy(F.coalesce("s.e", F.lit("ok")).alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT row_number() OVER () AS n, lower(trim(kind)) AS kind, data, json_valid(data) AS ok FROM resource_snapshots WHERE data IS NOT NULL),
w AS (SELECT n, count(*) AS nodes FROM r, json_tree(CASE WHEN ok THEN data END) j WHERE ok GROUP BY n),
deep AS (SELECT n, CAST(max(coalesce(len(regexp_extract_all(j.fullkey, '\\[[0-9]+\\]|\\."(?:[^"\\\\]|\\\\.)*"|\\.[^.\\["]+')), 0)) AS INT) AS depth FROM r, json_tree(CASE WHEN ok THEN data END) j WHERE ok GROUP BY n)
SELECT kind, max(depth) AS deepest, CAST(max(nodes) AS INT) AS most_nodes, count(*) AS documents FROM r LEFT JOIN w USING (n) LEFT JOIN deep USING (n) GROUP BY kind""")
def tree_budget(spark: SparkSession, d: str) -> DataFrame:
    """Depth and nodes of every resource document, grouped."""
    size = canon.json_tree_size(F.col("data"))
    rows = table(spark, d, "resource_snapshots").filter("data is not null").select("kind", size.alias("t"))
    return rows.groupBy(F.lower(F.trim("kind")).alias("kind")).agg(F.max("t.depth").alias("deepest"), F.max("t.nodes").alias("most_nodes"), F.count("*").alias("documents"))


@query("""SELECT c_custkey, sha256('{"key":' || c_custkey || ',"name":"' || c_name || '","nation":' || c_nationkey || '}') AS hash FROM customer""")
def canonical_hash(spark: SparkSession, d: str) -> DataFrame:
    doc = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("key")))
    return table(spark, d, "customer").select("c_custkey", canon.text_digest(canon.canonical_text(doc)).alias("hash"))


def _customer_recipe() -> Recipe:
    schema = {"type": "object", "properties": {"key": {"type": "integer"}, "name": {"type": "string", "maxLength": 17}, "segment": {"type": "string"}}, "required": ["key", "name"]}
    return Recipe("customers", "json", Scope("one_per_resource"), {
        "/key": _pointer("/c_custkey", required=True), "/name": _pointer("/c_name", transforms=({"op": "strip"}, {"op": "regex_capture", "pattern": "#0*(.+)"}), required=True),
        "/segment": _pointer("/c_mktsegment", transforms=({"op": "enum_map", "mapping": {"MACHINERY": "machines", "BUILDING": "building"}, "unknown": "error"},))}, ("/key",), schema)


def _customer_pages(spark: SparkSession, d: str, columns=("c_custkey", "c_name", "c_mktsegment")) -> DataFrame:
    rows = spread(table(spark, d, "customer").select(*columns))
    return rows.select(F.concat(F.lit("https://crm.example/"), F.col("c_custkey")).alias("url"), F.col("c_custkey").alias("ord"), F.to_json(F.struct(*columns)).alias("body"))


@query("""SELECT sha256('["default","customers",[' || c_custkey || ']]') AS record_id,
 '{"key":' || c_custkey || ',"name":"' || regexp_extract(c_name, '#0*(.+)', 1) || '"' || CASE c_mktsegment WHEN 'MACHINERY' THEN ',"segment":"machines"' WHEN 'BUILDING' THEN ',"segment":"building"' ELSE '' END || '}' AS data
FROM customer WHERE regexp_matches(c_name, '#0*(.+)')""")
def extract_records(spark: SparkSession, d: str) -> DataFrame:
    return E.records(E.extract(_customer_pages(spark, d), _customer_recipe(), evidence=False)).select("record_id", "data")


@query("""SELECT path, outcome, error, count(*) AS n FROM (
 SELECT '/key' AS path, 'observed' AS outcome, NULL AS error FROM customer
 UNION ALL SELECT '/name', 'derived', NULL FROM customer
 UNION ALL SELECT '/segment', CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'derived' ELSE 'missing' END, CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN NULL ELSE 'TRANSFORM_PARSE' END FROM customer)
GROUP BY path, outcome, error""")
def evidence_outcomes(spark: SparkSession, d: str) -> DataFrame:
    proof = E.evidence_rows(E.extract(_customer_pages(spark, d), _customer_recipe()))
    return proof.groupBy("path", "outcome", "error").agg(F.count("*").alias("n"))


def _listing_recipe() -> Recipe:
    schema = {"type": "object", "properties": {"id": {"type": "integer"}, "brand": {"type": "string", "minLength": 1}, "type": {"type": "string"}}, "required": ["id"]}
    return Recipe("listings", "json", Scope("one_per_resource"), {
        "/id": _pointer("/listing_id", required=True), "/brand": _pointer("/brand", transforms=({"op": "strip"},), required=True), "/type": _pointer("/type_id", transforms=({"op": "strip"}, {"op": "regex_capture", "pattern": "^([0-9]+)$"}), required=True)}, ("/id",), schema)


def _listing_pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "products").select("source_url", "listing_id", "brand", "type_id")).select(F.coalesce("source_url", F.lit("https://unknown.example/")).alias("url"), F.col("listing_id").alias("ord"), F.to_json(F.struct("listing_id", "brand", "type_id")).alias("body"))


@query(rf"""WITH t AS (SELECT listing_id, brand, regexp_replace(brand, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS b, type_id, regexp_replace(type_id, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS y FROM products),
e AS (SELECT listing_id, '/brand:LOCATOR_ZERO' AS error FROM t WHERE brand IS NULL
 UNION ALL SELECT listing_id, '/brand:VALIDATION_FAILED' FROM t WHERE b = ''
 UNION ALL SELECT listing_id, '/type:LOCATOR_ZERO' FROM t WHERE type_id IS NULL
 UNION ALL SELECT listing_id, '/type:TRANSFORM_PARSE' FROM t WHERE NOT regexp_matches(y, '^([0-9]+)$'))
SELECT error, count(*) AS records FROM e GROUP BY error""")
def quarantine_errors(spark: SparkSession, d: str) -> DataFrame:
    bad = E.quarantined(E.extract(_listing_pages(spark, d), _listing_recipe(), evidence=False))
    return bad.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("records"))


@query("""SELECT p_partkey, p_brand AS brand, p_size AS size FROM part""")
def labeled_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Pre-converted document blocks located by their labels."""
    part = table(spark, d, "part")
    block = lambda label, c: F.struct(F.lit(label).alias("label"), F.col(c).cast("string").alias("value"))
    pages = part.select(F.lit("https://pdf.example/").alias("url"), F.col("p_partkey").alias("ord"), F.to_json(F.struct(F.array(block("Key", "p_partkey"), block("Brand", "p_brand"), block("Size", "p_size")).alias("blocks"))).alias("body"))
    recipe = Recipe("parts", "pdf", Scope("one_per_document"), {"/key": Field(Locator("labeled_value", "Key"), required=True), "/brand": Field(Locator("labeled_value", "Brand")), "/size": Field(Locator("labeled_value", "Size"), transforms=({"op": "parse_decimal", "decimal_separator": "."},))}, ("/key",))
    data = F.from_json("data", "key string, brand string, size double")
    return E.records(E.extract(pages, recipe, evidence=False)).select(data.alias("r")).select(F.col("r.key").cast("long").alias("p_partkey"), "r.brand", F.col("r.size").cast("int").alias("size"))


def _line_pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")).select(F.lit("https://lines.example/").alias("url"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.to_json(F.struct("l_orderkey", "l_returnflag")).alias("body"))


def _line_recipe() -> Recipe:
    return Recipe("lines", "json", Scope("one_per_resource"), {"/order": _pointer("/l_orderkey", required=True), "/flag": _pointer("/l_returnflag", required=True)}, ("/order",))


@query("SELECT l_orderkey AS order_key, min(l_returnflag) AS flag, count(*) AS instances FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 1")
def identity_merge(spark: SparkSession, d: str) -> DataFrame:
    merged, _ = E.merge(E.extract(_line_pages(spark, d), _line_recipe(), evidence=False))
    r = F.from_json("data", "order long, flag string")
    return merged.select(r.alias("r"), "instances").select(F.col("r.order").alias("order_key"), "r.flag", "instances")


@query("SELECT l_orderkey AS order_key, count(*) AS instances FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1")
def identity_conflict(spark: SparkSession, d: str) -> DataFrame:
    _, clash = E.merge(E.extract(_line_pages(spark, d), _line_recipe(), evidence=False))
    return clash.groupBy(F.get_json_object("data", "$.order").cast("long").alias("order_key")).agg(F.count("*").alias("instances"))


@query("""SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 10 = 1 THEN 'added' WHEN o_orderkey % 10 = 2 THEN 'removed' ELSE 'changed' END AS change
FROM orders WHERE o_orderkey % 10 IN (1, 2) OR (o_orderkey % 10 = 3 AND o_orderstatus <> 'F')""")
def semantic_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two states of the orders as record sets, compared by canonical content."""
    orders = table(spark, d, "orders")

    def side(rows, status):
        data = F.to_json(F.struct(F.col("o_orderkey").alias("key"), status.alias("status")))
        return rows.select(F.col("o_orderkey").cast("string").alias("record_id"), data.alias("data"), F.sha2(data, 256).alias("data_hash"))

    before = side(orders.filter("o_orderkey % 10 <> 1"), F.col("o_orderstatus"))
    after = side(orders.filter("o_orderkey % 10 <> 2"), F.when(F.col("o_orderkey") % 10 == 3, "F").otherwise(F.col("o_orderstatus")))
    return E.semantic_diff(before, after).select(F.col("record_id").cast("long").alias("order_key"), "change")


@query("SELECT CAST(count(*) AS BIGINT) AS records, CAST(0 AS BIGINT) AS mismatches FROM customer")
def replay_check(spark: SparkSession, d: str) -> DataFrame:
    pages, recipe = _customer_pages(spark, d), _customer_recipe()
    kept = cut(E.result_rows(E.extract(pages, recipe)))
    return beside(kept.agg(F.count("*").alias("records")), E.replay(pages, recipe, kept).agg(F.count("*").alias("mismatches")))


@query("""SELECT source, count(*) AS pages, sha256(string_agg(coalesce(url, '') || ' ' || sha256(coalesce(text, '')), chr(10) ORDER BY doc_id)) AS manifest FROM documents WHERE source IN ('datasheets', 'help-centre') GROUP BY source""")
def manifest_hash(spark: SparkSession, d: str) -> DataFrame:
    """One digest per named collection, over its pages in order."""
    docs = table(spark, d, "documents").filter(F.col("source").isin("datasheets", "help-centre"))
    out = None
    for name in ("datasheets", "help-centre"):
        pages = docs.filter(F.col("source") == name).select(F.coalesce("url", F.lit("")).alias("url"), F.coalesce("text", F.lit("")).alias("body"), F.col("doc_id").alias("ord"))
        one = E.manifest(pages).select(F.lit(name).alias("source"), "pages", F.col("snapshot_hash").alias("manifest")).filter("pages > 0")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT source, count(*) AS pages, sha256(string_agg(coalesce(url, '') || ' ' || sha256(coalesce(text, '')), chr(10) ORDER BY doc_id)) AS manifest FROM documents GROUP BY source""")
def manifest_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The digest of ``manifest_hash`` for every source in one plan."""
    pages = table(spark, d, "documents").select("source", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("text", F.lit("")).alias("body"), F.col("doc_id").alias("ord"))
    return E.manifests(pages, "source").withColumnRenamed("snapshot_hash", "manifest")


@query("SELECT count(DISTINCT n_regionkey) AS pages, count(*) AS records, CAST(0 AS BIGINT) AS quarantined, count(*) * 2 AS evidence FROM nation")
def pages_extract(spark: SparkSession, d: str) -> DataFrame:
    """One collection: a page per region with its nations, within the recipe's limits.

    A collection without pages is refused by the operator; the query has no rows then.
    """
    pages = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))).alias("items"))
    pages = pages.select(F.concat(F.lit("https://geo.example/"), "n_regionkey").alias("url"), F.col("n_regionkey").alias("ord"), F.to_json(F.struct("items")).alias("body"))
    recipe = Recipe("nations", "json", Scope("items_path", "$.items[*]"), {"/key": _pointer("/key", required=True), "/name": _pointer("/name")}, ("/key",))
    if not pages.take(1):
        return pages.select(*[F.lit(0).cast("long").alias(c) for c in ("pages", "records", "quarantined", "evidence")])
    told = E.collect_pages(pages, recipe)
    return beside(told["summary"].select("pages", "records", "quarantined"), told["evidence"].agg(F.count("*").alias("evidence")))


def _html(spark: SparkSession, d: str) -> DataFrame:
    """Listings as product pages: title, labelled table, links, JSON-LD."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    p = spread(table(spark, d, "products").select("listing_id", "product_name", "brand", "short_description", "source_id"))
    ld = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("product_name").alias("name"), F.col("listing_id").alias("sku"), F.struct(F.col("brand").alias("name")).alias("brand")))
    html = F.concat(
        F.lit('<html><body><script>var t="</p>"</script><div class="product card"><h1 itemprop="name">'), esc(F.col("product_name")), F.lit('</h1><span data-sku="'), F.col("listing_id"), F.lit('"></span><p>'), esc(F.col("short_description")),
        F.lit('<a class="doc" href="/pdf/'), F.col("listing_id"), F.lit('.pdf">sheet</a><table><tr><th>Brand</th><td>'), esc(F.col("brand")), F.lit("</td></tr><tr><th>Seller</th><td>"), esc(F.col("source_id")), F.lit('</td></tr></table></div><script type="application/ld+json">'), F.replace(ld, F.lit("</"), F.lit("<\\/")), F.lit("</script>"))
    return p.select(F.concat(F.lit("https://shop.example/p/"), F.col("listing_id")).alias("url"), F.col("listing_id").alias("ord"), html.alias("body"))


def _html_recipe(**fields) -> Recipe:
    return Recipe("shop", "html", Scope("container_selector", "div.product"), {"/sku": Field(Locator("css_attr", "[data-sku]", "data-sku"), required=True), **fields}, ("/sku",))


@query("SELECT listing_id, coalesce(product_name, '') AS title FROM products")
def css_title(spark: SparkSession, d: str) -> DataFrame:
    recipe = _html_recipe(**{"/title": Field(Locator("css_text", "h1[itemprop=name]"))})
    r = F.from_json("data", "sku string, title string")
    return E.records(E.extract(_html(spark, d), recipe, evidence=False)).select(r.alias("r")).select(F.col("r.sku").cast("long").alias("listing_id"), F.coalesce("r.title", F.lit("")).alias("title"))


@query("SELECT listing_id, 'https://shop.example/pdf/' || listing_id || '.pdf' AS sheet FROM products")
def css_links(spark: SparkSession, d: str) -> DataFrame:
    recipe = _html_recipe(**{"/sheet": Field(Locator("css_attr", "a.doc[href$='.pdf']", "href"), transforms=({"op": "resolve_url"},))})
    r = F.from_json("data", "sku string, sheet string")
    return E.records(E.extract(_html(spark, d), recipe, evidence=False)).select(r.alias("r")).select(F.col("r.sku").cast("long").alias("listing_id"), "r.sheet")


@query("SELECT listing_id, brand, product_name AS name FROM products")
def jsonld(spark: SparkSession, d: str) -> DataFrame:
    recipe = Recipe("ld", "html", Scope("one_per_resource"), {"/sku": Field(Locator("jsonld", "sku"), required=True), "/brand": Field(Locator("jsonld", "/brand/name")), "/name": Field(Locator("jsonld", "name"))}, ("/sku",))
    r = F.from_json("data", "sku long, brand string, name string")
    return E.records(E.extract(_html(spark, d), recipe, evidence=False)).select(r.alias("r")).select(F.col("r.sku").alias("listing_id"), "r.brand", "r.name")


@query("SELECT listing_id, source_id AS seller, CASE WHEN coalesce(brand, '') = '' THEN 1 ELSE 2 END AS filled FROM products")
def spec_map(spark: SparkSession, d: str) -> DataFrame:
    """A th/td table read as a map."""
    recipe = _html_recipe(**{"/keys": Field(Locator("css_text", "tr > th"), "many"), "/values": Field(Locator("css_text", "tr > td"), "many")})
    r = F.from_json("data", "sku string, keys array<string>, values array<string>")
    rows = E.records(E.extract(_html(spark, d), recipe, evidence=False)).select(r.alias("r"))
    specs = F.map_from_entries(F.arrays_zip("r.keys", "r.values"))
    return rows.select(F.col("r.sku").cast("long").alias("listing_id"), F.try_element_at(specs, F.lit("Seller")).alias("seller"), F.size(F.filter(F.map_values(specs), lambda v: v != "")).alias("filled"))


@query("SELECT listing_id, coalesce(nullif(short_description, ''), nullif(long_description, ''), product_name) AS told FROM products")
def coalesce_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("listing_id", F.coalesce(F.nullif("short_description", F.lit("")), F.nullif("long_description", F.lit("")), F.col("product_name")).alias("told"))


@query("SELECT listing_id, key AS spec, value AS told FROM (SELECT listing_id, unnest(json_keys(technical_specs)) AS key, technical_specs AS s FROM products WHERE technical_specs IS NOT NULL) t, LATERAL (SELECT json_extract_string(s, '$.\"' || key || '\"') AS value) WHERE position('\"' IN key) = 0 AND json_type(s, '$.\"' || key || '\"') = 'VARCHAR'")
def variant_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Spec entries as rows of their own: one listing, many attributes."""
    m = F.try_variant_get(F.try_parse_json("technical_specs"), "$", "map<string,variant>")
    rows = table(spark, d, "products").filter("technical_specs is not null").select("listing_id", F.explode(m).alias("spec", "v"))
    return rows.filter((F.schema_of_variant("v") == "STRING") & ~F.contains("spec", F.lit('"'))).select("listing_id", "spec", F.try_variant_get("v", "$", "string").alias("told"))


@query("""WITH v AS (SELECT listing_id, unnest(CASE WHEN listing_id % 3 = 0 THEN [] ELSE ['small', 'large'] END) AS size, unnest(CASE WHEN listing_id % 3 = 0 THEN [] ELSE [0, 1] END) AS n FROM products)
SELECT p.listing_id, CAST(v.n AS INT) AS variant_no, coalesce(v.size, 'base') AS size, p.source_id AS seller, coalesce(CASE WHEN v.n = 1 THEN 'L-' || p.listing_id END, nullif(model_article_number, ''), string_split(regexp_replace(regexp_replace(source_url, '[?#].*$', ''), '/+$', ''), '/')[-1]) AS order_number
FROM products p LEFT JOIN v USING (listing_id)""")
def variant_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row per variant; its specs override the product's, and its order number comes first."""
    sizes = F.array(F.create_map(F.lit("Size"), F.lit("small")), F.create_map(F.lit("Size"), F.lit("large"), F.lit("Order number"), F.concat(F.lit("L-"), "listing_id")))
    p = table(spark, d, "products").withColumn("specs", F.create_map(F.lit("Size"), F.lit("base"), F.lit("Seller"), F.col("source_id"))).withColumn("variants", F.when(F.col("listing_id") % 3 != 0, sizes))
    out = fan_out(p, "variants", "specs")
    return out.select("listing_id", "variant_no", F.try_element_at("specs", F.lit("Size")).alias("size"), F.try_element_at("specs", F.lit("Seller")).alias("seller"), "order_number")


@query(r"SELECT listing_id, coalesce(nullif(regexp_extract(product_name, '\b([A-Z]+[-]?[0-9][A-Z0-9-]*)\b', 1), ''), string_split(regexp_replace(regexp_replace(source_url, '[?#].*$', ''), '/+$', ''), '/')[-1]) AS model FROM products")
def model_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("listing_id", text.model_number(F.col("product_name"), F.col("source_url")).alias("model"))


@query("SELECT doc_id, sha256(text) AS key FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0 OR text = ''")
def incremental_skip(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots whose digest wasn't extracted before (anti-join ahead of the plan)."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", canon.text_digest(F.col("text")).alias("key"), "text")
    done = docs.filter("doc_id % 2 = 1 and text <> ''").select("doc_id", "key")
    return docs.join(done, ["doc_id", "key"], "left_anti").select("doc_id", "key")


QUERIES, SQL = query.queries, query.sql
