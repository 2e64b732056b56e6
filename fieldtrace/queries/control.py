"""Queries of audits, frontiers, event-log folds, pages, artifacts and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fieldtrace.functions import canon, text
from fieldtrace.operators import audit as A, control as C, frontier as N, hierarchy as H
from fieldtrace.plans.extract import parse_strict
from fieldtrace.queries.extraction import _BLANK, _html
from fieldtrace.queries.problems import _LATEST
from fieldtrace.queries.registry import Registry
from fieldtrace.sources import artifacts as S
from fieldtrace.runtime import beside, cut, table

query = Registry()


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return H.latest_rows(table(spark, d, "classification_tree").select("id", "parent_id", "path", "loaded_at"))


_WORDS = r"array_to_string(regexp_extract_all(lower(coalesce(product_name, '')), '[\p{L}\p{N}_]+'), ' ')"
_FLAGS = f"""WITH {_LATEST}, leaf AS (SELECT id FROM latest WHERE id NOT IN (SELECT parent_id FROM latest WHERE parent_id IS NOT NULL)),
t AS (SELECT *, coalesce(type_id, '') AS label, coalesce(source_url, '') AS url, coalesce(brand, chr(1)) || chr(31) || {_WORDS} AS name_key FROM products),
f AS (SELECT listing_id, list_sort(list_filter([
 CASE WHEN l.id IS NULL THEN 'unknown_or_missing_predicted_id' WHEN f.id IS NULL THEN 'predicted_id_is_not_leaf' WHEN coalesce(classification_path, '') <> coalesce(l.path, '') THEN 'predicted_path_mismatch' END,
 CASE WHEN NOT (coalesce(product_name, '') <> '' AND (coalesce(short_description, '') <> '' OR coalesce(long_description, '') <> '')) THEN 'missing_name_or_description' END,
 CASE WHEN NOT regexp_matches(lower(url), '^https?://[^/?#\\s]+') THEN 'invalid_source_url' END,
 CASE WHEN url <> '' AND count(*) OVER (PARTITION BY url) > 1 THEN 'duplicate_source_url' END,
 CASE WHEN count(*) OVER (PARTITION BY name_key) > 1 THEN 'duplicate_brand_product_name' END], lambda x: x IS NOT NULL)) AS issues
FROM t LEFT JOIN latest l ON CAST(l.id AS VARCHAR) = label LEFT JOIN leaf f ON f.id = l.id)"""


@query(_FLAGS + " SELECT listing_id, array_to_string(issues, ',') AS issues FROM f")
def audit_flags(spark: SparkSession, d: str) -> DataFrame:
    return A.flags(table(spark, d, "products"), _tree(spark, d)).select("listing_id", F.array_join("issues", ",").alias("issues"))


@query(_FLAGS + " SELECT issue, count(*) AS records FROM (SELECT unnest(issues) AS issue FROM f) GROUP BY issue")
def audit_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.issue_counts(A.flags(table(spark, d, "products"), _tree(spark, d)))


@query(f"WITH {_LATEST} SELECT lower(name) AS name, count(*) AS nodes, min(id) AS first_id FROM latest WHERE name IS NOT NULL GROUP BY lower(name) HAVING count(*) > 1")
def dup_names(spark: SparkSession, d: str) -> DataFrame:
    nodes = H.latest_rows(table(spark, d, "classification_tree").select("id", "name", "loaded_at")).filter("name is not null")
    return nodes.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("nodes"), F.min("id").alias("first_id")).filter("nodes > 1")


@query("SELECT DISTINCT review_id, r.listing_id, coalesce(type_id, '') AS original_type_id, CAST(proposed_type_id AS VARCHAR) AS proposed_type_id, rationale FROM spot_reviews r JOIN products p USING (listing_id) WHERE CAST(proposed_type_id AS VARCHAR) <> coalesce(type_id, '')")
def review_disagreements(spark: SparkSession, d: str) -> DataFrame:
    return A.disagreements(table(spark, d, "products"), table(spark, d, "spot_reviews"))


@query("SELECT coalesce(regexp_extract(lower(source_url), '^https?://([^/?#:]+)', 1), '') AS host, count(*) AS listings, count(DISTINCT brand) AS brands FROM products GROUP BY 1")
def host_counts(spark: SparkSession, d: str) -> DataFrame:
    host = F.coalesce(F.lower(F.try_parse_url("source_url", F.lit("HOST"))), F.lit(""))
    return table(spark, d, "products").groupBy(host.alias("host")).agg(F.count("*").alias("listings"), F.countDistinct("brand").alias("brands"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 3 = 0 THEN 'SNAPSHOT_INVALID' END AS error FROM events")
def error_column(spark: SparkSession, d: str) -> DataFrame:
    """A row that can't be processed is kept with its error instead of failing the job."""
    broken = F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    v = parse_strict(broken)
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.when(v.isNull(), "SNAPSHOT_INVALID").alias("error"))


# frontier
@query("SELECT listing_id, regexp_replace(regexp_replace(source_url, '[?#].*$', ''), '/+$', '') AS bare FROM products")
def strip_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("listing_id", text.bare_url(F.col("source_url")).alias("bare"))


@query("SELECT listing_id, CASE WHEN source_url IS NULL THEN '/pdf/x.pdf' ELSE lower(regexp_extract(source_url, '^([A-Za-z]+)://', 1)) || regexp_extract(source_url, '^[A-Za-z]+(://[^/]+)', 1) || '/pdf/x.pdf' END AS absolute FROM products")
def resolve_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("listing_id", text.resolve_url(F.col("source_url"), F.lit("/pdf/x.pdf")).alias("absolute"))


_ALLOWED = ["www.quorbeldirekt.example", "shop-veldomardepot.example"]


@query(f"""SELECT code, count(*) AS urls FROM (SELECT CASE WHEN source_url IS NULL OR NOT regexp_matches(lower(source_url), '^https?://[^/?#@]+') OR position('#' IN source_url) > 0
 OR len(list_filter(string_split(coalesce(nullif(regexp_extract(source_url, '\\?(.*)$', 1), ''), 'x'), '&'), lambda p: list_contains({N.SECRET_KEYS}, regexp_replace(lower(string_split(p, '=')[1]), '[^a-z]', '', 'g')))) > 0 THEN 'URL_POLICY_DENIED'
 WHEN NOT list_contains({_ALLOWED}, regexp_extract(lower(source_url), '^https?://([^/?#:]+)', 1)) THEN 'DOMAIN_DENIED' ELSE 'allowed' END AS code FROM products) GROUP BY code""")
def url_policy(spark: SparkSession, d: str) -> DataFrame:
    code = F.coalesce(N.url_policy(F.col("source_url"), _ALLOWED), F.lit("allowed"))
    return table(spark, d, "products").groupBy(code.alias("code")).agg(F.count("*").alias("urls"))


@query("""WITH l AS (SELECT listing_id, datasheet_url AS u, source_url AS page FROM products WHERE coalesce(datasheet_url, '') <> ''),
j AS (SELECT listing_id, CASE WHEN regexp_matches(u, '^[A-Za-z]+://') THEN u END AS t, page FROM l)
SELECT count(*) AS links, count(*) FILTER (WHERE t IS NOT NULL AND NOT (lower(coalesce(page, '')) LIKE 'https:%' AND lower(t) LIKE 'http:%') AND regexp_extract(lower(t), '^https?://([^/?#:]+)', 1) = 'www.quorbeldirekt.example') AS allowed FROM j""")
def link_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Datasheet links of all listings, resolved against their page and checked."""
    p = table(spark, d, "products").select(F.coalesce("source_url", F.lit("https://unknown.example/")).alias("url"), F.array(F.col("datasheet_url").cast("variant")).alias("values"))
    told = N.discover(p, ["www.quorbeldirekt.example"])
    return told.agg(F.count("*").alias("links"), F.count_if(F.col("error").isNull()).alias("allowed"))


@query("SELECT c_custkey, CAST(c_custkey % 4 = 0 AS BOOLEAN) AS allowed FROM customer")
def address_policy(spark: SparkSession, d: str) -> DataFrame:
    address = F.element_at(F.array(F.lit("93.184.216.34"), F.lit("10.0.0.1"), F.lit("2002:7f00:1::1"), F.lit("64:ff9b::a00:1")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", N.public_address(address).alias("allowed"))


@query("SELECT source_id, count(*) AS urls, count_if(position('/p/' IN source_url) = 0) AS allowed, CAST(7.0 AS DOUBLE) AS delay FROM products WHERE source_url IS NOT NULL GROUP BY source_id")
def robots_policy(spark: SparkSession, d: str) -> DataFrame:
    robots = F.lit("User-agent: *\nDisallow: /p/\nCrawl-delay: 7\nRequest-rate: 1/5\n")
    rows = table(spark, d, "products").filter("source_url is not null").withColumn("r", N.robots_rule(robots, F.lit("fieldtrace"), F.col("source_url")))
    return rows.groupBy("source_id").agg(F.count("*").alias("urls"), F.count_if("r.allowed").alias("allowed"), F.max("r.delay").alias("delay"))


@query("""WITH RECURSIVE w AS (SELECT 1 AS n, 0 AS wave UNION SELECT t, wave + 1 FROM w, LATERAL (SELECT unnest([2 * n, 2 * n + 1]) AS t) WHERE t <= (SELECT count(*) FROM part))
SELECT 'https://site.example/' || n AS url, CAST(wave AS INT) AS wave, CAST(n - 1 AS INT) AS position FROM w""")
def crawl_waves(spark: SparkSession, d: str) -> DataFrame:
    """Breadth-first over a site where page n links to 2n, 2n+1, home and itself."""
    part = table(spark, d, "part")
    n = part.count()
    at = lambda c: F.concat(F.lit("https://site.example/"), c)
    k = F.col("p_partkey") + 1
    targets = F.array(at(2 * k), at(2 * k + 1), at(F.lit(1)), at(k))
    links = part.select(at(k).alias("url"), F.posexplode(targets).alias("ord", "target"))
    known = part.select(at(k).alias("target"))
    seeds = spark.createDataFrame([("https://site.example/1", 0), ("https://site.example/1", 1)], "url string, ord int")
    return N.crawl_waves(links.join(known, "target", "left_semi"), seeds, n)


@query(f"SELECT 'https://www.' || source_id || '.example/' || lower(replace(coalesce(nullif(regexp_replace(category, '^{_BLANK}+|{_BLANK}+$', '', 'g'), ''), 'all'), ' ', '-')) AS category_url, count(*) AS pages FROM (SELECT DISTINCT source_id, category, listing_id FROM products) GROUP BY 1")
def crawl_levels(spark: SparkSession, d: str) -> DataFrame:
    """Fixed levels: seller, category page, product page, each level deduplicated."""
    p = table(spark, d, "products")
    slug = F.lower(F.replace(F.coalesce(F.nullif(text.strip(F.col("category")), F.lit("")), F.lit("all")), F.lit(" "), F.lit("-")))
    pages = p.select(F.concat(F.lit("https://www."), "source_id", F.lit(".example/"), slug).alias("category_url"), "listing_id").dropDuplicates()
    return pages.groupBy("category_url").agg(F.count("*").alias("pages"))


@query("SELECT source_url AS url FROM products WHERE source_url IS NOT NULL AND listing_id % 2 = 0 GROUP BY source_url HAVING source_url NOT IN (SELECT source_url FROM products WHERE listing_id % 2 = 1 AND source_url IS NOT NULL)")
def new_urls(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "products").filter("source_url is not null").select(F.col("source_url").alias("url"), "listing_id")
    return p.filter("listing_id % 2 = 0").select("url").distinct().join(p.filter("listing_id % 2 = 1").select("url"), "url", "left_anti")


@query("SELECT source_id, CAST(idx AS INT) AS idx, source_url AS loc FROM (SELECT source_id, source_url, row_number() OVER (PARTITION BY source_id ORDER BY listing_id) - 1 AS idx FROM products WHERE source_url IS NOT NULL)")
def sitemap_scan(spark: SparkSession, d: str) -> DataFrame:
    """Locations of sitemaps: each seller's URLs in files of at most 1,000, as sitemaps are."""
    p = table(spark, d, "products").filter("source_url is not null").select("source_id", "listing_id", "source_url")
    idx = F.row_number().over(Window.partitionBy("source_id").orderBy("listing_id")) - 1
    loc = F.concat(F.lit("<url><loc>"), F.replace("source_url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    files = p.withColumn("idx", idx).groupBy("source_id", F.floor(F.col("idx") / 1000).alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", loc.alias("x")))), lambda s: s["x"]), "").alias("body"))
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "body", F.lit("</urlset>"))
    found = files.select("source_id", "file", F.posexplode(S.sitemap_urls(xml)).alias("pos", "loc"))
    return found.select("source_id", (F.col("file") * 1000 + F.col("pos")).cast("int").alias("idx"), "loc")


# event-log folds
@query("SELECT user_id, event_id, event_type FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def claim_next(spark: SparkSession, d: str) -> DataFrame:
    """The job each queue would hand out next: earliest available, then least id."""
    jobs = table(spark, d, "events").filter("event_type <> 'error'").select("user_id", "ts", "event_id", "event_type")
    return C.first_per_key(jobs, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""WITH f AS (SELECT event_id, user_id, event_type || '-' || CAST(floor(value) % 5 AS INT) AS key, floor(value) AS h FROM events)
SELECT outcome, count(*) AS requests FROM (SELECT CASE WHEN row_number() OVER w = 1 THEN 'stored' WHEN h = first_value(h) OVER w THEN 'replayed' ELSE 'conflict' END AS outcome FROM f WINDOW w AS (PARTITION BY key || user_id ORDER BY event_id)) GROUP BY outcome""")
def idempotency(spark: SparkSession, d: str) -> DataFrame:
    h = F.floor("value")
    rows = table(spark, d, "events").select(F.concat("event_type", F.lit("-"), (h % 5).cast("int"), "user_id").alias("key"), F.col("event_id").alias("seq"), h.cast("string").alias("request_hash"))
    return C.idempotency(rows).groupBy("outcome").agg(F.count("*").alias("requests"))


@query("""WITH RECURSIVE o AS (SELECT o_custkey AS key, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, CASE WHEN o_orderkey % 7 = 0 THEN 99 ELSE row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 END AS expected FROM orders),
f AS (SELECT key, seq, n, expected, expected = 0 AS accepted, CASE WHEN expected = 0 THEN 1 ELSE 0 END AS version FROM o WHERE n = 1
 UNION ALL SELECT o.key, o.seq, o.n, o.expected, o.expected = f.version, f.version + CAST(o.expected = f.version AS INT) FROM f JOIN o ON o.key = f.key AND o.n = f.n + 1)
SELECT key, seq, CAST(expected AS BIGINT) AS expected, accepted FROM f""")
def version_chain(spark: SparkSession, d: str) -> DataFrame:
    """Optimistic writes: after a refused one, expectations no longer match."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 7 == 0, 99).otherwise(n).alias("expected_version"))
    return C.version_chain(rows)


@query("""WITH RECURSIVE q AS (SELECT source AS key, doc_id AS seq, coalesce(length(text), 0) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
f AS (SELECT key, seq, n, size, size <= 20000 AS accepted, CASE WHEN size <= 20000 THEN size ELSE 0 END AS used FROM q WHERE n = 1
 UNION ALL SELECT q.key, q.seq, q.n, q.size, f.used + q.size <= 20000, CASE WHEN f.used + q.size <= 20000 THEN f.used + q.size ELSE f.used END FROM f JOIN q ON q.key = f.key AND q.n = f.n + 1)
SELECT key, seq, CAST(size AS BIGINT) AS size, accepted FROM f""")
def quota_fold(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("source").alias("key"), F.col("doc_id").alias("seq"), F.coalesce(F.length("text"), F.lit(0)).alias("size"), F.lit(20000).alias("limit"))
    return C.quota(rows)


@query("""SELECT user_id AS origin, event_id AS seq, round(max(t - k * 60) OVER (PARTITION BY user_id ORDER BY event_id) + k * 60, 3) AS planned
FROM (SELECT user_id, event_id, epoch_us(ts) / 1e6 - 1704067200 AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events)""")
def origin_slots(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("origin"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200).alias("at"))
    return C.slots(rows, F.lit(60)).withColumn("planned", F.round("planned", 3))


@query("SELECT o_custkey AS source, o_orderkey AS seq, o_orderpriority AS item, CASE WHEN o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) THEN 'active' ELSE 'superseded' END AS state FROM orders")
def supersede(spark: SparkSession, d: str) -> DataFrame:
    return C.supersession(table(spark, d, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("item")))


@query("""SELECT o_orderkey AS id, CAST(floor((epoch(TIMESTAMP '1995-01-01') - epoch(o_orderdate)) / 86400) AS BIGINT) AS missed, TIMESTAMP '1995-01-02' AS next_due FROM orders WHERE o_orderdate <= TIMESTAMP '1995-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 10""")
def schedule_due(spark: SparkSession, d: str) -> DataFrame:
    """The ten schedules that a dispatch takes at once."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("next_due"), F.lit(86400).alias("interval_s"))
    due = C.due(rows, F.lit("1995-01-01").cast("timestamp"), 10)
    return due.select("id", "missed", F.col("next_due").cast("timestamp_ntz").alias("next_due"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 51")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of 50 and one row that tells whether there is another."""
    return C.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1000, 51)


@query("SELECT o_orderdate, o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1998-01-01', 500) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51")
def keyset_desc(spark: SparkSession, d: str) -> DataFrame:
    import datetime

    return C.page_desc(table(spark, d, "orders").select("o_orderdate", "o_orderkey"), "o_orderdate", "o_orderkey", (datetime.datetime(1998, 1, 1), 500), 51)


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 50")
def offset_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_name").orderBy("c_custkey").offset(50).limit(25)


@query("SELECT event_id, event_type FROM events WHERE event_id > 900 ORDER BY event_id LIMIT 101")
def audit_page(spark: SparkSession, d: str) -> DataFrame:
    return C.page(table(spark, d, "events").select("event_id", "event_type"), "event_id", 900, 101)


# artifacts and files
@query("SELECT count(DISTINCT sha256(text)) AS stored, count(DISTINCT sha256(text)) AS keys, CAST(0 AS BIGINT) AS again, CAST(0 AS BIGINT) AS corrupt FROM documents WHERE text IS NOT NULL")
def artifact_put(spark: SparkSession, d: str) -> DataFrame:
    """Texts stored by digest: copies once, a second put adds nothing, all verify."""
    store = S.scratch(spark)
    bodies = table(spark, d, "documents").select(F.col("text").alias("body"))
    stored, again = cut(S.put(bodies, store)).agg(F.count("*").alias("stored")), cut(S.put(bodies, store)).agg(F.count("*").alias("again"))
    keys = spark.read.parquet(store).agg(F.count("*").alias("keys"))
    return beside(stored, keys, again, S.verify(spark, store).agg(F.count("*").alias("corrupt")))


@query("SELECT CASE listing_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'json' ELSE 'pdf' END AS mode, count(*) AS pages, count_if(listing_id % 3 = 0 OR (listing_id % 3 = 1 AND listing_id % 2 = 0)) AS allowed FROM products GROUP BY 1")
def mime_gate(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("listing_id")
    mode = F.when(k % 3 == 0, "html").when(k % 3 == 1, "json").otherwise("pdf")
    kind = F.when(k % 3 == 0, "Text/HTML; charset=utf-8").when(k % 2 == 0, "application/json").otherwise("text/plain")
    return table(spark, d, "products").groupBy(mode.alias("mode")).agg(F.count("*").alias("pages"), F.count_if(S.mime_allowed(mode, kind)).alias("allowed"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as CSV with a byte order mark and read back."""
    path = S.scratch(spark)
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("﻿c_custkey"), "c_name", "c_mktsegment")
    rows.write.csv(path, header=True)
    return S.read_csv(spark, path)


@query("SELECT r_regionkey, r_name FROM region")
def digest_scan(spark: SparkSession, d: str) -> DataFrame:
    """A CSV file accepted only with its pinned digest."""
    path = S.scratch(spark)
    table(spark, d, "region").select("r_regionkey", "r_name").coalesce(1).write.csv(path, header=True)
    pinned = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path", F.sha2("content", 256).alias("d")).first()
    return S.read_pinned(spark, pinned["path"], pinned["d"]).select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")


@query("SELECT doc_id, lang, source FROM documents")
def export_jsonl(spark: SparkSession, d: str) -> DataFrame:
    path = S.scratch(spark)
    S.write_lines(table(spark, d, "documents").select("doc_id", "lang", "source"), path)
    return spark.read.schema("doc_id long, lang string, source string").json(path)


@query("SELECT 'supplier' AS kind, CAST(s_suppkey AS VARCHAR) AS key, s_name AS supplier_name, NULL AS part_name FROM supplier UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), NULL, p_name FROM part")
def csv_union(spark: SparkSession, d: str) -> DataFrame:
    """Two kinds of rows in one CSV with the union of their columns."""
    path = S.scratch(spark)
    a = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("supplier_name"))
    b = table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("key"), F.col("p_name").alias("part_name"))
    S.write_union_csv([a, b], path)
    return spark.read.csv(path, header=True)


@query("SELECT CAST(3 AS INT) AS version, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS records, CAST(1 AS INT) AS conflicts")
def cas_publish(spark: SparkSession, d: str) -> DataFrame:
    """Three revisions of a dataset head; a writer with an old expectation loses."""
    from fieldtrace.errors import FieldtraceError

    folder, version, lost = S.scratch(spark), 0, 0
    counts = {r["o_orderstatus"]: r["n"] for r in table(spark, d, "orders").filter("o_orderstatus in ('O', 'P', 'F')").groupBy("o_orderstatus").agg(F.count("*").alias("n")).collect()}  # three groups
    for status in ("O", "P", "F"):
        version = S.publish(spark, folder, version, {"status": status, "records": counts.get(status, 0)})
    try:
        S.publish(spark, folder, 1, {"status": "late"})
    except FieldtraceError as e:
        lost += e.code == "PUBLICATION_CONFLICT"
    at, manifest = S.head(spark, folder)
    return spark.createDataFrame([(at, manifest["records"], lost)], "version int, records long, conflicts int")


@query("SELECT doc_id, array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+'), ' ') AS words FROM documents")
def ascii_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.ascii_words(F.col("title")).alias("words"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(replace(lower(title), 'ς', 'σ'), '[\p{L}\p{N}\p{M}_]+'), ' ') AS words FROM documents")
def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.translate(text.words(F.col("title")), "ς", "σ").alias("words"))


@query("SELECT source_id, CASE WHEN contains(source_id, 'direkt') OR contains(source_id, 'trade') THEN 'trade' WHEN contains(source_id, 'nord') THEN 'north' ELSE source_id END AS vendor FROM (SELECT DISTINCT source_id FROM products)")
def vendor_alias(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("source_id").distinct().select("source_id", text.alias_of(F.col("source_id"), {"trade": ["direkt", "trade"], "north": ["nord"]}).alias("vendor"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_filter(['brand', 'name', 'size'], lambda x: NOT list_contains(k, x))), ',') AS missing, array_to_string(list_sort(list_distinct(list_concat(k, ['extra']))), ',') AS universe
FROM (SELECT p_partkey, list_filter([CASE WHEN p_size > 25 THEN 'size' END, CASE WHEN p_partkey % 2 = 0 THEN 'name' END, 'brand'], lambda x: x IS NOT NULL) AS k FROM part)""")
def key_sets(spark: SparkSession, d: str) -> DataFrame:
    k = F.array_compact(F.array(F.when(F.col("p_size") > 25, "size"), F.when(F.col("p_partkey") % 2 == 0, "name"), F.lit("brand")))
    want = F.array(F.lit("brand"), F.lit("name"), F.lit("size"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.array_except(want, k)), ",").alias("missing"), F.array_join(F.array_sort(F.array_union(k, F.array(F.lit("extra")))), ",").alias("universe"))


@query("SELECT count(*) AS pages, count(DISTINCT listing_id) AS urls, CAST(0 AS BIGINT) AS misaligned FROM products")
def retained_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Retained pages against a new run, by position and requested URL."""
    pages = _html(spark, d).select("ord", "url", canon.text_digest(F.col("body")).alias("kept"))
    kept = cut(pages)
    both = pages.withColumnRenamed("kept", "now").join(kept.withColumnRenamed("url", "old_url"), "ord", "full")
    return both.agg(F.count("*").alias("pages"), F.countDistinct("url").alias("urls"), F.count_if(~F.col("url").eqNullSafe(F.col("old_url")) | ~F.col("now").eqNullSafe(F.col("kept"))).alias("misaligned"))


QUERIES, SQL = query.queries, query.sql
