"""Queries of trees, TF-IDF ranking, embeddings and parsed replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fieldtrace.functions import text
from fieldtrace.operators import hierarchy as H, taxonomy as T
from fieldtrace.queries.problems import _LATEST, _P1
from fieldtrace.queries.registry import Registry
from fieldtrace.runtime import cut, spread, table

query = Registry()
#: Class centres that meet the vectors at once.
CENTRES = 2_000


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return H.latest_rows(table(spark, d, "classification_tree").select("id", "parent_id", "name", "scheme_id", "loaded_at"))


@query(f"WITH {_LATEST} SELECT id FROM latest WHERE id NOT IN (SELECT parent_id FROM latest WHERE parent_id IS NOT NULL)")
def taxonomy_leaves(spark: SparkSession, d: str) -> DataFrame:
    return T.leaves(_nodes(spark, d)).select("id")


@query(_P1 + """, raw AS (SELECT id, parent_id FROM classification_tree WHERE id IS NOT NULL)
SELECT 'repeated_id' AS problem, count(*) AS nodes FROM (SELECT id FROM raw GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'unknown_parent', count(DISTINCT id) FROM raw WHERE parent_id NOT IN (SELECT id FROM raw)
UNION ALL SELECT 'cycle', count(*) FROM solved WHERE full_path = 'cycle'
UNION ALL SELECT 'too_deep', count(*) FROM solved WHERE depth > 64""")
def tree_check(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "classification_tree").filter("id is not null")
    return T.tree_check(raw.select("id", "parent_id"), H.hierarchy(_nodes(spark, d), locality="scheme_id"))


@query("""SELECT c_custkey, 'r' || r_regionkey || '.n' || n_nationkey || '.c' || c_custkey AS path, CAST(3 AS INT) AS depth, r_name || ' > ' || n_name || ' > ' || c_name AS names
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def lookup_chain(spark: SparkSession, d: str) -> DataFrame:
    """Three fixed levels joined upward; region and nation are reference tables of fixed size."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    path = F.concat(F.lit("r"), "r_regionkey", F.lit(".n"), "n_nationkey", F.lit(".c"), "c_custkey")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).withColumn("path", path)
    return rows.select("c_custkey", "path", text.path_depth(F.col("path")).alias("depth"), F.concat_ws(" > ", "r_name", "n_name", "c_name").alias("names"))


@query(_P1 + """, steps AS (SELECT id, unnest(string_split(full_path, '.')) AS step, generate_subscripts(string_split(full_path, '.'), 1) AS pos FROM solved WHERE depth > 0)
SELECT s.id, string_agg(coalesce(l.name, ''), ' > ' ORDER BY pos) AS name_path FROM steps s JOIN latest l ON CAST(l.id AS VARCHAR) = step GROUP BY s.id""")
def taxonomy_path_names(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    return T.path_names(nodes, H.hierarchy(nodes, locality="scheme_id"))


_TOK = r"unnest(regexp_extract_all(replace(replace(replace(replace(replace(lower({}), 'ς', 'σ'), 'ß', 'ss'), 'µ', 'μ'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '[\p{{L}}\p{{N}}_]+'))"


@query(f"""WITH t AS (SELECT doc_id, {_TOK.format('text')} AS token FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT token, count(DISTINCT doc_id) AS df, round(ln((1.0 + n.n) / (1.0 + count(DISTINCT doc_id))) + 1, 6) AS idf FROM t, n GROUP BY token, n.n""")
def tfidf_df(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return T.idf(T.token_counts(docs, "doc_id", F.col("text")), docs.count()).select("token", "df", F.round("idf", 6).alias("idf"))


_RANK = f"""WITH leaf AS (SELECT c.canon_id AS leaf_id, coalesce(p.name || ' ', '') || c.name || coalesce(' ' || array_to_string(c.aliases, ' '), '') AS text FROM canonical_categories c LEFT JOIN canonical_categories p ON c.parent_canon_id = p.canon_id WHERE c.level = 'subcategory'),
dt AS (SELECT leaf_id, {_TOK.format('text')} AS token FROM leaf), dc AS (SELECT leaf_id, token, count(*) AS tf FROM dt GROUP BY ALL),
w AS (SELECT token, ln((1.0 + (SELECT count(*) FROM leaf)) / (1.0 + count(*))) + 1 AS idf FROM dc GROUP BY token),
dw AS (SELECT leaf_id, token, tf * idf AS w FROM dc JOIN w USING (token)), dn AS (SELECT leaf_id, sqrt(sum(w * w)) AS dn FROM dw GROUP BY leaf_id),
qt AS (SELECT listing_id, {_TOK.format('product_name')} AS token FROM products), qc AS (SELECT listing_id, token, count(*) AS tf FROM qt GROUP BY ALL),
qw AS (SELECT listing_id, token, tf * idf AS w FROM qc JOIN w USING (token)), qn AS (SELECT listing_id, sqrt(sum(w * w)) AS qn FROM qw GROUP BY listing_id),
s AS (SELECT q.listing_id, d.leaf_id, sum(q.w * d.w) AS dot FROM qw q JOIN dw d USING (token) GROUP BY ALL),
m AS (SELECT listing_id, leaf_id, round(dot / (dn * qn), 6) AS similarity FROM s JOIN dn USING (leaf_id) JOIN qn USING (listing_id)),
f AS (SELECT * FROM m UNION ALL SELECT p.listing_id, l.leaf_id, 0.0 FROM products p, leaf l WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.listing_id = p.listing_id AND m.leaf_id = l.leaf_id))
SELECT listing_id, leaf_id, similarity, CAST(row_number() OVER (PARTITION BY listing_id ORDER BY similarity DESC, leaf_id) AS INT) AS rank FROM f QUALIFY rank <= """


def _leaf_texts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "canonical_categories")
    up = c.select(F.col("canon_id").alias("parent_canon_id"), F.col("name").alias("parent_name"))
    leaf = c.filter("level = 'subcategory'").withColumn("parent_canon_id", F.col("parent_canon_id").cast("int")).join(up, "parent_canon_id", "left")
    return leaf.select(F.col("canon_id").alias("leaf_id"), F.concat_ws(" ", "parent_name", "name", F.array_join("aliases", " ")).alias("text"))


@query(_RANK + "10")
def tfidf_rank(spark: SparkSession, d: str) -> DataFrame:
    """The ten likeliest leaves of every listing; suggestions only, never a decision."""
    return T.rank(table(spark, d, "products"), "listing_id", "product_name", _leaf_texts(spark, d))


@query(_RANK + "1")
def tfidf_best(spark: SparkSession, d: str) -> DataFrame:
    return T.rank(table(spark, d, "products"), "listing_id", "product_name", _leaf_texts(spark, d), 1)


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(replace(replace(replace(replace(replace(lower(text), 'ς', 'σ'), 'ß', 'ss'), 'µ', 'μ'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '[\p{L}\p{N}_]+') AS t FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, unnest(t) AS gram FROM w UNION ALL SELECT doc_id, unnest([t[i] || ' ' || t[i + 1] for i in range(1, len(t))]) FROM w UNION ALL SELECT doc_id, unnest([t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] for i in range(1, len(t) - 1)]) FROM w)
SELECT gram, count(*) AS tf, count(DISTINCT doc_id) AS df FROM g GROUP BY gram ORDER BY tf DESC, gram LIMIT 500""")
def ngram_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 500 most frequent 1- to 3-grams of the corpus, a vocabulary of fixed size."""
    w = spread(table(spark, d, "documents").select("doc_id", "text")).filter("text is not null").select("doc_id", text.word_list(F.col("text")).alias("t"))
    at = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("t") - k)), lambda i: F.array_join(F.slice("t", i, F.lit(k + 1)), " "))
    grams = F.concat(F.col("t"), F.when(F.size("t") > 1, at(1)).otherwise(F.array().cast("array<string>")), F.when(F.size("t") > 2, at(2)).otherwise(F.array().cast("array<string>")))
    rows = w.select("doc_id", F.explode(grams).alias("gram")).groupBy("doc_id", "gram").agg(F.count("*").alias("n"))
    return rows.groupBy("gram").agg(F.sum("n").alias("tf"), F.count("*").alias("df")).orderBy(F.desc("tf"), "gram").limit(500)


@query("""WITH c AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM c GROUP BY label, i),
v AS (SELECT label, list(x ORDER BY i) AS centre FROM m GROUP BY label),
s AS (SELECT e.vec_id, v.label AS leaf, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), v.centre), 6) AS score FROM embeddings e, v)
SELECT vec_id, leaf, score, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, leaf) AS INT) AS rank FROM s QUALIFY rank <= 20""")
def embed_shortlist(spark: SparkSession, d: str) -> DataFrame:
    """The twenty nearest class centres of every vector by dot product.

    The centres are aggregated by class and position. They meet the vectors in
    blocks of ``CENTRES``: a block's best twenty are kept, and the best twenty
    of all blocks are the answer, so any number of classes has an exact way.
    """
    e = table(spark, d, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centres = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))
    numbered = cut(centres.withColumn("block", (F.row_number().over(Window.orderBy("label")) - 1) / CENTRES).withColumn("block", F.col("block").cast("int")))  # one row per class
    blocks = [r["block"] for r in numbered.select("block").distinct().orderBy("block").collect()]
    if not blocks:
        return e.select("vec_id", F.lit(0).alias("leaf"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    dot = lambda c: F.aggregate(F.zip_with("embedding", F.array(*map(F.lit, c)), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, v: a + v)
    best = None
    for block in blocks:
        held = numbered.filter(F.col("block") == block).collect()  # at most CENTRES rows
        scores = F.array_sort(F.array(*[F.struct((-F.round(dot(r["centre"]), 6)).alias("neg"), F.lit(r["label"]).alias("leaf")) for r in held]))
        mine = e.select("vec_id", F.slice(scores, 1, 20).alias("best"))
        best = mine if best is None else cut(best.unionByName(cut(mine)).groupBy("vec_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, 20).alias("best")))  # two lists of twenty
    told = best.select("vec_id", F.posexplode("best").alias("pos", "s"))
    return told.select("vec_id", "s.leaf", (-F.col("s.neg")).alias("score"), (F.col("pos") + 1).alias("rank"))


@query("""SELECT listing_id, canon_id FROM (SELECT listing_id, CAST(json_extract_string(technical_specs, '$.Category') AS VARCHAR) AS x, category FROM products) p JOIN canonical_categories c ON c.name = p.category AND c.level = 'category'""")
def reply_parse(spark: SparkSession, d: str) -> DataFrame:
    """Free-text replies around a JSON object; its value must be a known entry."""
    reply = F.concat(F.lit("Sure! Here it is:\n"), F.to_json(F.struct(F.col("category").alias("answer"))), F.lit("\nAnything else?"))
    rows = table(spark, d, "products").select("listing_id", F.try_variant_get(text.reply_json(reply), "$.answer", "string").alias("name"))
    known = table(spark, d, "canonical_categories").filter("level = 'category'").select("name", "canon_id")
    return rows.join(known, "name").select("listing_id", "canon_id")


@query("SELECT listing_id, concat_ws(' | ', 'Brand: ' || brand, 'Name: ' || product_name, 'Text: ' || left(short_description, 60)) AS context FROM products")
def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    part = lambda label, c: F.concat(F.lit(f"{label}: "), c)
    return table(spark, d, "products").select("listing_id", F.concat_ws(" | ", part("Brand", F.col("brand")), part("Name", F.col("product_name")), part("Text", F.substring("short_description", 1, 60))).alias("context"))


_TOLD = """(WITH e AS (SELECT listing_id, e.id AS pos, e.key AS k, CASE e.type WHEN 'VARCHAR' THEN json_extract_string(e.value, '$') ELSE CAST(e.value AS VARCHAR) END AS v FROM products, json_each(technical_specs) e),
s AS (SELECT listing_id, list(k || ' ' || v ORDER BY pos) AS words, list('- ' || k || ': ' || v ORDER BY pos)[1:10] AS lines FROM e GROUP BY listing_id)
SELECT listing_id, coalesce(product_name, '') AS name, coalesce(short_description, '') AS description, concat_ws(' ', product_name, short_description, array_to_string(words, ' ')) AS product_name, coalesce(array_to_string(lines, chr(10)), '') AS lines FROM products LEFT JOIN s USING (listing_id))"""


@query(f"""WITH told AS MATERIALIZED {_TOLD}, ranked AS ({_RANK.replace("FROM products)", "FROM told)")}30),
leaf AS (SELECT c.canon_id AS leaf_id, concat_ws(' > ', p.name, c.name) AS path FROM canonical_categories c LEFT JOIN canonical_categories p ON c.parent_canon_id = p.canon_id),
options AS (SELECT listing_id, string_agg('ID: ' || leaf_id || ' | Similarity: ' || printf('%.6f', similarity) || ' | Path: ' || path, chr(10) ORDER BY rank) AS options FROM ranked JOIN leaf USING (leaf_id) GROUP BY listing_id)
SELECT listing_id, 'Name: ' || name || chr(10) || 'Description: ' || description || chr(10) || 'Technical Specifications:' || chr(10) || lines || chr(10) || 'MOST RELEVANT CLASSIFICATION OPTIONS:' || chr(10) || coalesce(options, '') AS context FROM told LEFT JOIN options USING (listing_id)""")
def prompt_whole(spark: SparkSession, d: str) -> DataFrame:
    """The product part of the classification prompt: name, whole description, first ten specs, thirty ranked leaves.

    The leaves are ranked by name, description and all specs. Specs that aren't
    JSON stand as they are; what isn't told is empty. Similarities have six
    digits. There are always thirty options as long as there are so many leaves:
    those that share no word with the listing follow with similarity 0, least ids
    first. They are appended to a listing's list, not joined as rows.
    """
    specs = F.from_json("technical_specs", "map<string,string>")
    entries = F.map_entries("specs")
    each = lambda start, between: F.transform(entries, lambda e: F.concat(F.lit(start), e["key"], F.lit(between), F.coalesce(e["value"], F.lit("null"))))
    raw = F.when(F.try_parse_json("technical_specs").isNull(), F.col("technical_specs"))
    p = table(spark, d, "products").select("listing_id", "product_name", "short_description", "technical_specs").withColumn("specs", specs)
    told = cut(p.select(
        "listing_id", F.coalesce("product_name", F.lit("")).alias("name"), F.coalesce("short_description", F.lit("")).alias("description"),
        F.coalesce(F.array_join(F.slice(each("- ", ": "), 1, 10), "\n"), raw, F.lit("")).alias("lines"), F.concat_ws(" ", "product_name", "short_description", F.coalesce(F.array_join(each("", " "), " "), raw)).alias("text")))
    leaves = _leaf_texts(spark, d)
    ranked = T.rank(told, "listing_id", "text", leaves, 30, fill=False)
    c = table(spark, d, "canonical_categories")
    up = c.select(F.col("canon_id").alias("parent_canon_id"), F.col("name").alias("parent_name"))
    paths = c.withColumn("parent_canon_id", F.col("parent_canon_id").cast("int")).join(up, "parent_canon_id", "left").select(F.col("canon_id").alias("leaf_id"), F.concat_ws(" > ", "parent_name", "name").alias("path"))
    option = F.concat(F.lit("ID: "), "leaf_id", F.lit(" | Similarity: "), F.format_string("%.6f", "similarity"), F.lit(" | Path: "), "path")
    placed = F.struct((-F.col("similarity")).alias("neg"), "leaf_id", option.alias("option"))
    # a list with p leaves above 0 lacks 30 - p, and at most p of the thirty least ids are on it
    zeros = leaves.filter("leaf_id is not null").select("leaf_id").orderBy("leaf_id").limit(30).join(paths, "leaf_id").withColumn("similarity", F.lit(0.0))
    least = F.broadcast(zeros.agg(F.array_sort(F.collect_list(placed)).alias("least")))
    shared = ranked.join(paths, "leaf_id").groupBy("listing_id").agg(F.collect_list(placed).alias("o"))  # thirty at most
    told = told.join(shared, "listing_id", "left").crossJoin(least)
    others = F.filter("least", lambda x: ~F.exists("o", lambda y: y["leaf_id"] == x["leaf_id"]))
    best = F.slice(F.array_sort(F.coalesce(F.concat("o", others), "least")), 1, 30)
    options = F.array_join(F.transform(best, lambda x: x["option"]), "\n")
    context = F.concat(F.lit("Name: "), "name", F.lit("\nDescription: "), "description", F.lit("\nTechnical Specifications:\n"), "lines", F.lit("\nMOST RELEVANT CLASSIFICATION OPTIONS:\n"), options)
    return told.select("listing_id", context.alias("context"))


@query(_P1 + """ SELECT scheme_id, CAST(depth AS INT) AS depth, count(*) AS nodes FROM solved JOIN latest USING (id) GROUP BY scheme_id, depth""")
def depth_profile(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    return H.hierarchy(nodes, locality="scheme_id").join(nodes.select("id", "scheme_id"), "id").groupBy("scheme_id", "depth").agg(F.count("*").alias("nodes"))


QUERIES, SQL = query.queries, query.sql
