"""Queries of calibration and classification metrics, splits and deduplication.

Predictions are derived from customers: the market segment is the label, and
each class has a weight computed from the key, higher for the label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldtrace.functions import text
from fieldtrace.operators import classify as K, evaluate as V
from fieldtrace.queries.registry import Registry
from fieldtrace.runtime import beside, cut, table

query = Registry()
CLASSES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _weight(k: int):
    return (F.col("c_custkey") * ((k + 3) * 7919)) % 97 + 1 + F.when(F.col("c_mktsegment") == CLASSES[k], 40).otherwise(0)


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").filter(F.col("c_mktsegment").isin(CLASSES))
    total = sum((_weight(k) for k in range(1, 5)), _weight(0))
    p = F.create_map(*[x for k in range(5) for x in (F.lit(CLASSES[k]), (_weight(k) / total).cast("double"))])
    return rows.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), p.alias("probabilities"))


_PR = f"""WITH k AS (SELECT unnest(range(0, 5)) AS k, unnest({CLASSES}) AS cls),
w AS (SELECT c_custkey AS id, c_mktsegment AS label, cls, ((c_custkey * ((k + 3) * 7919)) % 97 + 1 + CASE WHEN c_mktsegment = cls THEN 40 ELSE 0 END)::DOUBLE AS w FROM customer, k WHERE c_mktsegment IN (SELECT cls FROM k)),
pr AS (SELECT id, label, cls, w / sum(w) OVER (PARTITION BY id) AS p FROM w),"""


def _scaled(t: str) -> str:
    return f"""sc AS (SELECT id, label, cls, exp(ln(greatest(p, 1e-12)) / {t} - max(ln(greatest(p, 1e-12)) / {t}) OVER (PARTITION BY id)) AS e FROM pr),
sp AS (SELECT id, label, cls, e / sum(e) OVER (PARTITION BY id) AS p FROM sc),
j AS (SELECT id, label, cls AS chosen, p AS confidence, CAST(cls = label AS INT) AS hit FROM sp QUALIFY row_number() OVER (PARTITION BY id ORDER BY p DESC, cls) = 1)"""


@query(_PR + _scaled("1.5") + " SELECT id, label, cls AS class, round(p, 6) AS p FROM sp")
def rescale(spark: SparkSession, d: str) -> DataFrame:
    rows = _predictions(spark, d).select("id", "label", F.explode(V.rescale(F.col("probabilities"), 1.5)).alias("class", "p"))
    return rows.withColumn("p", F.round("p", 6))


@query(_PR + _scaled("1.0") + " SELECT id, chosen, round(confidence, 6) AS confidence, hit FROM j")
def winners(spark: SparkSession, d: str) -> DataFrame:
    return V.judged(_predictions(spark, d)).select("id", "chosen", F.round("confidence", 6).alias("confidence"), "hit")


@query(_PR + _scaled("1.0") + """, c AS (SELECT label AS class FROM j UNION SELECT chosen FROM j)
SELECT class, count_if(label = class AND chosen = class) AS tp, count_if(label <> class AND chosen = class) AS fp, count_if(label = class AND chosen <> class) AS fn FROM c, j GROUP BY class""")
def confusion_f1(spark: SparkSession, d: str) -> DataFrame:
    return V.confusion(V.judged(_predictions(spark, d)))


@query(_PR + _scaled("1.0") + """, c AS (SELECT label AS class FROM j UNION SELECT chosen FROM j),
f AS (SELECT class, count_if(label = class AND chosen = class) AS tp, count_if(label <> class AND chosen = class) AS fp, count_if(label = class AND chosen <> class) AS fn FROM c, j GROUP BY class)
SELECT round(avg(2.0 * tp / (2 * tp + fp + fn)), 6) AS macro_f1 FROM f""")
def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return V.macro_f1(V.confusion(V.judged(_predictions(spark, d)))).select(F.round("macro_f1", 6).alias("macro_f1"))


@query(_PR + _scaled("1.0") + " SELECT label, " + ", ".join(f"count_if(chosen = '{c}') AS {c.lower()}" for c in CLASSES) + " FROM j GROUP BY label")
def confusion_pivot(spark: SparkSession, d: str) -> DataFrame:
    j = V.judged(_predictions(spark, d))
    return j.groupBy("label").pivot("chosen", CLASSES).agg(F.count(F.lit(1))).na.fill(0).toDF("label", *[c.lower() for c in CLASSES])


@query(_PR + _scaled("1.0") + """, b AS (SELECT least(9, floor(confidence * 10)) AS bin, count(*) AS n, avg(confidence) AS c, avg(hit) AS a FROM j GROUP BY 1)
SELECT round(sum(abs(c - a) * n) / sum(n), 6) AS ece FROM b""")
def ece(spark: SparkSession, d: str) -> DataFrame:
    return V.expected_calibration_error(V.judged(_predictions(spark, d))).select(F.round("ece", 6).alias("ece"))


@query(_PR + _scaled("1.0") + " SELECT round(avg(s), 6) AS brier FROM (SELECT id, sum((p - CAST(cls = label AS INT)) ** 2) AS s FROM sp GROUP BY id)")
def brier(spark: SparkSession, d: str) -> DataFrame:
    return V.brier(V.judged(_predictions(spark, d))).select(F.round("brier", 6).alias("brier"))


@query(_PR + f""" t AS (SELECT unnest({V.TEMPERATURES}) AS t),
sc AS (SELECT id, label, cls, t, exp(ln(greatest(p, 1e-12)) / t) AS e FROM pr, t), sp AS (SELECT id, label, cls, t, e / sum(e) OVER (PARTITION BY id, t) AS p FROM sc),
n AS (SELECT t, round(sum(-ln(greatest(p, 1e-12))), 6) AS nll FROM sp WHERE cls = label GROUP BY t)
SELECT CAST(t AS DOUBLE) AS temperature, nll FROM n ORDER BY nll, t LIMIT 1""")
def temp_fit(spark: SparkSession, d: str) -> DataFrame:
    return V.fit_temperature(_predictions(spark, d))


_WILSON = "CASE WHEN accepted > 0 THEN (correct / accepted + {zz} / (2 * accepted) - {z} * sqrt(correct / accepted * (1 - correct / accepted) / accepted + {zz} / (4 * accepted * accepted))) / (1 + {zz} / accepted) ELSE 0 END".replace("accepted", "accepted::DOUBLE").format(z=V.Z95, zz=V.Z95**2).replace("accepted::DOUBLE > 0", "accepted > 0")


@query(_PR + _scaled("0.5") + f""", g AS (SELECT unnest(range(50, 101)) AS c),
a AS (SELECT c / 100.0::DOUBLE AS threshold, count(confidence) AS accepted, CAST(coalesce(sum(hit), 0) AS BIGINT) AS correct FROM g LEFT JOIN j ON floor(round(confidence * 100, 9)) >= c GROUP BY c)
SELECT threshold, accepted, correct, round({_WILSON}, 6) AS wilson FROM a""")
def threshold_table(spark: SparkSession, d: str) -> DataFrame:
    return V.threshold_table(V.judged(_predictions(spark, d), 0.5))


@query(f"SELECT source, accepted, correct, round({_WILSON}, 6) AS wilson FROM (SELECT source, count(*) AS accepted, count_if(lang = 'en') AS correct FROM documents GROUP BY source)")
def wilson(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("accepted"), F.count_if(F.col("lang") == "en").alias("correct"))
    return rows.withColumn("wilson", F.round(V.wilson_lower(F.col("correct"), F.col("accepted")), 6))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(count(*) * 1000 / sum(value), 6) AS per_second FROM events GROUP BY event_type")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles and sequential throughput of latencies."""
    return table(spark, d, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.5) within group (order by value)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"), F.round(F.count("*") * 1000 / F.sum("value"), 6).alias("per_second"))


@query("""SELECT c_custkey, CAST(2 * (CASE WHEN c_nationkey % 5 <> c_custkey % 5 THEN 2 WHEN c_nationkey <> c_custkey % 25 THEN 1 ELSE 0 END) AS INT) AS distance,
 CAST(CASE WHEN c_nationkey % 5 <> c_custkey % 5 THEN 1 WHEN c_nationkey <> c_custkey % 25 THEN 2 ELSE 3 END AS INT) AS shared FROM customer""")
def tree_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distance of two leaves by the common beginning of their paths."""
    path = lambda leaf: F.array(F.lit("root"), F.concat(F.lit("g"), leaf % 5), F.concat(F.lit("n"), leaf))
    rows = table(spark, d, "customer").select("c_custkey", path(F.col("c_nationkey").cast("long")).alias("a"), path(F.col("c_custkey") % 25).alias("b"))
    shared = V.shared_prefix(F.col("a"), F.col("b"))
    return rows.select("c_custkey", (F.size("a") + F.size("b") - 2 * shared).alias("distance"), shared.alias("shared"))


@query(_PR + """ b AS (SELECT id, CASE WHEN id % 11 = 0 THEN 1.5 ELSE 1 END AS f FROM (SELECT DISTINCT id FROM pr))
SELECT count(*) AS predictions, count_if(NOT ok) AS invalid FROM (SELECT id, abs(sum(p * f) - 1) <= 0.002 AND max(p * f) <= 1 AS ok FROM pr JOIN b USING (id) GROUP BY id)""")
def prediction_validity(spark: SparkSession, d: str) -> DataFrame:
    broken = F.transform_values("probabilities", lambda k, v: v * F.when(F.col("id") % 11 == 0, 1.5).otherwise(1.0))
    rows = _predictions(spark, d).withColumn("probabilities", broken)
    return rows.agg(F.count("*").alias("predictions"), F.count_if(~V.valid_probabilities(F.col("probabilities"))).alias("invalid"))


@query("SELECT count(*) AS labels, count_if(p IS NULL) AS unpredicted, count_if(c_custkey IS NULL) AS unlabelled FROM customer FULL JOIN (SELECT DISTINCT o_custkey AS p FROM orders) ON c_custkey = p")
def label_pred_check(spark: SparkSession, d: str) -> DataFrame:
    """Two id sets that should be equal, compared from both sides."""
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("p")).distinct()
    both = table(spark, d, "customer").join(p, F.col("c_custkey") == F.col("p"), "full")
    return both.agg(F.count("*").alias("labels"), F.count_if(F.col("p").isNull()).alias("unpredicted"), F.count_if(F.col("c_custkey").isNull()).alias("unlabelled"))


@query("""WITH s AS (SELECT lower(trim(decision)) AS decision, proposed_type_id, type_id FROM (SELECT DISTINCT * FROM spot_reviews) r JOIN products p USING (listing_id))
SELECT decision, count(*) AS reviews, count(*) FILTER (WHERE CAST(proposed_type_id AS VARCHAR) = trim(type_id)) AS agreed, round(count_if(proposed_type_id IS NOT NULL) / count(*), 6) AS proposed_share FROM s GROUP BY decision""")
def agreement(spark: SparkSession, d: str) -> DataFrame:
    """Reviews against the listings' own types; repeated review rows count once."""
    r = table(spark, d, "spot_reviews").distinct()
    p = table(spark, d, "products").select("listing_id", "type_id")
    rows = r.join(p, "listing_id").groupBy(F.lower(F.trim("decision")).alias("decision"))
    return rows.agg(F.count("*").alias("reviews"), F.count_if(F.col("proposed_type_id").cast("long").cast("string") == F.trim("type_id")).alias("agreed"), F.round(F.count("proposed_type_id") / F.count("*"), 6).alias("proposed_share"))


_NAME = r"trim(regexp_replace(lower(product_name), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH t AS (SELECT listing_id, category AS label, {_NAME} AS norm FROM products WHERE category IS NOT NULL AND product_name IS NOT NULL),
g AS (SELECT norm, min(listing_id) AS listing_id FROM t WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT label) = 1)
SELECT listing_id, norm FROM g""")
def source_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each normalised title; titles with several labels go entirely."""
    rows = table(spark, d, "products").filter("category is not null and product_name is not null").select("listing_id", F.col("category").alias("label"), text.ascii_words(F.col("product_name")).alias("norm"))
    told = rows.filter("norm <> ''").groupBy("norm").agg(F.min("listing_id").alias("listing_id"), F.min("label").alias("a"), F.max("label").alias("b"))
    return told.filter("a = b").select("listing_id", "norm")


def _split_of(key):
    """Train, calibration or test by a hash of the group: groups never straddle."""
    first = F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int") % 10
    return F.when(first < 6, "train").when(first < 8, "calibration").otherwise("test")


_SPLIT = "CASE WHEN CAST('0x' || substr(md5({k}), 1, 4) AS INT) % 10 < 6 THEN 'train' WHEN CAST('0x' || substr(md5({k}), 1, 4) AS INT) % 10 < 8 THEN 'calibration' ELSE 'test' END"


@query(f"SELECT {_SPLIT.format(k='source_id')} AS split, count(*) AS listings, count(DISTINCT source_id) AS groups, count(DISTINCT category) AS labels FROM products GROUP BY 1")
def group_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "products").withColumn("split", _split_of(F.col("source_id")))
    return rows.groupBy("split").agg(F.count("*").alias("listings"), F.countDistinct("source_id").alias("groups"), F.countDistinct("category").alias("labels"))


@query(f"""WITH t AS (SELECT *, {_SPLIT.format(k='CAST(listing_id AS VARCHAR)')} AS split, {_NAME} AS norm FROM products)
SELECT (SELECT count(*) FROM (SELECT source_id FROM t GROUP BY source_id HAVING count(DISTINCT split) > 1)) AS leaking_groups,
(SELECT count(*) FROM (SELECT norm FROM t WHERE norm <> '' GROUP BY norm HAVING count(*) > 1)) AS repeated_titles, (SELECT count(*) FROM t) AS rows""")
def split_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Groups that straddle a row-wise split, and titles that occur again."""
    rows = table(spark, d, "products").select("source_id", _split_of(F.col("listing_id").cast("string")).alias("split"), text.ascii_words(F.col("product_name")).alias("norm"))
    leaks = rows.groupBy("source_id").agg(F.min("split").alias("a"), F.max("split").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("leaking_groups"))
    again = rows.filter("norm <> ''").groupBy("norm").count().agg(F.count_if(F.col("count") > 1).alias("repeated_titles"))
    return beside(leaks, again, rows.agg(F.count("*").alias("rows")))


@query("""WITH g AS (SELECT source_id, category, count(*) AS n FROM products JOIN (SELECT DISTINCT name FROM canonical_categories WHERE level = 'category') c ON category = c.name GROUP BY ALL),
s AS (SELECT seed, category, n, CAST('0x' || substr(md5(seed || ':' || source_id), 1, 4) AS INT) % 10 AS h FROM g, (SELECT unnest(range(42, 242)) AS seed)),
p AS (SELECT seed, CASE WHEN h < 6 THEN 0 WHEN h < 8 THEN 1 ELSE 2 END AS part, category, sum(n) AS n FROM s GROUP BY ALL),
e AS (SELECT seed, count(*) AS cells, min(n) AS least, sum(n) FILTER (WHERE part = 0) AS a, sum(n) FILTER (WHERE part = 1) AS b, sum(n) FILTER (WHERE part = 2) AS c FROM p GROUP BY seed)
SELECT CAST(min(seed) AS INT) AS seed, count(*) AS eligible FROM e WHERE cells = 3 * (SELECT count(DISTINCT category) FROM g) AND least >= 2 AND least(a, b, c) >= 0.1 * (a + b + c)""")
def split_seed(spark: SparkSession, d: str) -> DataFrame:
    """The first of 200 seeds whose group split has enough rows of every class in every part.

    Rows are counted per group and class once; only those counts meet the seeds.
    """
    known = table(spark, d, "canonical_categories").filter("level = 'category'").select(F.col("name").alias("category")).distinct()
    groups = cut(table(spark, d, "products").join(known, "category").groupBy("source_id", "category").agg(F.count("*").alias("n")))
    classes = groups.select("category").distinct().count()
    h = F.conv(F.substring(F.md5(F.concat(F.col("seed").cast("string"), F.lit(":"), F.col("source_id"))), 1, 4), 16, 10).cast("int") % 10
    seeded = groups.withColumn("seed", F.explode(F.sequence(F.lit(42), F.lit(241)))).withColumn("part", F.when(h < 6, 0).when(h < 8, 1).otherwise(2))
    cells = seeded.groupBy("seed", "part", "category").agg(F.sum("n").alias("n"))
    of = lambda k: F.sum(F.when(F.col("part") == k, F.col("n"))).alias(f"p{k}")
    told = cells.groupBy("seed").agg(F.count("*").alias("cells"), F.min("n").alias("least"), of(0), of(1), of(2))
    ok = (F.col("cells") == 3 * classes) & (F.col("least") >= 2) & (F.least("p0", "p1", "p2") >= 0.1 * (F.col("p0") + F.col("p1") + F.col("p2")))
    return told.filter(ok).agg(F.min("seed").alias("seed"), F.count("*").alias("eligible"))


@query("SELECT source_id, count(*) AS listings, count_if(category IS NOT NULL AND category <> '') AS labelled, round(count_if(category IS NOT NULL AND category <> '') / count(*), 6) AS share FROM products GROUP BY source_id")
def valid_fraction(spark: SparkSession, d: str) -> DataFrame:
    ok = F.coalesce(F.col("category") != "", F.lit(False))
    return table(spark, d, "products").groupBy("source_id").agg(F.count("*").alias("listings"), F.count_if(ok).alias("labelled"), F.round(F.count_if(ok) / F.count("*"), 6).alias("share"))


@query()
def linear_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy and macro-F1 of a TF-IDF classifier on sellers it hasn't seen."""
    known = table(spark, d, "canonical_categories").filter("level = 'category'").select(F.col("name").alias("category"))
    rows = table(spark, d, "products").join(known, "category").select("listing_id", F.col("category").alias("label"), "product_name", _split_of(F.col("source_id")).alias("split"))
    rows = cut(rows)
    model = K.fit(rows.filter("split = 'train'"), "product_name", "label")
    if model is None:  # nothing to learn from
        return rows.limit(0).select(F.lit(0).cast("long").alias("test_rows"), F.lit(0.0).alias("accuracy"), F.lit(0.0).alias("macro_f1"))
    judged = cut(K.predict(model, rows.filter("split = 'test'"), "product_name").select("label", "chosen"))
    f1 = V.macro_f1(V.confusion(judged)).select(F.round("macro_f1", 4).alias("macro_f1"))
    return beside(judged.agg(F.count("*").alias("test_rows"), F.round(F.avg((F.col("label") == F.col("chosen")).cast("double")), 4).alias("accuracy")), f1)


QUERIES, SQL = query.queries, query.sql
